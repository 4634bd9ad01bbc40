"""Text functions as Spark column expressions: canonical forms, tokens, n-grams, clue patterns, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't "
    "have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is "
    "isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves "
    "out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves "
    "then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd "
    "we'll we're we've were weren't what what's when where where's which while who who's whom why with won't would wouldn't you you'd "
    "you'll you're you've your yours yourself yourselves"
).split()

#: Boundaries of a sentence: closing marks before white space.
SENTENCE_END = r"[.!?]+[ \t\n\r]+"
#: A word: letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def is_stop_word(word: Column) -> Column:
    """True for a stop word in any case."""
    return F.lower(word).isin(STOP_WORDS)


def canonical(text: Column) -> Column:
    """The canonical form of a phrase: outer non-word characters, a leading article or "one", and a trailing 's go.

    A text of non-word characters alone is kept as it is.
    """
    def bare(t: Column) -> Column:
        return F.when(t.rlike(r"^\W*$"), t).otherwise(F.regexp_replace(t, r"^\W+", ""))

    outer = F.when(text.rlike(r"^\W*$"), text).otherwise(F.regexp_replace(F.regexp_replace(text, r"\W+$", ""), r"^\W+", ""))
    return bare(F.regexp_replace(F.regexp_replace(outer, r"(?i)^(the|a|an|one)\s+", ""), r"(?i)\s*'s$", ""))


def sentences(text: Column) -> Column:
    """Sentences of a text, empty ones included, so that positions stay."""
    return F.split(text, SENTENCE_END, -1)


def tokens(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The words of a text with one blank between, as they stand in it: one string is handed to Python at far less cost than an array of words."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; question marks are left out before runs are cut."""
    kept = F.filter(words, lambda w: w != "?")
    count = F.greatest(F.size(kept) - (n - 1), F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(kept, i, n), " "))).otherwise(F.array().cast("array<string>"))


def quoted(text: Column) -> Column:
    """A text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def clue_pattern(label: Column, anywhere: bool = True) -> Column:
    """A pattern that finds a clue as a word, in any case and with a short suffix (one character, ed, es, ing); a final y also matches i."""
    ends_in_y = label.endswith("y") & (F.length(label) > 1)
    stem = F.when(ends_in_y, F.concat(quoted(F.substring(label, F.lit(1), F.length(label) - 1)), F.lit("[yi]"))).otherwise(quoted(label))
    around = F.lit(".*" if anywhere else "")
    return F.concat(F.lit("(?is)"), around, F.lit(r"\b"), stem, F.lit(r"(.|e?d|e?s|ing)?\b"), around)


def capitalized_title(title: Column) -> Column:
    """A title with all words but stop words capitalised, and its first character upper-cased."""
    def up(w: Column) -> Column:
        return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))

    words = F.transform(F.split(title, " ", -1), lambda w: F.when(is_stop_word(w), w).otherwise(up(w)))
    return up(F.array_join(words, " "))


def title_forms(title: Column) -> Column:
    """Forms under which a title is looked up: as it stands, then its canonical form."""
    return F.array_distinct(F.array(capitalized_title(title), capitalized_title(canonical(title))))


def type_label(name: Column) -> Column:
    """A type's name as words: underscores are blanks, final digits go, camel case is split."""
    spaced = F.regexp_replace(F.regexp_replace(name, "_", " "), r"[0-9]+$", "")
    return F.regexp_replace(spaced, r"(\p{Ll})(\p{Lu})", "$1 $2")


def property_label(name: Column) -> Column:
    """A property's label without what follows a slash or stands in brackets, words apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)", ""), r"/.*$", ""), r"(\p{Ll})(\p{Lu})", "$1 $2"))


def concept_label(full_label: Column, clue_label: Column) -> Column:
    """A concept's short label: "list of …" falls back to the clue, a final bracket goes."""
    return F.when(F.lower(full_label).startswith("list of "), clue_label).otherwise(F.regexp_replace(full_label, r"\s+\([^)]*\)\s*$", ""))


def document_title(title: Column) -> Column:
    """A document's title without its final bracket."""
    return F.regexp_replace(title, r"\s+\([^)]*\)\s*$", "")


def escaped_query(text: Column) -> Column:
    """A search phrase without the characters that queries give a meaning."""
    return F.translate(F.translate(text, "?[]/", "    "), '\\"', "")


def property_path(path: Column) -> Column:
    """"/a/b|/c/d" as ["a.b", "c.d"]."""
    return F.transform(F.split(path, r"\|"), lambda p: F.regexp_replace(F.regexp_replace(p, "^/", ""), "/", "."))


def description_tokens(text: Column) -> Column:
    """Words of a description: cut at punctuation and white space, lower case, none empty."""
    return F.filter(F.split(F.lower(text), r"[\p{Punct}\s]+"), lambda w: w != "")


def is_quantity(text: Column) -> Column:
    """True if the whole text reads as a number."""
    return text.try_cast("double").isNotNull()


def gold_pattern(pattern: Column) -> Column:
    """The gold pattern in any case, of letters beyond ASCII too."""
    return F.concat(F.lit("(?iu)"), pattern)


def gold_match(text: Column, pattern: Column) -> Column:
    """True where the gold pattern is found in the text, in any case."""
    return F.regexp_like(text, gold_pattern(pattern))

