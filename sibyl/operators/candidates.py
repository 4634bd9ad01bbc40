"""Candidate answers from passages: entities, phrases, BIO spans; distances to clues; merging inside a result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .hitlist import merge_vectors


def capitalised_runs(passages: DataFrame, keys: Sequence[str], text: str = "sentence") -> DataFrame:
    """Runs of capitalised words as name candidates: begin, end (word numbers), text. A rule in place of an entity tagger. Each passage is worked out by itself, row by row."""
    return passages.select(*keys, F.inline(capitalised_spans(F.col(text))))


def capitalised_spans(sentence: Column) -> Column:
    """The runs of capitalised words of a sentence, an array of (begin, end, text)."""

    def spans(words: Column) -> Column:
        letters = F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), "A").otherwise("a")), "")
        cut = lambda x: F.array_join(F.slice(words, x["begin"] + 1, x["end"] - x["begin"] + 1), " ")
        return F.transform(_bracketed(F.regexp_replace(letters, "(A+)", "<$1>"), "<", ">"), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), cut(x).alias("text")))

    return once(F.regexp_extract_all(sentence, F.lit(tx.TOKEN), F.lit(0)), spans)


# Closed classes of words, and endings of adjectives, for the letters of `tag_letters`.
LETTERS = {
    "D": ("the", "a", "an", "this", "that", "these", "those", "some", "any", "no", "every", "each", "his", "her", "its", "their", "my", "our", "your"),
    "O": ("of",),
    "I": ("in", "on", "at", "by", "for", "with", "from", "to", "into", "about", "after", "before", "under", "over", "as", "than", "between", "through", "during"),
    "A": ("and", "or", "but", "nor", "so", "if", "while", "because"),
    "V": ("is", "was", "are", "were", "be", "been", "am", "did", "does", "do", "has", "had", "have", "will", "would", "can", "could", "may", "might", "shall", "should", "must"),
    "T": ("he", "she", "it", "they", "we", "i", "you", "who", "whom", "what", "which", "when", "where", "how", "why", "there", "not"),
}
_ADJECTIVE = ("ful", "ous", "ive", "ic", "ical", "able", "ible", "less", "ish", "est")


def tag_letters(words: Column) -> Column:
    """A sentence's words as a string of a letter each: D determiner, J adjective, C number, N noun, P name, O "of", I preposition, A conjunction, V verb,
    R adverb, T pronoun, and a point for what is no word. By form and short lists; any tagger's letters can take their place."""

    longest = max(len(w) for listed in LETTERS.values() for w in listed)

    def ending(low: Column) -> Column:
        ends = lambda n, *by: (F.length(low) >= n) & reduce(Column.__or__, [low.endswith(e) for e in by])
        tested = F.when(ends(4, "ly"), "R").when(ends(5, "ing") | ends(4, "ed"), "V")
        for n in sorted({len(e) for e in _ADJECTIVE}):
            tested = tested.when(ends(n + 2, *[e for e in _ADJECTIVE if len(e) == n]), "J")
        return tested.otherwise("N")

    def listed(low: Column, other: Column) -> Column:
        out = F.when(F.length(low) > longest, other)
        for code, words in LETTERS.items():
            out = out.when(low.isin(*words), code)
        return out.otherwise(other)

    def letter(w: Column) -> Column:
        # most words begin with a to z, which is seen without a pattern; a word's lower case is made once for it
        plain = (w >= "a") & (w < "{")
        other = F.when(~w.rlike(r"^[\p{L}\p{N}]"), ".").when(w.rlike(r"^\p{N}"), "C")
        return F.when(plain, once(F.lower(w), lambda low: listed(low, ending(low)))).otherwise(F.coalesce(other, once(F.lower(w), lambda low: listed(low, F.when(w.rlike(r"^\p{Lu}"), "P").otherwise(ending(low))))))

    return F.array_join(F.transform(words, letter), "")


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, also where fn uses it inside functions of array elements."""
    return F.transform(F.array(value), fn)[0]


def _bracketed(marked: Column, start: str, stop: str) -> Column:
    """First and last number of the letters in each pair of brackets of a marked string."""

    def spans(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(F.replace(p, F.lit(stop), F.lit(""))))
        return once(lengths, lambda n: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, i: _span(F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b), F.instr(p, stop))))

    return once(F.split(marked, f"[{start}]", -1), spans)


def _span(begin: Column, width: Column) -> Column:
    return F.struct(begin.alias("begin"), (begin + width - 2).alias("end"))


def phrase_spans(letters: Column) -> Column:
    """Noun phrases of a string of letters, in two passes: level 1 is a determiner, adjectives and numbers before nouns and names; level 2 are runs of these with "of" between.

    An array of (begin, end, level), word numbers, both counted in. Work is by the square of the phrases of a sentence, which are few.
    """
    leveled = lambda spans, n: F.transform(spans, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), F.lit(n).alias("level")))

    def both(base: Column) -> Column:
        joined = F.translate(F.regexp_replace(base, r"(<[A-Z]+>(?:O<[A-Z]+>)+)", "{$1}"), "<>", "")
        return F.concat(leveled(_bracketed(base, "<", ">"), 1), leveled(_bracketed(joined, "{", "}"), 2))

    return once(F.regexp_replace(letters, r"(D?[JC]*[NP]+)", "<$1>"), both)


def covering_phrase(spans: Column, i: Column, widest: bool = True) -> Column:
    """The widest, or shortest, span around word i, of equal ones the first; null if there is none."""
    around = F.filter(spans, lambda x: (x["begin"] <= i) & (i <= x["end"]))
    keyed = F.transform(around, lambda x: F.struct((x["end"] - x["begin"]).alias("w"), (-x["begin"] if widest else x["begin"]).alias("b"), x.alias("span")))
    return (F.array_max if widest else F.array_min)(keyed)["span"]


def noun_phrases(passages: DataFrame, keys: Sequence[str], text: str = "sentence") -> DataFrame:
    """Every noun phrase of each passage, one row each: keys, begin, end, level, text; words are numbered from 0, with every other sign a word of its own. Null texts have none."""
    # phrases are cut inside the array, so that a sentence's words are not copied to each of its phrases
    cut = lambda words, x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["level"].alias("level"), F.array_join(F.slice(words, x["begin"] + 1, x["end"] - x["begin"] + 1), " ").alias("text"))
    found = once(F.regexp_extract_all(F.col(text), F.lit(tx.TOKEN + r"|[^\s\p{L}\p{N}]"), F.lit(0)), lambda words: F.transform(phrase_spans(tag_letters(words)), lambda x: cut(words, x)))
    return passages.select(*keys, F.inline(found))


def type_subjects(tokens: DataFrame, edges: DataFrame, lats: DataFrame, phrases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates of "the <type> is X": where a passage's subject is the question's answer type, the widest noun phrase around what governs it, unless that is a verb.

    tokens: keys with qid, i, begin, end, lemma, pos; edges: keys, gov, dep, rel; phrases: keys, kind, begin, end, text. Types are less specific by 1 at most.
    """
    keys = list(keys)
    named = lats.filter("specificity >= -1").select("qid", F.col("text").alias("lemma")).distinct()
    subject = edges.filter(F.col("rel").isin("nsubj", "nsubjpass")).join(tokens.select(*keys, F.col("i").alias("dep"), "lemma"), [*keys, "dep"]).join(named, ["qid", "lemma"], "left_semi")
    head = subject.join(tokens.select(*keys, F.col("i").alias("gov"), F.col("begin").alias("_b"), F.col("end").alias("_e"), "pos"), [*keys, "gov"]).filter(~F.col("pos").startswith("V"))
    around = head.select(*keys, "gov", "_b", "_e").join(phrases.filter("kind = 'NP'"), keys).filter("begin <= _b AND end >= _e")
    return around.groupBy(*keys, "gov").agg(F.max_by(F.struct("begin", "end", "text"), F.col("end") - F.col("begin")).alias("x")).select(*keys, "x.*").distinct()


def is_surprise(text: Column, labels: Column) -> Column:
    """True if the candidate does not end with any clue's label."""
    return ~F.exists(labels, lambda c: F.lower(text).endswith(F.lower(c)))


def with_surprise(candidates: DataFrame, clues: DataFrame) -> DataFrame:
    """Candidates of a question (qid, text, …) with `surprise`; a question's few clues are gathered to one row first."""
    labels = clues.groupBy("qid").agg(F.collect_set("label").alias("_labels"))
    out = candidates.join(labels, "qid", "left")
    return out.withColumn("surprise", F.when(F.col("_labels").isNull(), True).otherwise(is_surprise(F.col("text"), F.col("_labels")))).drop("_labels")


def blacklisted(text: Column) -> Column:
    """Single characters and stop words are no answers."""
    return (F.length(text) <= 1) | tx.is_stop_word(text)


def clue_distance(begin: Column, end: Column, clue_begin: Column, clue_end: Column) -> Column:
    """Words between a candidate and a clue match; -1 where they overlap."""
    return F.when(clue_begin > end, clue_begin - end - 1).when(begin > clue_end, begin - clue_end - 1).otherwise(-1)


def base_features(candidates: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """occurences, passageLogScore and psgDistClue, e^-distance to the first match only (by begin, then the longer), of each candidate."""
    w = Window.partitionBy(*keys).orderBy("clue_begin", F.desc("clue_end"), "label")
    first = matches.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
    distance = clue_distance(F.col("begin"), F.col("end"), F.col("clue_begin"), F.col("clue_end"))
    joined = candidates.join(first.select(*keys, "clue_begin", "clue_end"), list(keys), "left")
    return joined.select(*candidates.columns, F.lit(1).alias("occurences"), F.log1p("score").alias("passageLogScore"), F.when(F.col("clue_begin").isNotNull(), F.exp(-distance)).alias("psgDistClue"))


def merge_by_text(candidates: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Candidates of equal text inside one result become one; snippet ids are united."""
    return merge_vectors(candidates, [*keys, "text"], features, more=[F.array_sort(F.collect_set("snippet_id")).alias("snippet_ids")])


def bio_chunks(tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of B/I tags (i, token, tag, prob): begin, end, text, mean probability. A B starts a new run; a final . or , goes."""
    w = Window.partitionBy(*keys).orderBy("i")
    before = F.lag("tag", 1, "O").over(w)
    starts = (F.col("tag") != "O") & ((F.col("tag") == "B") | (before == "O"))
    marked = tags.withColumn("_start", starts.cast("int")).withColumn("_run", F.sum("_start").over(w)).filter(F.col("tag") != "O")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ")
    return marked.groupBy(*keys, "_run").agg(F.min("i").alias("begin"), F.max("i").alias("end"), F.regexp_replace(text, r"\s*[.,]$", "").alias("text"), F.avg("prob").alias("score")).drop("_run")


def context_features(tokens: DataFrame, keys: Sequence[str], column: str, reach: int = 1) -> DataFrame:
    """Tagger inputs of each token: its value and its neighbours' up to `reach`, and bigrams and trigrams of them; beyond the passage stands #."""
    w = Window.partitionBy(*keys).orderBy("i")
    at = {d: F.lag(column, -d, "#").over(w) if d < 0 else F.lead(column, d, "#").over(w) for d in range(-reach, reach + 1)} | {0: F.col(column)}
    places = sorted(at)
    made = [F.concat(F.lit(f"{column}[{d}]="), at[d]) for d in places]
    for n in (2, 3):
        made += [F.concat(F.lit(f"{column}[{g[0]}..{g[-1]}]="), F.concat_ws("|", *[at[d] for d in g])) for g in zip(*[places[j:] for j in range(n)], strict=False)]
    return tokens.select(*tokens.columns, F.array(*made).alias("features"))


def crossed_with_types(features: Column, synsets: Column) -> Column:
    """Each feature once for each question synset, besides itself."""
    return F.concat(features, F.flatten(F.transform(synsets, lambda s: F.transform(features, lambda f: F.concat(f, F.lit("@"), s.cast("string"))))))


def gold_mentions(passages: DataFrame, gold: DataFrame, keys: Sequence[str], text: str = "sentence") -> DataFrame:
    """Matches of the gold pattern as labelled mentions: number and text of each."""
    hits = F.regexp_extract_all(F.col(text), tx.gold_pattern(F.concat(F.lit("("), F.col("answer_pattern"), F.lit(")"))), F.lit(0))
    return passages.join(gold, "qid").select(*keys, F.posexplode(hits).alias("n", "mention"))


def to_answers(candidates: DataFrame, passages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per candidate, and one without text for a passage that has none."""
    return passages.select(*keys).join(candidates, list(keys), "left")
