"""Rule-based stand-ins for annotators: tokens with offsets, lemmas, coarse parts of speech, entities by pattern, phrases.

They are rules, not models: good for tests and for texts in plain style. Any table of the same shape from a real annotator can take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stages
from .text import TOKEN, is_stop_word

#: Patterns of the entity kinds that can be told by form.
ENTITY_PATTERNS = {
    "date": r"\b(?:\d{1,2} )?(?:January|February|March|April|May|June|July|August|September|October|November|December)(?: \d{1,2},?)?(?: \d{4})?\b|\b\d{4}-\d{2}-\d{2}\b",
    "money": r"[$€£]\s?\d[\d,.]*\d|[$€£]\s?\d|\b\d[\d,.]* (?:dollars|euros|pounds)\b",
    "percentage": r"\b\d+(?:\.\d+)?\s?(?:%|percent\b)",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]m)?\b",
}

_PLURALS = ((r"(?i)ies$", "y"), (r"(?i)(ss|us|is)$", "$1"), (r"(?i)(x|ch|sh|s)es$", "$1"), (r"(?i)s$", ""))


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, begin, end, text, lemma, pos) of each word; offsets are found by adding up what lies before."""
    parts = F.split(F.col(text), rf"(?<={TOKEN[:-1]})(?!{TOKEN[:-1]})|(?<!{TOKEN[:-1]})(?={TOKEN[:-1]})", -1)
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, q: n + F.length(q)))
    spans = F.filter(F.zip_with(parts, ends, lambda p, e: F.struct((e - F.length(p)).alias("begin"), e.alias("end"), p.alias("text"))), lambda x: x["text"].rlike(rf"^{TOKEN}$"))
    each = df.select(key, F.posexplode(spans).alias("i", "x")).select(key, "i", "x.begin", "x.end", "x.text")
    return each.withColumn("lemma", lemma(F.col("text"))).withColumn("pos", part_of_speech(F.col("text")))


def lemma(word: Column) -> Column:
    """Lower case, plural endings cut."""
    out = F.lower(word)
    return F.when(is_stop_word(word) | (F.length(word) <= 3), out).otherwise(F.coalesce(*[F.when(out.rlike(p), F.regexp_replace(out, p, r)) for p, r in _PLURALS], out))


def part_of_speech(word: Column) -> Column:
    """CD, WP, WRB, DT, IN, RB, VBD, VBG, NNP or NN, by form and short lists."""
    w = F.lower(word)
    return (
        F.when(word.rlike(r"^\p{N}+$"), "CD").when(w.isin("who", "whom", "what", "which"), "WP").when(w.isin("when", "where", "how", "why"), "WRB")
        .when(w.isin("the", "a", "an", "this", "that"), "DT").when(w.isin("of", "in", "on", "at", "by", "for", "with", "from", "to"), "IN").when(w.isin("is", "was", "are", "were", "did", "does", "do", "has", "had"), "VBD")
        .when(w.endswith("ly"), "RB").when(w.endswith("ing"), "VBG").when(w.endswith("ed"), "VBD").when(word.rlike(r"^\p{Lu}"), "NNP").otherwise("NN")
    )


def entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, text) of the entities that patterns find."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    found = F.concat(*[of(k, p) for k, p in ENTITY_PATTERNS.items()])
    return df.select(key, F.explode(found).alias("e")).select(key, "e.kind", "e.text")


def listed_entities(words: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, kind, text, begin, end) of listed names (name, kind) of one or more words in tokens: words join on the name's parts at their distance from its first."""
    parts = names.select("name", "kind", F.posexplode(F.split(F.lower("name"), " ")).alias("_j", "_w")).withColumn("_n", F.size(F.split("name", " ")))
    hits = words.withColumn("_w", F.lower("text")).join(parts, "_w")
    runs = hits.groupBy(key, "name", "kind", "_n", (F.col("i") - F.col("_j")).alias("_start")).agg(F.countDistinct("_j").alias("_got"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    return runs.filter("_got = _n").select(key, "kind", F.col("name").alias("text"), "begin", "end")


def governed(edges: DataFrame, through: str = "prep_of", depth: int = 6) -> DataFrame:
    """(qid, head, dep, rel): dependents of each token, those behind up to depth - 1 `through` edges counted as its own."""
    own = edges.select("qid", F.col("gov").alias("head"), "dep", "rel")
    behind = stages.closure(own.filter(F.col("rel") == through).select("qid", "head", F.col("dep").alias("_via")), "head", "_via", depth - 1, ["qid"])
    return own.unionByName(behind.join(own.withColumnRenamed("head", "_via"), ["qid", "_via"]).select("qid", "head", "dep", "rel")).distinct()


def covered(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of one text of which the second covers the first: inner's columns and outer's begin and end."""
    o = outer.select(key, F.col("begin").alias("outer_begin"), F.col("end").alias("outer_end"))
    return inner.join(o, key).filter("outer_begin <= begin AND end <= outer_end")
