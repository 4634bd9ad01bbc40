"""Answer hitlists: vector merge, merge by text, overlay, top-k, evidence diffusion, statistics.

A hitlist has a row per question and answer; a feature that is not set is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand between two parts of an answer, as a pattern.
BOUNDARY = r"\s*[.,:;()–-]\s*"
CASES = ("prefixed", "prefixing", "suffixed", "suffixing", "substred", "substring")


def merged(feature: str) -> Column:
    """Merge of one feature over a group's rows: the greatest value; a negative one holds only if every row has the feature set."""
    most = F.max(feature)
    return F.when((most >= 0) | (F.count(feature) == F.count(F.lit(1))), most).alias(feature)


def merge_vectors(rows: DataFrame, keys: Sequence[str], features: Sequence[str], counts: Sequence[str] = ("occurences",), more: Sequence[Column] = ()) -> DataFrame:
    """One row for each key: features merged, counts added up. Partial sums are formed before the shuffle."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], *[merged(f) for f in features], *more)


def merge_hitlist(rows: DataFrame, features: Sequence[str], origins: Sequence[str] = (), keys: Sequence[str] = ("qid", "text"), more: Sequence[Column] = ()) -> DataFrame:
    """Merges answers of equal text; originMultiple is 1 if more than one origin flag adds up."""
    out = merge_vectors(rows, keys, features, more=more)
    if not origins:
        return out
    total = sum((F.coalesce(F.col(o), F.lit(0.0)) for o in origins), F.lit(0.0))
    return out.withColumn("originMultiple", F.when(total > 1, F.lit(1.0)))


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """old with the rows of new put in or over rows of the same key."""
    a, b = old.withColumn("_old", F.lit(1)).alias("a"), new.withColumn("_new", F.lit(1)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    return joined.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[F.when(F.col("b._new") == 1, F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values])


def ranked(rows: DataFrame, group: Sequence[str] = ("qid",), order: Sequence[str | Column] | None = None, column: str = "rank") -> DataFrame:
    """Ranks from 1 by falling confidence, then text."""
    return rows.withColumn(column, F.row_number().over(Window.partitionBy(*group).orderBy(*(order or [F.desc("confidence"), F.asc("text")]))))


def top_k(rows: DataFrame, k: int, **options) -> DataFrame:
    """The k best rows of each question; the limit is applied before the shuffle as well as after it."""
    return ranked(rows, **options).filter(F.col("rank") <= k).drop("rank")


def merge_by_canonical_text(rows: DataFrame, canon: Column, features: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """Answers whose canonical text is equal become one: the best-ranked text stays, vectors merge."""
    r = ranked(rows.withColumn("canon_text", canon), order=order, column="_rank")
    return merge_vectors(r, ["qid", "canon_text"], features, more=[F.min_by("text", "_rank").alias("text"), F.max("confidence").alias("confidence")])


def _case(text: Column, other: Column, boundary: str) -> Column:
    """Which way `other` is a part of text, or text a part of it; the first case that holds counts.

    Beginnings and ends are compared as strings, so that only the innermost case needs a pattern made of the text.
    """
    def starts(whole: Column, part: Column) -> Column:
        return whole.startswith(part) & F.substring(whole, F.length(part) + 1, F.length(whole)).rlike(f"^{boundary}")

    def ends(whole: Column, part: Column) -> Column:
        return whole.endswith(part) & F.substring(whole, F.lit(1), F.length(whole) - F.length(part)).rlike(f"{boundary}$")

    def inside(whole: Column, part: Column) -> Column:
        return F.contains(whole, part) & F.regexp_like(whole, F.concat(F.lit(boundary + r"\Q"), part, F.lit(r"\E" + boundary)))

    return (
        F.when(starts(text, other), "prefixed").when(starts(other, text), "prefixing")
        .when(ends(text, other), "suffixed").when(ends(other, text), "suffixing")
        .when(inside(text, other), "substred").when(inside(other, text), "substring")
    )


def overlaps(rows: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Pairs of answers of one question of which one is a part of the other: qid, text, other, confidence of the other, case."""
    # a question's answers meet inside its hitlist: they are shuffled once, by question, and their pairs grouped where they are
    answer = F.struct(F.octet_length("text").alias("n"), "text", "confidence")
    held = rows.filter("qid IS NOT NULL AND text IS NOT NULL").groupBy("qid").agg(F.collect_list(answer).alias("_all"))
    each = held.select("qid", "_all", F.explode("_all").alias("_x"))
    # containment is a cheap test that saves most of the patterns; what is contained is shorter, so each two answers are tested once
    x = F.col("_x")
    shorter = each.select("qid", "_x", F.explode(F.filter("_all", lambda y: (y["n"] < x["n"]) & F.contains(x["text"], y["text"]))).alias("_y"))
    pair = lambda a, b: F.struct(F.col(f"{a}.text").alias("text"), F.col(f"{b}.text").alias("other"), F.col(f"{b}.confidence").alias("other_confidence"))
    pairs = shorter.select("qid", F.explode(F.array(pair("_x", "_y"), pair("_y", "_x"))).alias("_p")).select("qid", "_p.*")
    return pairs.withColumn("case", _case(F.col("text"), F.col("other"), boundary)).filter(F.col("case").isNotNull())


def diffuse(rows: DataFrame, policy: str = "decay", all_cases: bool = False) -> DataFrame:
    """Evidence from overlapping answers: qid, text, and a score for each case.

    Policies: sum; decay, by which the i-th best is worth 1 / 2^i of its confidence; max. Unless all_cases, prefixing and suffixed overlaps are left out.
    """
    pairs = overlaps(rows)
    if not all_cases:
        pairs = pairs.filter(~F.col("case").isin("prefixing", "suffixed"))
    w = Window.partitionBy("qid", "text", "case").orderBy(F.desc("other_confidence"), F.asc("other"))
    worth = pairs.withColumn("_i", F.row_number().over(w) - 1)
    value = {"sum": F.sum("other_confidence"), "max": F.max("other_confidence"), "decay": F.sum(F.col("other_confidence") / F.pow(F.lit(2.0), F.col("_i")))}[policy]
    return worth.groupBy("qid", "text", "case").agg(value.alias("score"))


def with_statistics(rows: DataFrame, features: Sequence[str], group: Sequence[str] = ("qid",)) -> DataFrame:
    """Mean and population deviation of each feature over its hitlist, a feature that is not set counting as 0."""
    w = Window.partitionBy(*group)
    out = rows
    for f in features:
        v = F.coalesce(F.col(f), F.lit(0.0))
        out = out.withColumn(f"{f}_mean", F.avg(v).over(w)).withColumn(f"{f}_sd", F.stddev_pop(v).over(w))
    return out


def expanded(rows: DataFrame, features: Sequence[str], group: Sequence[str] = ("qid",)) -> DataFrame:
    """Three columns for each feature: @ its value, % its z-score in the hitlist (0 where all are equal), ! 1 if it is not set."""
    out = with_statistics(rows, features, group)
    made = []
    for f in features:
        v = F.coalesce(F.col(f), F.lit(0.0))
        made += [v.alias(f"@{f}"), F.when(F.col(f"{f}_sd") == 0, 0.0).otherwise((v - F.col(f"{f}_mean")) / F.col(f"{f}_sd")).alias(f"%{f}"), F.when(F.col(f).isNull(), 1.0).otherwise(0.0).alias(f"!{f}")]
    return out.select(*rows.columns, *made)
