"""Mixing sources to target weights by Pareto order sampling.

A source's target words give each of its documents an expected number of copies: proportional to a power of its size, at most
`most`, and such that the expected words are the target. The whole part is certain; the rest is the document's inclusion probability
p. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the sample is the beginning of
that order whose words come nearest to what the certain copies leave open; its size is fixed in words, the unit of the targets. At last one document of
each source may be added or dropped, where that comes nearer. The random number comes from the document's id and text, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, n_words, written

#: Documents in a step of the ranking value, on average: running sums are taken by steps, so that no source is summed up in one task.
STEP_ROWS = 100_000
#: Seed of the random numbers.
SEED = 17
#: Power of the size to which expected copies are proportional: 0 gives all documents of a source the same, 1 nearly all words to long ones.
POWER = 0.5


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """_source, source_size, target from one row of (_source, source_size) per source.

    Weights repeat over the sources in code-point order, null last. The targets share `share` times all sizes by weight;
    none is above `most` times its source's size, and what is cut off goes to the others by weight, until none is above.
    This is one water level: sources are passed in order of (limit / weight), and the level is set by those not yet full.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.select("_source", "source_size", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).alias("_w"), (F.lit(float(most)) * F.col("source_size")).alias("_cap"))
    level = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    before, rest, everything = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("_cap").over(everything))
    rows = rows.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # the first source that the level of the rest does not fill, and all after it, stand at that level
    open_level = F.first(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")), ignorenulls=True).over(everything)
    return rows.withColumn("_open", open_level).select("_source", "source_size", F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_open") * F.col("_w"))).alias("target"))


def _running(df: DataFrame, keys: list[str], step: str, order: Sequence[str | Column], value: str, column: str) -> DataFrame:
    """df with the sum of value over the rows up to this one, in each of keys, by step and then order."""
    sums = df.groupBy(*keys, step).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col(step).alias("_step_"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    here = Window.partitionBy(*keys, step).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(step) == F.col("_step_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return df.withColumn("_here", F.sum(value).over(here)).join(starts, same).withColumn(column, F.col("_here") + F.col("_start")).drop("_here", "_start", "_step_", *[f"_{k}_" for k in keys])


def _levels(sized: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """_of, _level for each source: a document of weight w is expected least(most, _level * w) times. A null level: `most` times.

    sized has (_source, size, _w, _n): a row for each size. From the largest size down, sizes are full while the level of the rest would give them more than `most`.
    """
    order = Window.partitionBy("_source").orderBy(F.desc("size"))
    above, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    words, weighed = (F.col("_n") * F.col("size")).cast("decimal(38,0)"), F.col("_n").cast("decimal(20,0)") * F.col("size") * F.col("_w")
    rows = sized.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).select("_source", "size", "_w", "target", words.alias("_words"), weighed.cast("decimal(38,0)").alias("_weighed"))
    left = F.col("target") - most * F.coalesce(F.sum("_words").over(above), F.lit(0)).cast("double")
    rows = rows.withColumn("_rest", F.sum("_weighed").over(rest).cast("double")).withColumn("_level", F.when(F.col("_rest") > 0, left / F.col("_rest")))
    holds = F.col("_level") * F.col("_w") <= most
    return rows.groupBy(F.col("_source").alias("_of")).agg(F.max_by("_level", F.when(holds, F.col("size"))).alias("_level"))


def _key(id_col: str, text_col: str, seed: int) -> Column:
    """A hash of a row's id, text and the seed, as hex digits that any engine gives."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f":{seed}")))


def copies(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, size, _source, source_size, target, expected, copies of every row of docs, and `_key`, by which rows that share an id are told apart.

    size: words of the whole text (null: 0). expected and copies: how often the mix should take the document whole, and takes it; at most `most` (rounded up) times. Documents
    without words are not taken. Repeated rows are separate documents of one rank. An empty table gives no rows.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("_source"), _key(id_col, text_col, seed).alias("_key")), "mix")
    weight = F.floor(F.pow(F.col("size").cast("double"), F.lit(float(power))) * 1024).cast("long")
    sized = written(rows.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_n")), "mix-sizes").withColumn("_w", F.when(F.col("size") > 0, weight).otherwise(F.lit(0)))
    n_steps = max(64, -(-(sized.agg(F.sum("_n")).first()[0] or 0) // STEP_ROWS))
    targets = written(source_targets(sized.groupBy("_source").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size")), weights, share, most), "mix-targets").withColumnRenamed("_source", "_of")
    level = targets.join(_levels(sized, targets, most).withColumnRenamed("_of", "_level_of"), F.col("_of").eqNullSafe(F.col("_level_of"))).drop("_level_of")
    rows = rows.join(few(level), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("_level") * weight, F.lit(float(most))))).otherwise(0.0)).drop("_level")
    u = (F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = F.col("expected") - F.floor("expected")
    odds = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    # steps of the odds, folded into [0, 1), which keeps the order; documents that are certain, or out, are dealt over steps of their own
    step = F.coalesce(F.floor(odds / (1 + odds) * n_steps), n_steps + F.floor(u * n_steps)).cast("int")
    rows = rows.select("*", F.floor("expected").cast("long").alias("_whole"), odds.alias("_odds"), step.alias("_step")).withColumn("_try", F.when(F.col("_odds").isNotNull(), F.col("size")).otherwise(F.lit(0)))
    rows = written(_running(rows, ["_source"], "_step", ["_odds", "_key"], "_try", "_to"), "mix-order")
    gaps = rows.groupBy("_source").agg((F.max("target") - F.sum(F.col("_whole") * F.col("size"))).alias("_gap")).withColumnRenamed("_source", "_of")
    more = F.when((F.col("_try") > 0) & (F.col("_to") - F.col("_try") / 2 <= F.col("_gap")), F.lit(1)).otherwise(F.lit(0))
    rows = written(rows.join(few(gaps), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_more", more), "mix-sample")
    # the words still open (or too many) may be nearer to one document more (or less) than to none
    open_ = rows.groupBy("_source").agg((F.max("_gap") - F.sum(F.col("_more") * F.col("size"))).alias("_open")).withColumnRenamed("_source", "_of")
    tried = rows.filter("_try > 0").join(few(open_), F.col("_source").eqNullSafe(F.col("_of"))).filter((F.col("_more") == F.when(F.col("_open") < 0, 1).otherwise(0)) & (F.col("size") < 2 * F.abs("_open")))
    last = tried.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("_open")).alias("off"), "_key")).alias("_near")).select(F.col("_source").alias("_of"), F.col("_near._key").alias("_at"))
    rows = rows.join(few(last), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_at")), "left")
    changed = rows.filter("_at IS NOT NULL").join(few(open_.withColumnRenamed("_of", "_open_of")), F.col("_source").eqNullSafe(F.col("_open_of")))
    first = F.row_number().over(Window.partitionBy("_source", "_key").orderBy(F.when(F.col("_open") < 0, -F.col("_more")).otherwise(F.col("_more")))) == 1
    changed = changed.withColumn("_more", F.when(first, F.when(F.col("_open") < 0, 0).otherwise(1)).otherwise(F.col("_more")))
    names = ["doc_id", "size", "_source", "source_size", "target", "expected", (F.col("_whole") + F.col("_more")).alias("copies"), "_key"]
    return rows.filter("_at IS NULL").select(*names).unionByName(changed.select(*names))


def mix(docs: DataFrame, weights: Sequence[float], **options) -> DataFrame:
    """The mixed corpus: docs' columns, each document as often as it was taken. Rows that share id and text are dealt the copies of their group in turn."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = copies(docs, weights, **options).groupBy("doc_id", "_source", "_key").agg(F.sum("copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_rows"))
    taken = taken.select(F.col("doc_id").alias("__mix_id"), F.col("_source").alias("__mix_src"), F.col("_key").alias("__mix_hash"), "__mix_copies", "__mix_rows")
    source = options.get("source_col", "source")
    same = F.col(id_col).eqNullSafe(F.col("__mix_id")) & F.col(source).eqNullSafe(F.col("__mix_src")) & (_key(id_col, text_col, options.get("seed", SEED)) == F.col("__mix_hash"))
    turn = Window.partitionBy("__mix_id", "__mix_src", "__mix_hash").orderBy(F.lit(1))
    joined = docs.join(taken, same)
    alone = joined.filter("__mix_rows = 1").withColumn("__mix_own", F.col("__mix_copies"))
    shared = joined.filter("__mix_rows > 1").withColumn("__mix_own", F.floor(F.col("__mix_copies") / F.col("__mix_rows")) + F.when(F.row_number().over(turn) <= F.pmod(F.col("__mix_copies"), F.col("__mix_rows")), 1).otherwise(0))
    every = alone.unionByName(shared)
    return every.filter("__mix_own > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_own").cast("int")))).select(*[every[c] for c in docs.columns])


def mixed_words(docs: DataFrame, weights: Sequence[float], **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
    return copies(docs, weights, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
