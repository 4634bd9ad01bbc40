"""Sharding by weighted rendezvous hashing.

Every (key, shard) pair gets a number in (0, 1) from the MD5 of "key:shard"; the shard with the highest
-weight / ln(number) takes the row. A new shard only takes the rows that it wins, so no row moves between old shards,
and each shard's share is its weight's share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Runs of rows by which slots are numbered: each (shard, run) is numbered by itself, then moved by the rows before it.
RUNS_PER_SHARD = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    # 52 bits of the digest, moved off 0 by half a step: as text the digest gives the same number in any engine.
    number = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((number + 0.5) / float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key over shards 0 to len(weights) - 1; a weight of 0 takes nothing. Equal scores: the lower shard. Null keys count as the text "null"."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one above 0, none below")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    tries = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return -(F.greatest(*tries) if len(tries) > 1 else tries[0])["shard"]


def shard(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """df with each row's shard in `column` (replaced where it exists). No shuffle; null keys all go to one fixed shard."""
    return df.withColumn(column, rendezvous(F.col(key), weights))


def numbered(df: DataFrame, group: str, key: str, order: Sequence[str], column: str = "slot") -> DataFrame:
    """df with a gapless number from 0 in each group, whatever the group's size.

    A group's rows are dealt over RUNS_PER_SHARD runs by a hash of the key and numbered in each; a run starts where
    the runs before it end. The counts that this takes are a row per group and run.
    """
    runs = df.withColumn("_run", F.pmod(F.xxhash64(F.col(key)), F.lit(RUNS_PER_SHARD)))
    counts = runs.groupBy(group, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_run").orderBy(*order)
    return runs.withColumn("_at", F.row_number().over(within) - 1).join(starts, [group, "_run"]).withColumn(column, (F.col("_at") + F.col("_start")).cast("long")).drop("_run", "_at", "_start")


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    size: UTF-8 bytes plus 1 (null text: 1). law is `key`: the id and the weights decide alone, so repeated rows and rows
    that share an id share a shard, each with a slot of its own. grown_shard: the shard after one more of weight 1 is added.
    Slots follow the hash run, then id, crc and size; rows equal in all of these are alike in the result. Null ids are one key. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), [*weights, 1.0]).alias("grown_shard"),
    )
    out = numbered(written(rows, "shards"), "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
