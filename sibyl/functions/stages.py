"""Intermediate tables and closures that need no recursion."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where it is set; else a temporary one of a local master, or one in a cluster's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="stages-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n_rows: int, *keys: str, most: int = 250_000) -> DataFrame:
    """df dealt to tasks by keys, so many tasks that one has `most` of the n_rows on average: a task's memory stays, however many rows there are."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // most)), *keys)


def closure(edges: DataFrame, start: str, end: str, depth: int, keys: Sequence[str] = (), passing: str | None = None) -> DataFrame:
    """Edges' columns and `level`, the least number of edges from start to end, for all ends within `depth` edges; each pair once.

    Walks of up to k edges meet those of up to k, so a few joins reach any depth, whatever the number of walks. The other columns are of
    the walk's last edge. passing: a condition on a walk's last edge, without which the walk ends there.
    """
    own = [*keys, start]
    rest = [c for c in edges.columns if c not in own]
    walks = staged(edges.distinct().withColumn("level", F.lit(1)), "walks")
    for _ in range(math.ceil(math.log2(max(1, depth)))):
        first = (walks.filter(passing) if passing else walks).select(*own, F.col(end).alias("_meet"), F.col("level").alias("_first"))
        second = walks.select(*keys, F.col(start).alias("_meet"), *rest, F.col("level").alias("_second"))
        longer = first.join(second, [*keys, "_meet"]).select(*own, *rest, (F.col("_first") + F.col("_second")).alias("level"))
        every = walks.unionByName(longer).filter(F.col("level") <= depth)
        walks = staged(every.groupBy(*own, *rest).agg(F.min("level").alias("level")), "walks")
    return walks
