"""A store of web results by query and rank, of which later saves replace what earlier ones hold.

Each save is a version: rows in a folder of its own, dealt into directories by the query's bucket, and an empty marker that is made when they are all there. Readers
list the markers first and read nothing else, so a version is seen whole or not at all. Rows are never rewritten; the newest version of each
(query, rank) counts. Versions of writers that ran at the same time have one number and are told apart by name, alike for all readers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
_ROWS = "query string, rank int, title string, description string, url string, version string, bucket int"


def _bucket(query: Column) -> Column:
    return F.pmod(F.xxhash64(query), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class ResultCache:
    """The store in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the finished versions, oldest first."""
        path, fs = self._hadoop("versions")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def save(self, results: DataFrame) -> str:
        """Saves results (query, title, description, url, rank) and gives the version's name. Rows without query or rank are left out; of rows of one query and rank
        the first by url, title and description stays. No rows make an empty version."""
        last = max((int(v.split("-")[0]) for v in self.versions()), default=0)
        name = f"{last + 1:012d}-{uuid.uuid4().hex}"
        rest = F.struct("url", "title", "description")
        rows = results.filter("query IS NOT NULL AND rank IS NOT NULL").groupBy("query", F.col("rank").cast("int").alias("rank")).agg(F.min(rest).alias("x")).select("query", "rank", "x.title", "x.description", "x.url")
        rows.withColumn("bucket", _bucket(F.col("query"))).repartition("bucket", "query").write.partitionBy("bucket").parquet(f"{self.folder}/rows/version={name}")
        path, fs = self._hadoop(f"versions/{name}")
        fs.create(path, False).close()
        return name

    def _rows(self, buckets: list[int] | None = None, upto: str | None = None) -> DataFrame:
        names = [v for v in self.versions() if upto is None or v <= upto]
        if not names:
            return self.spark.createDataFrame([], _ROWS)
        read = self.spark.read.schema(_ROWS).option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/version={v}" for v in names])
        return read if buckets is None else read.filter(F.col("bucket").isin(buckets))

    def load(self, queries: DataFrame | None = None, k: int = 6, upto: str | None = None) -> DataFrame:
        """(query, rank, title, description, url, resultRR) of ranks up to k of the asked queries (column query), or of all; upto: as it was after that version.
        Only the directories of the asked queries' buckets are read."""
        asked = None if queries is None else queries.select("query").distinct()
        buckets = None if asked is None else sorted(r[0] for r in asked.select(_bucket(F.col("query"))).distinct().na.drop().collect())  # at most BUCKETS
        rows = self._rows(buckets, upto).filter(F.col("rank") <= k)
        rows = rows if asked is None else rows.join(asked, "query", "left_semi")
        newest = rows.groupBy("query", "rank").agg(F.max_by(F.struct("title", "description", "url"), "version").alias("x"))
        return newest.select("query", "rank", "x.*", (1 / F.col("rank")).alias("resultRR"))
