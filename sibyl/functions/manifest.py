"""A manifest of finished steps: a run that was stopped goes on where it was, and only the last runs are kept.

A step writes its result under a name of its own attempt, and then its marker, which names that attempt. Readers go by markers alone, so a step
counts as a whole or not at all, whatever a killed run left behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _file(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _file(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


@dataclass(frozen=True)
class Run:
    """One run's folder, which driver and executors share."""

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> str | None:
        path, fs = _file(self.spark, f"{self.folder}/done/{name}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _mark(self, name: str, text: str) -> None:
        """A marker appears by renaming, whole, and is never replaced: of two runs that finish one step at a time, the first counts."""
        mine, fs = _file(self.spark, f"{self.folder}/tmp-{uuid.uuid4().hex}")
        stream = fs.create(mine, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        path, _ = _file(self.spark, f"{self.folder}/done/{name}")
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(mine, path):
            fs.delete(mine, False)

    def steps(self) -> list[str]:
        """Names of the finished steps."""
        return _names(self.spark, f"{self.folder}/done")

    def settle(self, settings: Mapping) -> None:
        """Binds the run to its settings. A run that was begun with others can't go on."""
        text = json.dumps(settings, sort_keys=True)
        if (before := self.value("settings", lambda: text)) != text:
            raise ValueError(f"{self.folder} was begun with other settings: {before}")

    def value(self, name: str, make: Callable[[], object]):
        """A step whose result is a small value that JSON can hold."""
        if (text := self._read(name)) is None:
            self._mark(name, json.dumps(make()))
            text = self._read(name)
        return json.loads(text)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step whose result is a table."""
        if (text := self._read(name)) is None:
            df, path = make(), f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/tables/{path}")
            self._mark(name, json.dumps({"path": path, "schema": df.schema.jsonValue()}))
            text = self._read(name)
        from pyspark.sql.types import StructType

        noted = json.loads(text)
        return self.spark.read.schema(StructType.fromJson(noted["schema"])).parquet(f"{self.folder}/tables/{noted['path']}")

    def sweep(self) -> None:
        """Deletes tables of attempts that never finished. Only for when no other run works in this folder."""
        kept = {json.loads(text)["path"] for n in self.steps() if '"schema"' in (text := self._read(n)) and text.startswith('{"path"')}
        for name in _names(self.spark, f"{self.folder}/tables"):
            if name not in kept:
                path, fs = _file(self.spark, f"{self.folder}/tables/{name}")
                fs.delete(path, True)


def keep_last(spark: SparkSession, folder: str, n: int = 20, last_step: str = "evaluation") -> list[str]:
    """Deletes finished runs in a folder but the n newest by name, and gives the names of the deleted. Runs that have not finished stay."""
    finished = [r for r in _names(spark, folder) if last_step in Run(spark, f"{folder}/{r}").steps()]
    gone = finished[: max(0, len(finished) - n)]
    for r in gone:
        path, fs = _file(spark, f"{folder}/{r}")
        fs.delete(path, True)
    return gone
