"""Questions that are being answered: a stream that keeps the answers, sources and arrived origins of each, and writes only what changes.

The state of a question is a head row, which holds its few origins too, and two keyed maps in the state store, so an event costs the entries that it touches, however
many answers the question has. Each batch of changes is a folder of its own that a repeated batch overwrites, so a restart neither loses nor doubles any. Readers take the newest version
of each entry.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What an event may hold. kind: state (text), answer (text, confidence), source (type, origin, title, url, level), part (origin, is_last, expected).
EVENTS = "qid long, seq long, ts timestamp, kind string, text string, confidence double, type string, origin string, title string, url string, level int, is_last boolean, expected int"
CHANGES = (
    "qid long, version long, entry string, text string, confidence double, seq long, type string, origin string, title string, url string, level int, "
    "state string, n_events long, generation long, status string"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_NAMES = [c.split()[0] for c in CHANGES.split(", ")]
_CHANGE = Row(*_NAMES)


class Life(StatefulProcessor):
    """One question's state. patience_ms: a question that hears nothing for so long, by event time, before all its origins arrived, is expired; a later event opens it again."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "state string, seq long, n_events long, generation long, expected int, arrived array<string>, status string, version long, last_ms long, timer long")
        self.answers = handle.getMapState("answers", "text string", "confidence double, seq long")
        self.sources = handle.getMapState("sources", "type string, origin string, title string, url string", "seq long, level int")

    def _head(self) -> dict:
        names = ("state", "seq", "n_events", "generation", "expected", "arrived", "status", "version", "last_ms", "timer")
        empty = (None, None, 0, 0, None, [], "open", 0, 0, None)
        return dict(zip(names, self.head.get() or empty, strict=True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """Each entry that the rows touch is read and written once, as every call of the store goes to another process."""
        h = self._head()
        answers, sources = {}, {}
        for r in rows:
            self._take(h, r, answers, sources)
        h["version"] += 1
        h["status"] = "complete" if h["expected"] is not None and len(h["arrived"]) >= h["expected"] else "open"
        timer = h["last_ms"] + self.patience_ms if h["status"] == "open" else None
        if timer != h["timer"]:
            if h["timer"] is not None:
                self.handle.deleteTimer(h["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            h["timer"] = timer
        for k, v in answers.items():
            self.answers.updateValue((k,), v)
        for k, v in sources.items():
            self.sources.updateValue(k, v)
        self.head.update(tuple(h.values()))
        yield self._row(key, h, "question")
        for t, (c, s) in answers.items():
            yield self._row(key, h, "answer", text=t, confidence=c, seq=s)
        for k, (s, n) in sources.items():
            yield self._row(key, h, "source", **dict(zip(("type", "origin", "title", "url"), k, strict=True)), seq=s, level=n)

    def _take(self, h: dict, event: Row, answers: dict, sources: dict) -> None:
        """One event, in the order of EVENTS."""
        _, seq, ts, kind, text, confidence, type_, origin, title, url, level, is_last, expected = event
        if ts is not None:
            h["last_ms"] = max(h["last_ms"], int(ts.timestamp() * 1_000_000) // 1000)
        if kind == "state":
            h["n_events"] += 1
            if h["seq"] is None or seq > h["seq"]:
                h["state"], h["seq"] = text, seq
        elif kind == "answer":
            h["generation"] += 1
            if text is not None:
                old = answers[text] if text in answers else self.answers.getValue((text,))
                if old is None or seq > old[1]:
                    answers[text] = (None if confidence is None or math.isnan(confidence) else confidence, seq)
                elif text not in answers:
                    answers[text] = tuple(old)
        elif kind == "source":
            k = tuple(c or "" for c in (type_, origin, title, url))
            old = sources[k] if k in sources else self.sources.getValue(k) or (seq, 0)
            sources[k] = (min(old[0], seq), max(old[1], level or 0))
        elif kind == "part":
            if expected is not None:
                h["expected"] = expected
            if is_last and (origin or "") not in h["arrived"]:
                h["arrived"] = [*h["arrived"], origin or ""]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        h = self._head()
        if h["status"] == "open" and h["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            h["status"], h["timer"], h["version"] = "expired", None, h["version"] + 1
            self.head.update(tuple(h.values()))
            yield self._row(key, h, "question")

    def _row(self, key, h: dict, entry: str, **more) -> Row:
        all_ = {"qid": key[0], "version": h["version"], "entry": entry, "seq": h["seq"], "state": h["state"], "n_events": h["n_events"], "generation": h["generation"], "status": h["status"]} | more
        return _CHANGE(*[all_.get(n) for n in _NAMES])

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "1 hour", patience: float = 3600.0) -> DataFrame:
    """The stream of changes of a stream of events (columns of EVENTS). Events without qid or seq are left out, as are those `late` after the newest one and
    answers without text (they count as updates); of events of one number in a question the first to come stays. patience: seconds."""
    own = events.select(*[c.split()[0] for c in EVENTS.split(", ")]).filter("qid IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", late)
    return own.groupBy("qid").transformWithState(Life(int(patience * 1000)), CHANGES, "Update", "EventTime")


def run(events: DataFrame, folder: str, checkpoint: str, late: str = "1 hour", patience: float = 3600.0, once: bool = True) -> StreamingQuery:
    """Starts the stream; changes go to a folder for each batch. once: it ends when what is there is read, and goes on from there at the next start."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the running query keeps the settings of its start
    try:
        writer = changes(events, late, patience).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"))
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def replay(events: DataFrame, batches: int, late: str = "1 hour", patience: float = 3600.0) -> DataFrame:
    """The changes of a table of events that arrives in as many batches, by event time; the stream is started anew for each, from its checkpoint."""
    spark = events.sparkSession
    place = stages.new_folder(spark, "live")
    ends = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    step = ((ends.b or 0) - (ends.a or 0)) // batches + 1
    for i in range(batches):
        part = events.filter(F.coalesce((F.unix_micros("ts") - (ends.a or 0)).cast("long") >= i * step, F.lit(i == 0)) & F.coalesce(F.unix_micros("ts") - (ends.a or 0) < (i + 1) * step, F.lit(i == 0)))
        part.write.mode("append").parquet(f"{place}/in")
        query = run(spark.readStream.schema(EVENTS).parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint", late, patience)
        query.awaitTermination()
    return read(spark, f"{place}/out")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All changes that were written."""
    return spark.read.schema(CHANGES + ", batch long").parquet(folder).drop("batch")


def questions(changes_: DataFrame) -> DataFrame:
    """The newest head of each question: qid, state, seq, n_events, generation, status (open, complete, expired)."""
    head = F.max_by(F.struct("state", "seq", "n_events", "generation", "status"), "version")
    return changes_.filter("entry = 'question'").groupBy("qid").agg(head.alias("h")).select("qid", "h.*")


def answers(changes_: DataFrame) -> DataFrame:
    """qid, text, confidence, seq: the newest version of each answer."""
    return changes_.filter("entry = 'answer'").groupBy("qid", "text").agg(F.max_by(F.struct("confidence", "seq"), "version").alias("x")).select("qid", "text", "x.*")


def sources(changes_: DataFrame) -> DataFrame:
    """qid, type, origin, title, url, first, state: the newest version of each source."""
    keys = ("qid", "type", "origin", "title", "url")
    newest = changes_.filter("entry = 'source'").groupBy(*keys).agg(F.max_by(F.struct(F.col("seq").alias("first"), F.col("level").alias("state")), "version").alias("x"))
    return newest.select(*keys, "x.*")


def read_one(changes_: DataFrame, qid: int) -> DataFrame:
    """(qid, json) of a question with its answers, best first, and its sources in order of first use; no row, if there is no such question."""
    own = changes_.filter(F.col("qid") == qid)
    by_score = F.transform(F.sort_array(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("o"), "text", "confidence", "seq"))), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["seq"].alias("seq")))
    found = answers(own).groupBy("qid").agg(by_score.alias("answers"))
    used = sources(own).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("first", "type", "origin", "title", "url", "state"))).alias("sources"))
    return questions(own).join(found, "qid", "left").join(used, "qid", "left").select("qid", F.to_json(F.struct("*")).alias("json"))
