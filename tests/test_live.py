"""The stream of live questions against the batch operators over the same events."""

import json

import pytest
from pyspark.sql import functions as F

from sibyl.streaming import lifecycle as lc
from sibyl.streaming import live

EMPTY = dict.fromkeys([c.split()[0] for c in live.EVENTS.split(", ")])


def at(hour):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def events():
    out = []
    for seq in range(120):
        q, base = seq % 7, {"qid": seq % 7, "seq": seq, "ts": at(seq / 10)}
        out.append(base | {"kind": "state", "text": lc.STATES[seq * 3 // 120]})
        out.append(base | {"kind": "answer", "text": f"t{seq % 5}", "confidence": seq / 100})
        out.append(base | {"kind": "source", "type": "web", "origin": f"o{seq % 2}", "title": "t", "url": None, "level": seq % 3})
        out.append(base | {"kind": "part", "origin": f"o{seq % 3}", "is_last": seq > 60, "expected": 3 if q < 5 else 4})
    # one question that is left alone early, a late part of another, and what is left out or has no text
    out += [{"qid": 50, "seq": 900, "ts": at(0), "kind": "part", "origin": "x", "is_last": False, "expected": 1}, {"qid": 50, "seq": 901, "ts": at(0.1), "kind": "answer", "text": None}]
    out += [{"qid": None, "seq": 1, "ts": at(1), "kind": "state", "text": "asked"}, {"qid": 3, "seq": None, "ts": at(1), "kind": "answer", "text": "lost"}, {"qid": 51, "seq": 5, "ts": at(11), "kind": "other"}]
    return [EMPTY | e for e in out]


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame([tuple(e.values()) for e in events()], live.EVENTS)
    return rows, live.replay(rows, 3, late="1 hour", patience=7200).cache()


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_replay_is_as_the_batch(tables):
    rows, changes = tables
    rows = rows.filter("qid < 50 AND seq IS NOT NULL")
    got = live.questions(changes).filter("qid < 50")
    assert same(got.select("qid", "state", "seq", "n_events"), lc.last_states(rows.filter("kind = 'state'").select("qid", "seq", F.col("text").alias("state"))).select("qid", "state", "seq", "n_events"))
    want = lc.current_answers(rows.filter("kind = 'answer'"))
    assert same(live.answers(changes).join(got.select("qid", "generation"), "qid"), want.select("qid", "text", "confidence", "seq", "generation"))
    used = lc.source_registry(rows.filter("kind = 'source'").select("qid", "seq", "type", "origin", "title", F.coalesce("url", F.lit("")).alias("url"), F.col("level").alias("state")))
    assert same(live.sources(changes), used.select("qid", "type", "origin", "title", "url", "first", "state"))


def test_barrier_and_timers(tables):
    rows, changes = tables
    parts = rows.filter("kind = 'part' AND qid < 50")
    done = {r.qid for r in lc.completed(parts, parts.select("qid", "expected").distinct()).collect()}
    status = {r.qid: r.status for r in live.questions(changes).collect()}
    assert done == {0, 1, 2, 3, 4} == {q for q, s in status.items() if s == "complete"}
    assert status == dict.fromkeys(range(5), "complete") | {5: "open", 6: "open", 50: "expired", 51: "open"}


def test_read_one(tables):
    _, changes = tables
    one = json.loads(live.read_one(changes, 2).first().json)
    assert one["state"] == "answered" and [a["confidence"] for a in one["answers"]] == sorted((a["confidence"] for a in one["answers"]), reverse=True) and len(one["sources"]) == 2
    assert json.loads(live.read_one(changes, 50).first().json)["generation"] == 1
    assert live.read_one(changes, 999).isEmpty()


def test_empty(spark):
    assert live.questions(live.replay(spark.createDataFrame([], live.EVENTS), 1)).isEmpty()


class Store:
    """A state variable that counts its calls."""

    calls = 0

    def __init__(self):
        self.kept = {}

    def _count(self):
        Store.calls += 1
        return self.kept

    def get(self):
        return self._count().get(())

    def update(self, v):
        self._count()[()] = v

    def exists(self):
        return () in self._count()

    def getValue(self, k):
        return self._count().get(k)

    def updateValue(self, k, v):
        self._count()[k] = v

    def containsKey(self, k):
        return k in self._count()


class Handle:
    getValueState = getMapState = lambda self, *_: Store()
    registerTimer = deleteTimer = lambda self, _: None


def test_calls_do_not_grow_with_events():
    """A batch's calls of the store are as many as the entries that it touches, however many events touch them."""
    from pyspark.sql import Row

    def once(n):
        Store.calls = 0
        life = live.Life(1000)
        life.init(Handle())
        rows = [EMPTY | {"qid": 1, "seq": i, "ts": at(0), "kind": "part", "origin": f"o{i % 2}", "is_last": True, "expected": 2} for i in range(n)]
        rows += [EMPTY | {"qid": 1, "seq": n + i, "ts": at(0), "kind": "answer", "text": "a", "confidence": 0.5} for i in range(n)]
        out = list(life.handleInputRows((1,), iter([Row(**r) for r in rows]), None))
        assert [r.status for r in out] == ["complete"] * 2 and out[0].generation == n and out[1].seq == 2 * n - 1
        return Store.calls

    assert once(2) == once(40) <= 4
