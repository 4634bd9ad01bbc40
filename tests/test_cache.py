"""Saves of one query replace each other, and only finished versions are read."""

import pytest

from sibyl.sources.cache import ResultCache

KIND = "query string, title string, description string, url string, rank int"


@pytest.fixture
def store(spark, tmp_path):
    return ResultCache(spark, f"file://{tmp_path}")


def rows(spark, *r):
    return spark.createDataFrame(list(r), KIND)


def test_a_query_saved_twice_has_one_result(spark, store):
    assert store.load().isEmpty() and store.versions() == []
    one = store.save(rows(spark, ("q", "t1", "d", "u1", 1), ("q", "t2", "d", "u2", 2), ("r", "t3", None, "u3", 1)))
    store.save(rows(spark, ("q", "t1", "d", "u1", 1), ("q", "new", "d", "u9", 2)))
    got = {(r.query, r["rank"]): (r.title, r.resultRR) for r in store.load().collect()}
    assert got == {("q", 1): ("t1", 1.0), ("q", 2): ("new", 0.5), ("r", 1): ("t3", 1.0)}
    assert {r.title for r in store.load(upto=one).collect()} == {"t1", "t2", "t3"}
    asked = spark.createDataFrame([("q",), ("q",), ("none",), (None,)], "query string")
    assert [r.title for r in store.load(asked, k=1).collect()] == ["t1"]


def test_unfinished_versions_are_not_seen(spark, store):
    store.save(rows(spark, ("q", "t", "d", "u", 1)))
    rows(spark, ("q", "half", "d", "u", 1)).selectExpr("query", "rank", "title", "description", "url", "0 AS bucket").write.partitionBy("bucket").parquet(f"{store.folder}/rows/version=000000000009-x")
    assert [r.title for r in store.load().collect()] == ["t"]


def test_any_rows(spark, store):
    store.save(rows(spark))
    assert store.load().isEmpty() and len(store.versions()) == 1
    store.save(rows(spark, (None, "t", "d", "u", 1), ("q", "t", "d", "u", None), ("q", "b", "d", "u2", 1), ("q", "a", None, "u1", 1), ("", None, None, None, 1)).selectExpr("*", "1 AS version", "'x' AS bucket"))
    assert sorted((r.query, r.title or "") for r in store.load().collect()) == [("", ""), ("q", "a")]
