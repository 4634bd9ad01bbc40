"""Searches whose documents are scored where they lie: the same rows as by joins, and nothing shuffled by document."""

import pytest

from sibyl.operators import index, retrieval

DOCS = [(i, t) for i, t in enumerate(["red fox", "red fox", "fox fox den", "red", "den den red fox", None, "", "red fox", "blue"] * 3)]
ASKED = [(1, "red", 1.0, True), (1, "fox", 2.0, False), (2, "den", 1.5, False), (2, "red", 0.5, False), (3, "none", 1.0, True), (3, "red", 1.0, False), (4, "blue", 1.0, False)]


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), spark.createDataFrame(ASKED, "qid long, term string, weight double, required boolean")


@pytest.mark.parametrize("n", [1, 2, 7, None])
@pytest.mark.parametrize("kept", [False, True])
def test_search_in_tasks(spark, tables, tmp_path, n, kept):
    docs, asked = tables
    own = index.build(docs, str(tmp_path / "index")) if kept else docs
    got = retrieval.ranked_search(asked, own, n)
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(retrieval.ranked_search(asked, docs, n, most=0)) and got.count()


def test_keys_that_repeat(spark, tables):
    docs = spark.createDataFrame([(1, "red fox"), (1, "fox den"), (2, "red"), (None, "fox")], "doc_id long, text string")
    assert rows(retrieval.ranked_search(tables[1], docs, 3)) == rows(retrieval.ranked_search(tables[1], docs, 3, most=0))


def test_text_keys(spark, tables, tmp_path):
    docs = tables[0].selectExpr("concat('d', doc_id) AS page", "text")
    want = rows(retrieval.ranked_search(tables[1], docs, 2, key="page", most=0))
    assert rows(retrieval.ranked_search(tables[1], docs, 2, key="page")) == want
    assert rows(retrieval.ranked_search(tables[1], index.build(docs, str(tmp_path / "index"), key="page"), 2, key="page")) == want


@pytest.mark.parametrize("kept", [False, True])
def test_evidence_in_tasks(spark, tables, tmp_path, kept):
    docs, asked = tables
    answers = spark.createDataFrame([(1, "Fox"), (1, "den"), (2, "red"), (3, "red"), (5, "fox"), (4, "nowhere")], "qid long, text string")
    own = index.build(docs, str(tmp_path / "index")) if kept else docs
    got = retrieval.evidence(answers, own, asked)
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(retrieval.evidence(answers, docs, asked, most=0))
