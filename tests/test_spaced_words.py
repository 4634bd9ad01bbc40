"""Words handed to tasks as one string are those of the array of words."""

from pyspark.sql import functions as F

from sibyl.functions import text as tx
from sibyl.operators import ranking, retrieval

TEXTS = ["", None, " ", "...", "One two", "  Über-naïve, 12½ İstanbul\t\nfin.", "a b c", "x", "ΣΑΣ ß 東京 é"]


def test_spaced_words_are_the_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = rows.select("t", tx.tokens(F.col("t")).alias("a"), tx.spaced_words(F.lower("t")).alias("b")).collect()
    assert all((r.b is None) == (r.a is None) and (r.b or "").split(" ") == (r.a or [""]) for r in got)


def test_one_string_a_document_goes_to_the_tasks(spark, monkeypatch):
    seen = []
    true = tx.spaced_words
    monkeypatch.setattr(ranking.tx, "spaced_words", lambda t: seen.append(1) or true(t))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x", 1.0, False), (1, "two", 2.0, False), (2, "東京", 1.0, False)], "qid long, term string, weight double, required boolean")
    found = {(r.qid, r.doc_id) for r in retrieval.ranked_search(asked, docs, 5).collect()}
    assert found == {(1, 4), (1, 7), (2, 8)} and seen
