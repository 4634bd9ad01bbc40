"""Passages over all documents: their scores, the gold pattern, runs of capitalised words, and plans that don't shuffle by question."""

from pyspark.sql import functions as F

from sibyl.functions import text as tx
from sibyl.operators import candidates as cd


def test_gold_pattern_matches_letters_beyond_ascii_in_any_case(spark):
    rows = spark.createDataFrame([("1", "Ñjaosñ came", "ñjaosñ"), ("1", "es", "É|x"), ("1", "école", "École")], "qid string, sentence string, answer_pattern string")
    assert [r.hit for r in rows.select(tx.gold_match(F.col("sentence"), F.col("answer_pattern")).alias("hit")).collect()] == [True, False, True]
    said = cd.gold_mentions(rows.select("qid", "sentence").limit(1), spark.createDataFrame([("1", "ñjaosñ")], "qid string, answer_pattern string"), ["qid"])
    assert [r.mention for r in said.collect()] == ["Ñjaosñ"]


def test_clues_sent_to_tasks_and_clues_joined_give_the_same_passages(spark, monkeypatch):
    from sibyl.operators import passages as ps

    docs = spark.createDataFrame([(1, "red fox", "Red fox runs. The fox and the dog! A red Red dog? No"), (2, "dog", "A dog. A fox. The red dog sees Red Dog"), (3, None, None), (4, "x", ""), (None, "fox", "A fox. Red")], "doc_id long, title string, text string")
    clues = spark.createDataFrame([(7, "fox", 3.0), (7, "red", 3.0), (8, "dog", 3.0), (8, "fox", 1.0), (9, "nowhere", 9.0)], "qid long, label string, weight double")
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    for k in (None, 1, 2):
        for each in (None, cd.capitalised_spans, lambda sentence: sentence):
            got = rows(ps.scored(docs, clues, k, each))
            filled = docs.filter("doc_id IS NOT NULL")
            assert rows(ps.scored(filled, clues, k, each)) == rows(ps.scored(filled, clues, k, each, most=2)) and len(got) > len(rows(ps.scored(filled, clues, k, each)))
    matched = ps.vectors(ps.word_matches(ps.sentences(docs), clues), ps.about_clues(docs, clues)).withColumn("score", ps.score())
    plain = rows(ps.best(matched, 2))
    assert rows(ps.scored(docs, clues, 2)) == plain
    monkeypatch.setattr(ps, "PAIRS", 1)
    assert rows(ps.scored(docs, clues, 2)) == plain
    assert ps.scored(docs, clues.limit(0), 2).count() == 0
    plan = ps.scored(docs, clues, 2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_runs_of_capitals_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "The Old Man met Élan of Rome"), (2, "none"), (3, ""), (4, None), (5, "New York")], "k long, sentence string")
    runs = cd.capitalised_runs(rows, ["k"])
    assert [tuple(r) for r in runs.collect()] == [(1, 0, 2, "The Old Man"), (1, 4, 4, "Élan"), (1, 6, 6, "Rome"), (5, 0, 1, "New York")]
    assert "Exchange" not in runs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
