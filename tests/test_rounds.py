"""Training over phases: a run that is stopped goes on without repeating a step, and learned forests rank better than none."""

import pytest
from pyspark.sql import functions as F

from sibyl.functions.manifest import Run, keep_last
from sibyl.operators import boosting
from sibyl.plans import answering, rounds

NAMES = "Ada Bob Cleo Dora Emil Fritz Gina Hugo".split()
PLACES = "Lund Bern Oslo Riga Kiel Graz Nice Bonn".split()


@pytest.fixture(scope="module")
def world(spark):
    docs = [(i, f"Village register number {i}. The painter {n} lives in {p} today. Visitors of {PLACES[i - 1]} like the painter.") for i, (n, p) in enumerate(zip(NAMES, PLACES, strict=True))]
    asked = [(i, f"Where lives the painter {n.lower()}?", p) for i, (n, p) in enumerate(zip(NAMES, PLACES, strict=True))]
    q = spark.createDataFrame(asked, "qid long, text string, answer_pattern string")
    return q.filter("qid < 5"), q.filter("qid >= 5"), spark.createDataFrame(docs, "doc_id long, text string")


OPTIONS = {"trees": 3, "leaves": 4, "least_split": 2, "least_leaf": 1}


def test_a_stopped_run_goes_on(spark, world, tmp_path, monkeypatch):
    train, test, docs = world
    folder = str(tmp_path / "runs" / "0001")
    real, calls = boosting.train, []

    def failing(rows, features, **options):
        calls.append(len(features))
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(rows, features, **options)

    monkeypatch.setattr(boosting, "train", failing)
    with pytest.raises(KeyboardInterrupt):
        rounds.train_and_evaluate(train, test, docs, folder, **OPTIONS)
    assert Run(spark, folder).steps() == ["answers", "answers1", "clues", "model", "questions", "scored", "settings"]
    with pytest.raises(ValueError, match="without a model"):
        rounds.trained_models(spark, folder)
    with pytest.raises(ValueError, match="other settings"):
        rounds.train_and_evaluate(train, test, docs, folder, **OPTIONS | {"trees": 4})
    spark.range(3).write.parquet(f"{folder}/tables/answers2-left-by-a-killed-run")
    gathered = []
    monkeypatch.setattr(answering, "found_answers", lambda *a, **k: gathered.append(1))
    out = rounds.train_and_evaluate(train, test, docs, folder, **OPTIONS)
    assert not gathered and len(calls) == 4  # one in the first run, the one that failed, two after it
    assert out["train"]["n"] == 5 and out["test"]["n"] == 3 and out["train"]["recall"] > 0.5 and 0 <= out["test"]["mrr"] <= 1
    assert not (tmp_path / "runs" / "0001" / "tables" / "answers2-left-by-a-killed-run").exists()
    assert rounds.train_and_evaluate(train, test, docs, folder, **OPTIONS) == out and len(calls) == 4
    monkeypatch.undo()
    models = rounds.trained_models(spark, folder)
    answers = answering.answer(test.select("qid", "text"), docs, top=50, models=models)
    again = Run(spark, folder).table("scored2", None).select("qid", "text", F.round("confidence", 6).alias("confidence")).join(test.select("qid"), "qid")
    assert {(r.qid, r.text, round(r.confidence, 6)) for r in answers.collect()} == {tuple(r) for r in again.collect()}
    with pytest.raises(ValueError, match="more than one question"):
        rounds.train_and_evaluate(train, train, docs, str(tmp_path / "runs" / "0002"), **OPTIONS)


def test_only_the_last_finished_runs_stay(spark, tmp_path):
    for i in range(5):
        run = Run(spark, str(tmp_path / f"{i:04d}"))
        assert run.value("a", lambda: {"x": [1, 2.5, None]}) == {"x": [1, 2.5, None]} == run.value("a", lambda: 1 / 0)
        if i != 1:
            run.value("evaluation", lambda: 1)
    assert keep_last(spark, str(tmp_path), 2) == ["0000", "0002"]
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["0001", "0003", "0004"]
    assert keep_last(spark, str(tmp_path / "none")) == []
