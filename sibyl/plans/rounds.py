"""Training and evaluating over the three phases: each phase's answers are gathered, its forest is learned, and its scores feed the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.manifest import Run
from ..operators import boosting
from ..operators import evaluation as ev
from ..operators import hitlist as hl
from ..operators import scoring as sc
from . import answering

PHASES = ("", "1", "2")
_NOT_FEATURES = ("qid", "text", "occurences", "confidence")


def features_of(rows: DataFrame) -> list[str]:
    """The features of a table of answers: its numbers but for what identifies or scores an answer."""
    return [c for c, kind in rows.dtypes if kind in ("double", "int", "bigint") and c not in _NOT_FEATURES]


def learned(rows: DataFrame, gold: DataFrame, **options) -> dict:
    """A forest over the answers of the questions in gold (qid, answer_pattern): what its question's pattern finds is right. With the plain names of its features."""
    features = features_of(rows)
    hit = tx.gold_match(F.col("text"), F.col("answer_pattern"))
    known = hl.expanded(rows.join(gold.select("qid", "answer_pattern"), "qid"), features).withColumn("class", hit.cast("int"))
    model, losses = boosting.train(known, [m + f for f in features for m in "@%!"], **options)
    return {"features": features, "model": model, "losses": losses}


def models_of(parts: dict[str, dict]) -> answering.Models:
    """The plan's models from those of the phases."""
    return answering.Models({p: parts[p]["features"] for p in parts}, {p: (lambda m=parts[p]["model"]: sc.forest_score(m)) for p in parts})


def train_and_evaluate(train: DataFrame, test: DataFrame, docs: DataFrame, folder: str, graph: answering.Graph | None = None, types: answering.Types | None = None, phrases: bool = False, **options) -> dict[str, dict]:
    """Statistics of "train" and "test" questions (qid, text, answer_pattern) after a run in `folder`; options are those of `boosting.train`.

    Answers of both are gathered together; only train questions teach. A run that was stopped goes on after its last finished step, if the
    options are the same and the tables still hold the same questions. A qid in both tables raises an error, since test questions must not teach.
    """
    spark = docs.sparkSession
    run = Run(spark, folder)
    questions = train.select("qid", "text", "answer_pattern", F.lit("train").alias("part")).unionByName(test.select("qid", "text", "answer_pattern", F.lit("test").alias("part")))
    sums = questions.agg(F.count("qid").alias("n"), F.countDistinct("qid").alias("distinct"), F.sum(F.crc32(F.concat_ws("\x00", F.col("qid").cast("string"), "text", "answer_pattern", "part"))).alias("sum")).first()
    if sums["n"] != sums["distinct"]:
        raise ValueError("a qid stands for more than one question of the two tables")
    run.settle({"options": options, "phrases": phrases, "graph": graph is not None, "types": types is not None, "questions": [sums["n"], sums["sum"]]})
    gold = run.table("questions", lambda: questions)
    clues = run.table("clues", lambda: answering.question_clues(gold.select("qid", "text")))
    most = {"": answering.FIRST, "1": answering.SECOND}
    before, parts = None, {}
    for phase in PHASES:
        gather = {
            "": lambda: answering.found_answers(clues, docs, graph, types, phrases=phrases),
            "1": lambda: answering.merged_answers(before),
            "2": lambda: answering.with_evidence(before, clues, docs),
        }[phase]
        rows = run.table(f"answers{phase}", gather)
        parts[phase] = run.value(f"model{phase}", lambda: learned(rows, gold.filter("part = 'train'"), **options))
        scored = lambda: answering.scored(rows, phase, models_of(parts))
        before = run.table(f"scored{phase}", lambda: hl.top_k(scored(), most[phase]) if phase in most else scored())

    def evaluated() -> dict[str, dict]:
        ranks = ev.run_rows(before.select("qid", "text", "confidence"), gold.select("qid", "answer_pattern")).join(gold.select("qid", "part"), "qid")
        return {p: ev.run_statistics(ranks.filter(F.col("part") == p)).first().asDict() for p in ("train", "test")}

    out = run.value("evaluation", evaluated)
    run.sweep()
    return out


def trained_models(spark: SparkSession, folder: str) -> answering.Models:
    """The models of a run whose phases are finished, for `answering.answer`."""
    run = Run(spark, folder)
    missing = [p for p in PHASES if f"model{p}" not in run.steps()]
    if missing:
        raise ValueError(f"{folder}: phases without a model: {missing}")
    return models_of({p: run.value(f"model{p}", dict) for p in PHASES})
