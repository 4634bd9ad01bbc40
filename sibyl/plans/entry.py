"""Ways to run the answering plan: over a file of gold questions, over lines, and over the stream of questions that a front end fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import evaluation as ev
from ..sources import readers, sinks
from ..streaming import lifecycle as lc
from . import answering


def run_batch(questions: DataFrame, docs: DataFrame, path: str, **options) -> DataFrame:
    """Answers questions with gold patterns (qid, text, answer_pattern), writes the run as TSV, and gives its statistics: one row."""
    answers = answering.answer(questions.select("qid", "text"), docs, top=15, **options)
    rows = ev.run_rows(answers, questions.select("qid", "answer_pattern"))
    sinks.write_run(rows.join(questions.select("qid", "text"), "qid"), path)
    return ev.run_statistics(rows)


def run_gold_tsv(spark: SparkSession, source: str, docs: DataFrame, path: str, **options) -> DataFrame:
    return run_batch(readers.questions_tsv(spark, source), docs, path, **options)


def run_gold_json(spark: SparkSession, source: str, docs: DataFrame, path: str, **options) -> DataFrame:
    return run_batch(readers.questions_json(spark, source), docs, path, **options)


def run_lines(spark: SparkSession, lines: list[str], docs: DataFrame, machine: bool = True, **options) -> DataFrame:
    """Answers of typed or piped lines: a line for each question, for machines, or for each answer, for a terminal."""
    questions = readers.questions_lines(spark, lines)
    answers = answering.answer(questions.select("qid", "text"), docs, **options)
    if not machine:
        return sinks.interactive_lines(answers)
    return sinks.machine_lines(questions.select("qid").join(answers.select("qid", "text", "confidence"), "qid", "left"))


def run_stream(spark: SparkSession, folder: str, docs: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Answers the questions that arrive in a folder, with the concepts and the clue that come with them; each batch is appended as Parquet, with its number."""

    def each(batch: DataFrame, number: int) -> None:
        answering.answer(batch, docs, **options).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return lc.stream_batches(readers.questions_stream(spark, folder), each, checkpoint, once)
