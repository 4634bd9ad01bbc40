"""Sinks: run files, answer lists, training data, checkpoints, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Features that are not written as training data.
NOT_TRAINED = (
    "originPsgByClueSubjectNE", "originDBpOClueToken", "originDBpOCluePhrase", "originDBpOClueSV", "originDBpOClueNE", "originDBpOClueSubjectNE",
    "originDBpOClueSubjectPhrase", "originDBpPCluePhrase", "originDBpPClueSV", "originDBpPClueNE", "originDBpPClueSubjectNE",
    "originDBpPClueSubjectPhrase", "originFBOCluePhrase", "originFBOClueNE", "originFBOClueSubjectNE", "originFBOClueSubjectPhrase",
    "psgDistClueSubjectNE", "tyCorPassageSp", "tyCorPassageDist", "tyCorPassageInside", "tyCorADBpWN", "tyCorAQuantity",
)


def write_run(rows: DataFrame, path: str, top: int = 15) -> None:
    """A run as TSV: id, seconds, question, score, rank, answers, pattern, match, four passage counts, and the top answers."""
    fixed = ["qid", "seconds", "text", "score", "rank", "n_answers", "answer_pattern", "match", "n_scored", "n_gs_scored", "n_picked", "n_gs_picked"]
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fixed]
    places = [F.coalesce(F.get("top", i), F.lit("")).alias(f"top{i + 1}") for i in range(top)]
    rows.select(*have, *places).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def machine_lines(hitlist: DataFrame, k: int = 4) -> DataFrame:
    """(qid, line): the best answers with their confidence, or that there is none. Questions come from `hitlist` rows, those without an answer with null text."""
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.asc("text"))
    top = hitlist.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    each = F.when(F.col("text").isNotNull(), F.struct("_i", F.format_string("%s (%.2f)", "text", "confidence").alias("a")))
    lines = top.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["a"]), " | ").alias("line"))
    return lines.withColumn("line", F.when(F.col("line") == "", "No answer found.").otherwise(F.col("line")))


def interactive_lines(hitlist: DataFrame) -> DataFrame:
    """Ranked lines of one question for a terminal: "rank. text (conf. c)" and the resources."""
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.asc("text"))
    resources = F.array_join("resources", " ") if "resources" in hitlist.columns else F.lit("")
    return hitlist.withColumn("rank", F.row_number().over(w)).select("qid", "rank", F.trim(F.concat(F.format_string("%d. %s (conf. %.6f) ", "rank", "text", "confidence"), resources)).alias("line"))


def question_json(questions: DataFrame, **children: DataFrame) -> DataFrame:
    """(qid, json): the question with its child tables (clues, lats, …) as sorted arrays."""
    out = questions
    for name, child in children.items():
        columns = [c for c in child.columns if c != "qid"]
        rows = child.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, "qid", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out.select("qid", F.to_json(F.struct(*[c for c in out.columns])).alias("json"))


def write_checkpoint(hitlist: DataFrame, folder: str, phase: int) -> None:
    hitlist.withColumn("phase", F.lit(phase)).write.mode("append").partitionBy("phase").parquet(folder)


def passage_training(vectors: DataFrame, gold: DataFrame) -> DataFrame:
    """The four numbers of each passage and whether the gold pattern matches it."""
    hit = tx.gold_match(F.col("sentence"), F.col("answer_pattern"))
    return vectors.join(gold.select("qid", "answer_pattern"), "qid").select("qid", "doc_id", "clueMatch", "clueWeight", "aboutClueMatch", "aboutClueWeight", hit.cast("int").alias("class"))


def answer_training(expanded: DataFrame, features: Sequence[str], is_match: Column) -> DataFrame:
    """qid, the three numbers of each feature to 4 places but for NOT_TRAINED, and isMatch."""
    kept = [f for f in features if f not in NOT_TRAINED]
    return expanded.select("qid", *[F.round(F.col(f"`{m}{f}`"), 4).alias(f"{m}{f}") for f in kept for m in "@%!"], is_match.cast("int").alias("isMatch"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_answers(rows: DataFrame, folder: str) -> None:
    """Answers as quoted CSV, a folder for each question."""
    rows.write.mode("overwrite").partitionBy("qid").csv(folder, header=True, quoteAll=True)


def property_labels(values: DataFrame, clues: DataFrame) -> DataFrame:
    """Lines of property training: the question's words, then label, clues and words of each property."""
    by = clues.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("_c"))
    return values.join(by, "qid", "left").select("qid", F.concat_ws("\t", "label", "_c", F.array_join(F.split(F.lower("property"), r"[\p{Punct}\s]+"), " ")).alias("line"))


def tagger_training(tokens: DataFrame) -> DataFrame:
    """Features and outcome of the tokens of passages that hold a gold mention (column outcome: B, I, O)."""
    some = tokens.filter("outcome <> 'O'").select("passage").distinct()
    return tokens.join(some, "passage", "left_semi").select("passage", "i", "features", "outcome")


def append_cache(results: DataFrame, folder: str) -> None:
    """Web results added to the store."""
    results.select("query", "title", "description", "url", "rank").write.mode("append").parquet(folder)


def state_json(states: DataFrame) -> DataFrame:
    """What a front end reads of each question."""
    return states.select("qid", F.to_json(F.struct("*")).alias("json"))


def embedding_lines(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lines for training relatedness: the question's words, then each candidate's label (0/1) and words."""
    head = questions.select("qid", F.lit(0).alias("n"), F.concat(F.lit("<Q> "), F.array_join("words", " ")).alias("line"))
    body = candidates.select("qid", F.lit(1).alias("n"), F.concat_ws(" ", F.col("label").cast("string"), F.array_join("words", " ")).alias("line"))
    return head.unionByName(body)


def ask(questions: DataFrame, folder: str) -> None:
    """Puts questions (qid, text, concepts, artificial_clue) into the folder that the question stream reads; those without text are refused."""
    if not questions.filter("text IS NULL OR trim(text) = ''").isEmpty():
        raise ValueError("a question needs a text")
    questions.write.mode("append").json(folder)
