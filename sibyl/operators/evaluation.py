"""Evaluation of runs: accuracy, recall, MRR, comparison, curves, feature statistics, reference answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def run_rows(hitlist: DataFrame, gold: DataFrame, top: int = 15) -> DataFrame:
    """A row per gold question: rank of the first answer that its pattern finds (from 0; -1 none), its text, the number of answers, score and the top answers.

    The score is 1 - ln(1 + rank) / ln(1 + n), 1 for the first of one, 0 for none. Questions without answers have rank -1.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.asc("text"))
    ranked = hitlist.withColumn("rank", F.row_number().over(w) - 1)
    hit = tx.gold_match(F.col("text"), F.col("answer_pattern"))
    each = gold.alias("g").join(ranked.select("qid", "text", "confidence", "rank"), "qid", "left")
    best = F.struct("rank", "text", "confidence")
    out = each.groupBy("qid", "answer_pattern").agg(
        F.min(F.when(hit, F.col("rank"))).alias("_rank"), F.min_by("text", F.when(hit, F.col("rank"))).alias("match"), F.count("text").alias("n_answers"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("rank") < top, best))), 1, top), lambda x: F.concat_ws(":", x["text"], F.format_string("%.4f", x["confidence"]))).alias("top"),
    )
    rank = F.coalesce(F.col("_rank"), F.lit(-1))
    score = F.when(rank < 0, 0.0).when(F.col("n_answers") <= 1, 1.0).otherwise(1 - F.log1p(rank.cast("double")) / F.log1p(F.col("n_answers").cast("double")))
    return out.select("qid", "answer_pattern", rank.alias("rank"), "match", "n_answers", score.alias("score"), "top")


def run_statistics(rows: DataFrame) -> DataFrame:
    """n, n_first, n_found, accuracy, recall, MRR of rows with a rank (-1: none)."""
    reciprocal = 1 / (1 + F.when(F.col("rank") < 0, F.lit(10000)).otherwise(F.col("rank")))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), F.count_if(F.col("rank") == 0).alias("n_first"), F.count_if(F.col("rank") >= 0).alias("n_found"), (F.count_if(F.col("rank") == 0) / n).alias("accuracy"), (F.count_if(F.col("rank") >= 0) / n).alias("recall"), F.avg(reciprocal).alias("mrr"))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "qid", tolerance: float = 0.05) -> DataFrame:
    """Each question of either run with what became of it: gained, lost, improved, worsened, same, only_a, only_b."""
    x = a.select(key, F.col("score").alias("score_a"), F.col("rank").alias("rank_a"))
    y = b.select(key, F.col("score").alias("score_b"), F.col("rank").alias("rank_b"))
    change = F.col("score_b") - F.col("score_a")
    fate = (
        F.when(F.col("score_a").isNull(), "only_b").when(F.col("score_b").isNull(), "only_a")
        .when((F.col("rank_a") < 0) & (F.col("rank_b") >= 0), "gained").when((F.col("rank_a") >= 0) & (F.col("rank_b") < 0), "lost")
        .when(change > tolerance, "improved").when(change < -tolerance, "worsened").otherwise("same")
    )
    return x.join(y, key, "full_outer").withColumn("fate", fate)


def rank_curve(rows: DataFrame, length: int) -> DataFrame:
    """Places 1 to length with the ranks of the found questions in order, null beyond them."""
    spark = rows.sparkSession
    by = rows.filter("rank >= 0").groupBy("rank").agg(F.count(F.lit(1)).alias("_n"))
    ends = by.withColumn("_end", F.sum("_n").over(Window.orderBy("rank")))  # one row for each rank
    each = ends.select("rank", F.explode(F.sequence(F.col("_end") - F.col("_n") + 1, F.col("_end"))).alias("place")).filter(F.col("place") <= length)
    return spark.range(1, length + 1).withColumnRenamed("id", "place").join(each, "place", "left")


def precision_recall(rows: DataFrame, score: str = "score", correct: str = "correct") -> DataFrame:
    """For each distinct score from the top: counts so far, precision, recall and false-positive rate. Equal scores are one point, so sums run over the points."""
    points = rows.groupBy(score).agg(F.sum(F.col(correct).cast("long")).alias("_t"), F.count(F.lit(1)).alias("_n"))
    down = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    t, n = F.sum("_t").over(down), F.sum("_n").over(down)
    all_t, all_n = F.sum("_t").over(whole), F.sum("_n").over(whole)
    return points.select(score, t.alias("n_correct"), n.alias("n_taken"), (t / n).alias("precision"), (t / all_t).alias("recall"), F.when(all_n > all_t, (n - t) / (all_n - all_t)).alias("fp_rate"))


def feature_statistics(features: DataFrame, n_rows: DataFrame | None = None) -> DataFrame:
    """Of long rows (qid, answer, correct, feature; a row for each set feature): share of questions and answers that have it, share among correct ones, and lift."""
    totals = features.select("qid", "answer", "correct").distinct().agg(F.countDistinct("qid").alias("_q"), F.count(F.lit(1)).alias("_a"), F.sum(F.col("correct").cast("long")).alias("_c"))
    each = features.groupBy("feature").agg(F.countDistinct("qid").alias("n_questions"), F.count(F.lit(1)).alias("n_answers"), F.sum(F.col("correct").cast("long")).alias("n_correct"))
    q, a = F.col("n_questions") / F.col("_q"), F.col("n_answers") / F.col("_a")
    lift = (F.col("n_correct") / F.col("n_answers")) / (F.col("_c") / F.col("_a"))
    kind = F.when((a < 0.001) & (q < 0.01), "extremely rare").when(a < 0.01, "rare").when(F.abs(lift - 1) <= 0.1, "poor predictor").otherwise("useful")
    return each.crossJoin(F.broadcast(totals)).select("feature", "n_questions", "n_answers", "n_correct", q.alias("question_share"), a.alias("answer_share"), lift.alias("lift"), kind.alias("kind"))


def feature_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features (qid, answer, feature, value) of answers that both runs have, whose values differ; a feature that one run lacks counts as null there."""
    both = a.select("qid", "answer").distinct().intersect(b.select("qid", "answer").distinct())
    key = ["qid", "answer", "feature"]
    joined = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), key, "full_outer")
    return joined.filter(~F.col("value_a").eqNullSafe(F.col("value_b"))).join(both, ["qid", "answer"], "left_semi")


def answer_metrics(rows: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Of rows (qid, correct, score): accuracy, precision, recall, F1 by answer at the threshold; any-good in the top k and MRR by question, with ties counted fairly.

    A correct answer that ties with others counts at the mean of the places that they share.
    """
    w = Window.partitionBy("qid")
    placed = rows.withColumn("_above", F.rank().over(w.orderBy(F.desc("score"))) - 1).withColumn("_tied", F.count(F.lit(1)).over(Window.partitionBy("qid", "score")))
    place = F.col("_above") + (F.col("_tied") - 1) / 2
    by_question = placed.groupBy("qid").agg(
        F.min(F.when(F.col("correct") == 1, place)).alias("_best"),
        F.count_if((F.col("score") >= threshold) & (F.col("correct") == 1)).alias("_tp"), F.count_if((F.col("score") >= threshold) & (F.col("correct") == 0)).alias("_fp"),
        F.count_if((F.col("score") < threshold) & (F.col("correct") == 1)).alias("_fn"), F.count(F.lit(1)).alias("_n"),
    )
    tp, fp, fn, n = F.sum("_tp"), F.sum("_fp"), F.sum("_fn"), F.sum("_n")
    return by_question.agg(
        ((n - fp - fn) / n).alias("accuracy"), (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"),
        F.avg(F.when(F.col("_best") < k, 1.0).otherwise(0.0)).alias("any_good"), F.avg(F.coalesce(1 / (1 + F.col("_best")), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("_best").isNotNull(), 1.0).otherwise(0.0)).alias("available"),
    )


def reference_answers(rows: DataFrame, is_match: Column) -> DataFrame:
    """The answer of each question that training takes as right: the best match, or a shorter match that it contains (ties: the surer, then the text)."""
    matches = rows.filter(is_match)
    best = matches.groupBy("qid").agg(F.max_by("text", F.struct("confidence", F.col("text"))).alias("best"))
    inside = matches.join(best, "qid").filter(F.contains("best", "text"))
    first = Window.partitionBy("qid").orderBy(F.length("text"), F.desc("confidence"), "text")
    return inside.withColumn("_i", F.row_number().over(first)).filter("_i = 1").select("qid", "best", "text")


def carry_analysis(notes: DataFrame, rows: DataFrame, key: str = "qid") -> DataFrame:
    """Notes on questions that still fail are kept, those on found ones go, and new failures get an empty note."""
    failed = rows.filter("rank < 0").select(key)
    kept = notes.join(failed, key, "left_semi")
    new = failed.join(notes, key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def path_metrics(predicted: DataFrame, gold: DataFrame, keys: Sequence[str] = ("qid",), k: int = 15) -> DataFrame:
    """Of ranked predictions (qid, path, score) against gold (qid, path): share of questions with any and with all paths in the top k, precision, MRR."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "path")
    top = predicted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    hit = gold.join(top.select(*keys, "path", "rank"), [*keys, "path"], "left")
    by = hit.groupBy(*keys).agg(F.max(F.col("rank").isNotNull().cast("int")).alias("any"), F.min(F.col("rank").isNotNull().cast("int")).alias("all"), F.min("rank").alias("first"), F.count("rank").alias("hits"))
    sizes = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = by.join(sizes, list(keys), "left")
    return joined.agg(F.avg("any").alias("any_recall"), F.avg("all").alias("all_recall"), F.avg(F.col("hits") / F.nullif(F.coalesce("n", F.lit(0)), F.lit(0))).alias("path_precision"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def exact_ranks(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank): the first rank, from 0, at which an answer equals one of the gold answers (column answers), -1 for none."""
    hits = answers.join(gold, "qid").filter(F.array_contains("answers", F.col("text"))).groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid").join(hits, "qid", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
