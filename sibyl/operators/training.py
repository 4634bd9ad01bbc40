"""Training of the models with pyspark.ml, and evaluation on splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stages


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Rows with a weight by which both labels count the same."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_labels"))
    return rows.join(F.broadcast(n.crossJoin(total)), label).withColumn("weight", F.col("_all") / (F.col("_labels") * F.col("_n"))).drop("_n", "_all", "_labels")


def split(rows: DataFrame, key: str, number: int, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; all rows of a key are on one side, and another number gives another split."""
    held = F.pmod(F.xxhash64(F.col(key), F.lit(number)), F.lit(parts)) == 0
    return rows.filter(~held), rows.filter(held)


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def logistic(rows: DataFrame, features: Sequence[str], label: str = "class", l1: float = 0.0, reg: float = 0.01):
    """A logistic model, labels balanced."""
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="weight", regParam=reg, elasticNetParam=l1)
    return Pipeline(stages=[_assembled(features), lr]).fit(balanced(rows, label))


def forest(rows: DataFrame, features: Sequence[str], label: str = "class", trees: int = 200, depth: int = 4, seed: int = 0):
    """Gradient-boosted trees on a square-root sample of the features, labels balanced. Depth stands in for a limit of leaves."""
    gbt = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[_assembled(features), gbt]).fit(balanced(rows, label))


def scored(model, rows: DataFrame) -> DataFrame:
    """Rows with the probability of label 1 as score."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def repeated(rows: DataFrame, features: Sequence[str], key: str, label: str = "class", rounds: int = 20) -> list[DataFrame]:
    """Test rows with scores, one table for each split."""
    out = []
    for r in range(rounds):
        train, test = split(rows, key, r)
        out.append(scored(logistic(train, features, label), test))
    return out


def cross_validated(rows: DataFrame, features: Sequence[str], key: str, label: str = "class", folds: int = 10) -> DataFrame:
    """(fold, n, accuracy) of a multinomial logistic of each fold on the rows outside it; all rows of a key are in one fold. A fold without rows, or of which the rest has no rows, is left out."""
    marked = stages.staged(rows.select(key, label, *features).withColumn("fold", F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")), "folds")
    have = sorted(r.fold for r in marked.select("fold").distinct().collect())  # at most `folds` rows
    out = []
    for fold in have if len(have) > 1 else []:
        model = Pipeline(stages=[_assembled(features), LogisticRegression(featuresCol="_features", labelCol=label, regParam=0.01, family="multinomial")]).fit(marked.filter(F.col("fold") != fold))
        right = F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")
        out.append(model.transform(marked.filter(F.col("fold") == fold)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), right))
    return reduce(DataFrame.unionByName, out) if out else marked.limit(0).select("fold", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("accuracy"))


def path_measures(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the shares of questions of which any, and all, gold paths are predicted, the share of predicted paths that are right, and the mean reciprocal rank of the first right one.

    predicted: (qid, path, rank from 1); gold: (qid, path).
    """
    hits = gold.join(predicted, ["qid", "path"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.count("rank").alias("_got"), F.min("rank").alias("_first"))
    right = predicted.join(gold.withColumn("_right", F.lit(1)), ["qid", "path"], "left").agg(F.avg(F.coalesce("_right", F.lit(0))).alias("path_precision"))
    return hits.agg(F.avg((F.col("_got") > 0).cast("double")).alias("any_recall"), F.avg((F.col("_got") == F.col("_n")).cast("double")).alias("all_recall"), F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr")).crossJoin(right)


def weights(model, features: Sequence[str]) -> dict[str, float]:
    """Weights of a logistic model by feature, "_" the intercept."""
    lr = model.stages[-1]
    return dict(zip(features, lr.coefficients.toArray().tolist(), strict=True)) | {"_": float(lr.intercept)}


def importances(model, features: Sequence[str]) -> dict[str, float]:
    """Feature importances of a forest relative to the greatest."""
    v = model.stages[-1].featureImportances.toArray()
    return {f: float(x / max(v.max(), 1e-12)) for f, x in zip(features, v, strict=True)}


def tree_rows(model: dict) -> list[tuple[int, int, int, int, str | None, float, float]]:
    """(tree, node, left, right, feature, threshold, value) of a forest model's JSON."""
    out = []
    for t, tree in enumerate(model["forest"]):
        for n in range(len(tree["children_left"])):
            inner = tree["children_left"][n] >= 0
            out.append((t, n, tree["children_left"][n], tree["children_right"][n], model["labels"][tree["features"][n]] if inner else None, float(tree["thresholds"][n]), float(tree["values"][n])))
    return out


def chains(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, path, value): the conditions from root to each leaf, over the node rows of a forest model, level by level to its depth."""
    up = nodes.select("tree", F.col("node").alias("_up"), "left", "right", "feature", "threshold").filter("left >= 0")
    to = F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit("<=").alias("sign")), F.struct(F.col("right").alias("node"), F.lit(">").alias("sign"))))
    steps = up.withColumn("_c", to).select("tree", "_up", F.col("_c.node").alias("node"), F.concat("feature", "_c.sign", F.col("threshold").cast("string")).alias("_step"))
    leaves = nodes.filter("left < 0").select("tree", F.col("node").alias("leaf"), "value")
    walk, found = nodes.filter("node = 0").select("tree", "node", F.lit("").alias("path")), None
    while True:
        here = walk.join(leaves, (walk["tree"] == leaves["tree"]) & (walk["node"] == leaves["leaf"])).select(walk["tree"], "leaf", "path", "value")
        found = here if found is None else found.unionByName(here)
        path = F.when(F.col("path") == "", F.col("_step")).otherwise(F.concat_ws(" & ", "path", "_step"))
        walk = stages.staged(walk.withColumnRenamed("node", "_up").join(steps, ["tree", "_up"]).select("tree", "node", path.alias("path")), "chains")
        if walk.isEmpty():
            return found
