"""Scores of answers: the simple product, logistic models, decision forests, and carrying a phase's score on."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the concept model, and its intercept.
CONCEPT_WEIGHTS = {
    "edit_dist": 0.008670,
    "label_probability": 4.447859,
    "log_popularity": 0.506590,
    "relatedness": 4.145722,
    "by_lat": -1.986273,
    "by_ne": 0.500504,
    "by_subject": 0.270530,
    "by_ngram": 0.000000,
    "by_fuzzy": 0.837017,
    "by_cross_wiki": -1.686557,
}
CONCEPT_INTERCEPT = -6.556334


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def value(feature: str) -> Column:
    """A feature's value, 0 if it is not set."""
    return F.coalesce(F.col(f"`{feature}`").cast("double"), F.lit(0.0))


def linear(weights: Mapping[str, float], intercept: float = 0.0) -> Column:
    return sum((value(f) * F.lit(float(w)) for f, w in weights.items()), F.lit(float(intercept)))


def concept_score() -> Column:
    """Probability that a concept is meant, from the columns that CONCEPT_WEIGHTS names."""
    return sigmoid(linear(CONCEPT_WEIGHTS, CONCEPT_INTERCEPT))


def simple_score() -> Column:
    """Specificity x e^(entity) x occurences x passage score x result score, with a default specificity of e^-4 and, for document titles, a passage score of ln 3."""
    specificity = F.coalesce(F.col("spWordNet"), F.exp(F.lit(-4.0)))
    passage = F.when(F.col("passageLogScore").isNotNull(), F.col("passageLogScore")).when(value("originDocTitle") > 0, F.log(F.lit(3.0))).otherwise(0.0)
    entity = F.when(F.col("originPsgNE").isNotNull(), F.exp(F.lit(1.0))).otherwise(F.lit(1.0))
    return specificity * entity * value("occurences") * passage * value("resultLogScore")


def logistic_score(weights: Mapping[str, Sequence[float]], intercept: float) -> Column:
    """Logistic of an expanded vector; weights holds the @, % and ! weights of each feature."""
    terms = {f"{mark}{f}": w for f, ws in weights.items() for mark, w in zip("@%!", ws, strict=True)}
    return sigmoid(linear(terms, intercept))


def parse_logistic(text: str) -> tuple[dict[str, tuple[float, ...]], float]:
    """A logistic model's text: "name: @weight, %weight, !weight" lines and an intercept line; comment lines are passed over."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    weights, intercept = {}, 0.0
    for line in text.splitlines():
        if m := re.match(rf"\s*intercept\s*[:=]?\s*({number})", line):
            intercept = float(m[1])
        elif m := re.match(rf"\s*([\w.]+)\s*[:=]\s*({number})\s*[, ]\s*({number})\s*[, ]\s*({number})", line):
            weights[m[1]] = tuple(float(x) for x in m.groups()[1:])
    return weights, intercept


def parse_forest(text: str) -> dict:
    """A forest model's JSON, comment lines left out: prior, learning_rate, labels and trees of children_left, children_right, features, thresholds, values."""
    return json.loads("\n".join(x for x in text.splitlines() if not x.lstrip().startswith(("#", "//"))))


def _tree(tree: Mapping, labels: Sequence[str], node: int = 0) -> Column:
    if tree["children_left"][node] < 0:
        return F.lit(float(tree["values"][node]))
    at_most = value(labels[tree["features"][node]]) <= F.lit(float(tree["thresholds"][node]))
    return F.when(at_most, _tree(tree, labels, tree["children_left"][node])).otherwise(_tree(tree, labels, tree["children_right"][node]))


def forest_score(model: Mapping) -> Column:
    """Logistic of prior + rate x the sum of the trees; a value up to the threshold goes left, missing values are 0. Trees are conditional expressions, so scoring stays in the JVM."""
    total = sum((_tree(t, model["labels"]) for t in model["forest"]), F.lit(0.0))
    return sigmoid(F.lit(float(model["prior"])) + F.lit(float(model["learning_rate"])) * total)


def carry_over(rows: DataFrame, phase: str) -> DataFrame:
    """The confidence of phase "" or "1" as a feature for the next phases; phase 2 leaves none."""
    name = {"": "phase0Score", "1": "phase1Score"}.get(phase)
    return rows.withColumn(name, F.col("confidence")) if name else rows


def score_phase(rows: DataFrame, phase: str, features: Sequence[str], model: Column) -> DataFrame:
    """Simple score, expanded vectors, model score as confidence, and the carry-over."""
    from .hitlist import expanded

    simple = rows.withColumn("simpleScore", simple_score())
    scored = expanded(simple, [*features, "simpleScore"]).withColumn("confidence", model)
    return carry_over(scored.select(*simple.columns, "confidence"), phase)
