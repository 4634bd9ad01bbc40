"""Sparse logistic models for all labels of a table at once.

The labels' models are independent, so one pass over the rows gives the gradients of all of them: a matrix product in each task, whose
sums go on in slices and are added up by slice. The driver takes an accelerated proximal step with a step width of each label's own; weights that
the penalty outweighs are exactly 0. A step costs one job, however many labels there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stages

#: Rows that a task multiplies at once, and numbers of a slice of the sums.
ROWS, SLICE = 1_024, 1 << 15

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class LabelModels:
    """weights: a row for each label, the last column is the intercept."""

    labels: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray

    def by_label(self) -> dict[str, dict[str, float]]:
        """Weights other than 0 of each label by feature, "_" the intercept."""
        names = (*self.features, "_")
        return {c: {f: float(w) for f, w in zip(names, row, strict=True) if w or f == "_"} for c, row in zip(self.labels, self.weights, strict=True)}


def summed(df: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all tasks of the vectors that fn makes of a task's batches."""
    n = -(-size // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fn(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(n)], pa.binary())], ["slice", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data)
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "data"])

    parts = df.mapInArrow(run, "slice int, data binary")
    if df.rdd.getNumPartitions() > 1:  # the sums of a single task are the sums of all
        parts = parts.repartition("slice").mapInArrow(add, "slice int, data binary")
    got = {r["slice"]: np.frombuffer(r["data"]) for r in parts.collect()}
    return np.concatenate([got[i] for i in range(n)]) if got else np.zeros(size)


def _matrices(batches: Iterator[pa.RecordBatch], k: int, f: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features with a last column of ones, and 0/1 labels, some rows at a time. Columns: array of features, array of label numbers."""
    for b in batches:
        for s in range(0, b.num_rows, ROWS):
            part = b.slice(s, ROWS)
            x = np.ones((part.num_rows, f + 1))
            x[:, :f] = np.asarray(part.column(0).flatten()).reshape(-1, f)
            y = np.zeros((part.num_rows, k))
            y[np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy())), np.asarray(part.column(1).flatten())] = 1
            yield x, y


def train(rows: DataFrame, features: Sequence[str], has: str = "labels", labels: Sequence[str] | None = None, l1: float = 0.01, steps: int = 100, close: float = 1e-5) -> LabelModels:
    """A model for each label of rows whose `has` column is the array of their labels; labels: by default all that stand there.

    Each minimises the mean logistic loss, rows with and without the label weighing half each, plus l1 times the sum of the absolute weights over
    features scaled to a deviation of 1; the intercept is free. The weights are of the features as they are. Null features are 0; a label that all rows
    have, or none, has an intercept only. At most `steps` steps, fewer where no weight moves by more than `close`.
    """
    if labels is None:
        labels = sorted(r[0] for r in rows.select(F.explode(has)).distinct().na.drop().collect())  # labels are few: each is a model
    k, f = len(labels), len(features)
    numbers = F.create_map(*[F.lit(v) for i, c in enumerate(labels) for v in (c, i)]) if k else None
    if not k:
        return LabelModels((), tuple(features), np.zeros((0, f + 1)))
    own = F.array_compact(F.transform(F.array_distinct(F.coalesce(F.col(has), F.array().cast("array<string>"))), lambda c: numbers[c]))
    data = stages.staged(rows.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"), own.alias("y")), "label-rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + 2 * f + k)
        for x, y in _matrices(batches, k, f):
            out += np.concatenate([[len(x)], x[:, :f].sum(0), (x[:, :f] ** 2).sum(0), y.sum(0)])
        return out

    got = summed(data, moments, 1 + 2 * f + k)
    n, mean = max(1.0, got[0]), got[1 : f + 1] / max(1.0, got[0])
    spread = np.sqrt(np.maximum(got[f + 1 : 2 * f + 1] / n - mean**2, 0))
    scale = np.where(spread > 1e-12, spread, 1.0)
    have = got[2 * f + 1 :]
    with_, without = 0.5 / np.maximum(have, 1), 0.5 / np.maximum(n - have, 1)  # a row's weight, for each label

    def lengths(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(k)
        for x, y in _matrices(batches, k, f):
            x[:, :f] = (x[:, :f] - mean) / scale
            out += ((x**2).sum(1)[:, None] * (y * with_ + (1 - y) * without)).sum(0)
        return out

    # the curvature is a quarter of the weighted mean of the rows' squared lengths at most
    width = 4 / np.maximum(summed(data, lengths, k), 1e-12)
    spark = rows.sparkSession

    def slope(w: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(w)

        def gradient(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((k, f + 1))
            for x, y in _matrices(batches, k, f):
                x[:, :f] = (x[:, :f] - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(x @ shared.value.T, -500, 500)))
                out += ((p - y) * (y * with_ + (1 - y) * without)).T @ x
            return out.ravel()

        out = summed(data, gradient, k * (f + 1)).reshape(k, f + 1)
        shared.destroy()
        return out

    w = ahead = np.zeros((k, f + 1))
    t = 1.0
    one_sided = (have == 0) | (have == n)
    for _ in range(steps):
        new = ahead - width[:, None] * slope(ahead)
        new[:, :f] = np.sign(new[:, :f]) * np.maximum(np.abs(new[:, :f]) - width[:, None] * l1, 0)
        new[one_sided] = 0
        # back to plain steps where the momentum points uphill
        t_new = 1.0 if ((ahead - new) * (new - w)).sum() > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w) if t_new > 1 else new
        moved, w, t = float(np.abs(new - w).max(initial=0)), new, t_new
        if moved < close:
            break
    plain = w.copy()
    plain[:, :f] = w[:, :f] / scale
    plain[:, f] -= plain[:, :f] @ mean
    plain[one_sided, f] = np.where(have[one_sided] > 0, 30.0, -30.0)
    return LabelModels(tuple(labels), tuple(features), plain)


def score(features: Sequence[str], weights: dict[str, float]) -> Column:
    """The probability of a label as a sum of columns."""
    total = F.lit(weights["_"])
    for f in features:
        if weights.get(f):
            total = total + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * weights[f]
    return 1 / (1 + F.exp(-total))


def ranked(rows: DataFrame, models: LabelModels, keys: Sequence[str], least: float = 0.5, most: int = 15) -> DataFrame:
    """keys, path, score, rank: for each row its labels of a score of `least` or more, at most the `most` best."""
    by = models.by_label()
    scored = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("path"), score(models.features, by[c]).alias("score")) for c in models.labels])).alias("_p")).select(*keys, "_p.*")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "path")
    return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
