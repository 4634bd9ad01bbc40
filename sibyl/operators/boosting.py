"""Boosted trees with a limit of leaves, grown best first.

Values are cut into bins once, so a row is a byte for each feature. Each job brings the sums of weights and residuals of every bin of the nodes that the
driver still has to know: a node's best split comes from its sums alone, so all nodes that can yet be chosen are measured together, and the tree is the one
that opening the best leaf after the other gives. The driver holds sums of one job: at most 2 x leaves nodes, a sample of the features, the bins. Rows are
written anew with their score every few trees, so no task applies more than those, and a lost executor costs no more.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stages
from .multilabel import summed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = "x binary, y double, w double, score double"


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """At most bins - 1 values of each feature after which a split may lie: quantiles of all values and of those other than 0, 0, and the value next below 0.
    So a feature that is seldom set can be split too. One aggregation; nulls are 0."""
    half = max(1, (bins - 3) // 2)
    shares = F.array(*[F.lit((i + 1) / (half + 1)) for i in range(half)])
    aggs = []
    for i, f in enumerate(features):
        v = F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))
        aggs += [F.percentile_approx(v, shares).alias(f"a{i}"), F.percentile_approx(F.nullif(v, F.lit(0.0)), shares).alias(f"b{i}"), F.max(F.when(v < 0, v)).alias(f"c{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"m{i}")]
    got = rows.agg(*aggs).first()
    out = []
    for i in range(len(features)):
        found = {*(got[f"a{i}"] or []), *(got[f"b{i}"] or []), *([0.0] if got[f"c{i}"] is None else [0.0, got[f"c{i}"]])}
        out.append(sorted(v for v in found if v is not None and math.isfinite(v) and got[f"l{i}"] <= v != got[f"m{i}"]))
    return out


def _tables(batches: Iterator[pa.RecordBatch], f: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, f)
        yield x, *(b.column(c).to_numpy() for c in (1, 2, 3))


def _places(x: np.ndarray, tree: Sequence[dict]) -> np.ndarray:
    """The number of the node that each row comes to."""
    at = np.zeros(len(x), np.int32)
    for i, node in enumerate(tree):
        if node["split"]:
            here = np.flatnonzero(at == i)
            f, cut = node["split"]
            at[here] = np.where(x[here, f] <= cut, node["left"], node["right"])
    return at


def _added(x: np.ndarray, score: np.ndarray, trees: Sequence[Sequence[dict]], rate: float) -> np.ndarray:
    """Scores and what the trees add to them."""
    for tree in trees:
        score = score + rate * np.array([n["value"] for n in tree])[_places(x, tree)]
    return score


def _measure(data: DataFrame, waiting: Sequence[int], tree: list[dict], trees: list, f: int, bins: int, rate: float) -> tuple[np.ndarray, float]:
    """Sums (rows, weight, weighted residual, weighted slope of the residual) by node, sampled feature and bin, and the rows' weighted loss."""
    each = len(tree[waiting[0]]["sample"])
    size = len(waiting) * each * bins * 4

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, loss = np.zeros((len(waiting), each, bins, 4)), 0.0
        for x, y, w, score in _tables(batches, f):
            score = _added(x, score, trees, rate)
            p = 1 / (1 + np.exp(-score))
            loss += float((w * (np.logaddexp(0, score) - y * score)).sum())
            at, numbers = _places(x, tree), (None, w, w * (y - p), w * p * (1 - p))
            for i, node in enumerate(waiting):
                here = np.flatnonzero(at == node)
                for j, feature in enumerate(tree[node]["sample"]):
                    for k, v in enumerate(numbers):
                        out[i, j, :, k] += np.bincount(x[here, feature], None if v is None else v[here], bins)
        return np.append(out.ravel(), loss)

    got = summed(data, sums, size + 1)
    return got[:-1].reshape(len(waiting), each, bins, 4), float(got[-1])


def _best(sums: np.ndarray, node: dict, least_leaf: int) -> None:
    """Gives a node its split of the greatest drop of the squared residuals and two children; none, where no split leaves enough rows on both sides."""
    left = sums.cumsum(axis=1)
    all_ = left[0, -1]
    right = all_ - left
    ok = (left[..., 0] >= least_leaf) & (right[..., 0] >= least_leaf) & (left[..., 1] > 0) & (right[..., 1] > 0)
    lw, rw = np.where(ok, left[..., 1], 1.0), np.where(ok, right[..., 1], 1.0)
    gain = np.where(ok, lw * rw / (lw + rw) * (left[..., 2] / lw - right[..., 2] / rw) ** 2, 0.0)
    gain = np.round(gain / max(all_[1], 1e-300), 12) * all_[1]  # sums of another order are to tie alike
    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[j, cut] > 0:
        node.update(gain=float(gain[j, cut]), split=(node["sample"][j], int(cut)), halves=(left[j, cut], right[j, cut]))


def _value(sums: np.ndarray) -> float:
    """A Newton step for the rows of a leaf."""
    return float(sums[2] / sums[3]) if sums[3] > 1e-150 else 0.0


def _grow(data: DataFrame, trees: list, cuts: Sequence[Sequence[float]], rng: np.random.Generator, rate: float, leaves: int, each: int, bins: int, least_split: int, least_leaf: int) -> tuple[list[dict], float]:
    """One tree and the loss of the rows before it."""
    usable = [i for i, c in enumerate(cuts) if c]
    tree: list[dict] = []

    def add(sums: np.ndarray | None) -> int:
        tree.append({"split": None, "gain": 0.0, "value": 0.0 if sums is None else _value(sums), "known": sums is not None and sums[0] < least_split, "sample": sorted(rng.choice(usable, each, replace=False).tolist())})
        return len(tree) - 1

    add(None)
    waiting, loss = [0], 0.0
    while True:
        sums, loss = _measure(data, waiting, tree, trees, len(cuts), bins, rate)
        if waiting == [0]:
            tree[0]["value"] = _value(sums[0, 0].sum(axis=0))
        for s, i in zip(sums, waiting, strict=True):
            node = tree[i]
            node["known"] = True
            if s[0, :, 0].sum() >= least_split:
                _best(s, node, least_leaf)
            if node["split"]:
                node["left"], node["right"] = (add(h) for h in node.pop("halves"))
        # open the best leaf after the other, as far as the measured nodes go
        chosen, open_ = [], [0] if tree[0]["split"] else []
        waiting = []
        while open_ and len(chosen) < leaves - 1 and not waiting:
            best = max(open_, key=lambda i: (tree[i]["gain"], -i))
            open_.remove(best)
            chosen.append(best)
            below = [tree[best]["left"], tree[best]["right"]]
            open_ += [c for c in below if tree[c]["split"]]
            waiting = [c for c in below if not tree[c]["known"]] if len(chosen) < leaves - 1 else []
        if not waiting:
            return _pruned(tree, set(chosen)), loss
        for i in sorted(open_, key=lambda i: (-tree[i]["gain"], i))[: leaves - 1 - len(chosen)]:
            waiting += [c for c in (tree[i]["left"], tree[i]["right"]) if not tree[c]["known"]]


def _pruned(tree: list[dict], chosen: set[int]) -> list[dict]:
    """The chosen splits and the leaves below them, numbered anew, parents first."""
    out: list[dict] = []
    queue = [0]
    for i in queue:
        split = tree[i]["split"] if i in chosen else None
        out.append({"split": split, "value": tree[i]["value"]} | ({"left": len(queue), "right": len(queue) + 1} if split else {}))
        if split:
            queue += [tree[i]["left"], tree[i]["right"]]
    return out


def _written(data: DataFrame, trees: list, f: int, rate: float) -> DataFrame:
    """The rows with the trees in their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, w, score in _tables(iter([b]), f):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y), pa.array(w), pa.array(_added(x, score, trees, rate))], ["x", "y", "w", "score"])

    return stages.staged(data.mapInArrow(run, _ROWS), "boosted-rows")


def train(
    rows: DataFrame, features: Sequence[str], label: str = "class", trees: int = 200, leaves: int = 10, rate: float = 0.1, least_split: int = 10, least_leaf: int = 5, sampled: int | None = None, bins: int = 64, ratio: float = 0.5, kept: int = 10, seed: int = 0,
) -> tuple[dict, list[float]]:
    """A forest in the format that `scoring.parse_forest` reads and `scoring.forest_score` scores, and the mean loss before each tree.

    Trees fit the residuals of the logistic loss; leaves are Newton steps; rows of label 1 weigh `ratio` / their share. A node looks at `sampled` features
    (by default the square root of those that vary); it is split where it has `least_split` rows and both sides have `least_leaf`. At most `bins` (256) bins
    a feature. Null features are 0, NaN is above all numbers, rows without a label are left out; where only one label stands, or none, there are no trees.
    """
    features, bins = list(features), min(bins, 256)
    rows = rows.filter(F.col(label).isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("ones")).first()
    model = {"prior": 0.0, "learning_rate": rate, "labels": features, "forest": []}
    if not 0 < counts.ones < counts.n:
        return model | {"prior": 0.0 if not counts.n else 30.0 if counts.ones else -30.0}, []
    heavier = ratio * counts.n / counts.ones
    model["prior"] = prior = math.log(heavier * counts.ones / (counts.n - counts.ones))
    total = heavier * counts.ones + counts.n - counts.ones
    cuts = cut_points(rows, features, bins)
    usable = sum(map(bool, cuts))
    if not usable:
        return model, []
    each = min(usable, sampled or max(1, int(math.sqrt(usable))))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(0).flatten()).reshape(-1, len(features))
            x = np.stack([np.searchsorted(c, v[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            y = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y), pa.array(np.where(y > 0, heavier, 1.0)), pa.array(np.full(len(y), prior))], ["x", "y", "w", "score"])

    values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    data = stages.staged(rows.select(values.alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(binned, _ROWS), "boosted-rows")
    rng, fresh, losses = np.random.default_rng(seed), [], []
    for t in range(trees):
        if len(fresh) == kept:
            data, fresh = _written(data, fresh, len(features), rate), []
        tree, loss = _grow(data, fresh, cuts, rng, rate, leaves, each, bins, least_split, least_leaf)
        losses.append(loss / total)
        fresh = [*fresh, tree]
        model["forest"].append(_as_lists(tree, cuts))
    return model, losses


def _as_lists(tree: list[dict], cuts: Sequence[Sequence[float]]) -> dict:
    """A tree as the reader has it; a leaf has no children (-1)."""
    return {
        "children_left": [n["left"] if n["split"] else -1 for n in tree],
        "children_right": [n["right"] if n["split"] else -1 for n in tree],
        "features": [n["split"][0] if n["split"] else -2 for n in tree],
        "thresholds": [float(cuts[n["split"][0]][n["split"][1]]) if n["split"] else -2.0 for n in tree],
        "values": [float(n["value"]) for n in tree],
    }
