"""Quality classifier: a factorisation machine.

Inputs are hashed words (each distinct word of the text once, scaled so that a text's words have length 1), statistics of
the text's structure and metadata numbers. The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose second half is all pairwise interactions in time linear in the number of inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns
from .rules import STATISTICS, text_statistics

#: Word inputs: crc32 of the lower-case word, modulo this. The model is this many rows of 1 + FACTORS numbers, whatever the corpus.
BUCKETS = 1 << 16
FACTORS = 8
#: Each structure number is cut into so many steps of a log or share scale, and each step is an input of its own.
STEPS = 24


def _structure(s: tuple[int, ...]) -> list[tuple[str, float]]:
    """Named shares in [0, 1] of the statistics."""
    x = dict(zip(STATISTICS, s, strict=True))
    w, c, n = max(1, x["n_words"]), max(1, x["word_chars"]), max(1, x["n_lines"])
    return [
        ("length", min(1.0, np.log1p(x["n_words"]) / 12)),
        ("word", min(1.0, c / w / 16)),
        ("symbols", min(1.0, x["n_symbols"] / w / 2)),
        ("dup", x["n_dup_lines"] / n),
        ("repeat", min(1.0, x["n_repeat_words"] / w)),
        ("upper", min(1.0, x["n_upper"] / c)),
        ("digits", min(1.0, x["n_digits"] / c)),
        ("stops", min(1.0, x["n_stops"] / w)),
        ("marks", min(1.0, x["n_marks"] / w)),
        ("distinct", x["n_distinct_words"] / w),
        ("lines", min(1.0, np.log1p(w / n) / 8)),
        ("longest", min(1.0, np.log1p(x["longest_word"]) / 8)),
    ]


def n_inputs(n_metadata: int) -> int:
    return BUCKETS + (len(_structure((0,) * len(STATISTICS))) + n_metadata) * (STEPS + 2)


def inputs(text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one document. Null text is the empty text; a null or non-finite metadata number has an input of its own."""
    text = text or ""
    at = sorted({crc32(w) % BUCKETS for w in text.lower().encode("utf-8", "surrogatepass").split()})
    values = [1 / max(1, len(at)) ** 0.5] * len(at)
    base = BUCKETS
    for _, v in _structure(text_statistics(text)):
        at += [base + min(STEPS - 1, int(v * STEPS)), base + STEPS]
        values += [0.5, v]
        base += STEPS + 2
    for m in metadata:
        known = m is not None and np.isfinite(m)
        v = min(1.0, np.log1p(abs(m)) / 16) if known else 0.0
        at += [base + (min(STEPS - 1, int(v * STEPS)) if known else STEPS + 1)]
        values += [0.5]
        base += STEPS + 2
    return np.array(at, np.int32), np.array(values, np.float32)


@dataclass
class FactorisationMachine:
    """w0, linear weights and factors; `shift` moves the score so that 0.7 is the best cut on the training rows."""

    size: int
    w0: float = 0.0
    shift: float = 0.0
    w: np.ndarray = field(default=None)
    v: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.w = np.zeros(self.size, np.float32) if self.w is None else self.w
        self.v = np.random.default_rng(3).normal(0, 0.01, (self.size, FACTORS)).astype(np.float32) if self.v is None else self.v

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic; rows are cut at starts, none is empty."""
        if not len(starts):
            return np.zeros(0)
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((s**2) - np.add.reduceat(vx**2, starts)).sum(1)

    def score(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(at, x, starts) + self.shift, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-4, batch: int = 128, seed: int = 1) -> FactorisationMachine:
        """AdaGrad on the logistic loss, both labels weighing the same, in an order fixed by the seed."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(1e-9, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean()))
        gw, gv, g0 = np.full(self.size, 1e-6, np.float32), np.full((self.size, FACTORS), 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                at, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                lens = np.array([len(rows[i][0]) for i in pick])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                vx = self.v[at] * x[:, None]
                s = np.add.reduceat(vx, starts)
                raw = self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (s**2 - np.add.reduceat(vx**2, starts)).sum(1)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                e = np.repeat(err, lens) * x
                ids, inverse = np.unique(at, return_inverse=True)
                dw = np.bincount(inverse, e, len(ids)) + decay * self.w[ids] / len(pick)
                dv = np.stack([np.bincount(inverse, e * (np.repeat(s[:, f], lens) - vx[:, f]), len(ids)) for f in range(FACTORS)], 1) + decay * self.v[ids] / len(pick)
                gw[ids] += dw**2
                gv[ids] += dv**2
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= rate * 0.5 * dv / np.sqrt(gv[ids])
                d0 = err.sum()
                g0 += d0**2
                self.w0 -= rate * d0 / g0**0.5
        return self


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), threshold: float = 0.7, most_rows: int = 6_000) -> FactorisationMachine:
    """A machine fitted on at most `most_rows` labelled documents, those of the lowest hash of the id.

    Only this bounded sample of labels is broadcast; its inputs, built by the workers from whole texts, go to the driver.
    Ids labelled twice count once, with the lower label; null labels and ids are left out. Without labels every score is 1/2.
    A third of the rows sets `shift`, by which `threshold` is the cut of the highest balanced accuracy.
    """
    sample = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)

    def build(texts: list[str | None], *meta: list) -> list[list[bytes]]:
        got = [inputs(t, m) for t, m in zip(texts, zip(*meta, strict=True) if meta else [()] * len(texts), strict=True)]
        return [[g[0].tobytes() for g in got], [g[1].tobytes() for g in got]]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(metadata)]).join(F.broadcast(sample), "_id")
    made = map_columns(rows, ["_id", "_label"], [F.col("_text"), *[F.col(f"_{i}") for i in range(len(metadata))]], [("at", "binary"), ("x", "binary")], build)
    got = made.toPandas().sort_values(["_id", "at", "x"])
    machine = FactorisationMachine(n_inputs(len(metadata)))
    y = got["_label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        machine.w0 = 0.0 if not len(y) else (3.0 if y[0] == 1 else -3.0)
        machine.v[:] = 0
        return machine
    data = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(got["at"], got["x"], strict=True)]
    apart = np.arange(len(y)) % 3 == 2
    if min(y[apart].sum(), (1 - y[apart]).sum(), y[~apart].sum(), (1 - y[~apart]).sum()) >= 5:
        machine.fit([d for d, a in zip(data, apart, strict=True) if not a], y[~apart])
        held = [d for d, a in zip(data, apart, strict=True) if a]
        raw = machine.raw(np.concatenate([d[0] for d in held]), np.concatenate([d[1] for d in held]), np.concatenate([[0], np.cumsum([len(d[0]) for d in held])[:-1]]).astype(int))
        cuts = np.unique(raw)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        good, poor = np.sort(raw[y[apart] == 1]), np.sort(raw[y[apart] == 0])
        value = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(poor, cuts) / len(poor)
        best = cuts[value >= value.max() - 1e-9]
        machine.shift = float(np.log(threshold / (1 - threshold)) - np.median(best))
    else:
        machine.fit(data, y)
    return machine


def scored(docs: DataFrame, machine: FactorisationMachine, keep: list[str], text_col: str = "text", metadata: tuple[str, ...] = (), column: str = "score") -> DataFrame:
    """keep's columns and the score of every whole text, in one pass and without a shuffle; null and empty texts get one too."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def score(texts: list[str | None], *meta: list) -> list[np.ndarray]:
        got = [inputs(t, m) for t, m in zip(texts, zip(*meta, strict=True) if meta else [()] * len(texts), strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])[:-1]]).astype(int)
        return [model.value.score(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), starts)]

    return map_columns(docs, keep, [F.col(text_col), *[F.col(c).cast("double") for c in metadata]], [(column, "double")], score)


def accepted(docs: DataFrame, machine: FactorisationMachine, threshold: float = 0.7, text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """docs without the rows that score under the threshold; columns and values stay as they are."""
    return scored(docs, machine, docs.columns, text_col, metadata, "__quality_score").filter(F.col("__quality_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
