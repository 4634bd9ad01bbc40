"""Models of all labels at once against the conditions of a minimum, worked out apart for each label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sibyl.operators import multilabel as ml

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1, 20, 0.1] + [0, 5, 0]
    p = 1 / (1 + np.exp(-np.stack([2 * x[:, 0], 0.1 * (x[:, 1] - 5), np.full(300, -1.0)], 1)))
    y = rng.random((300, 3)) < p
    rows = [(i, *map(float, v), [c for c, has in zip(["one", "two", "noise"], u, strict=True) if has] + ["every"]) for i, (v, u) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "qid long, a double, b double, c double, labels array<string>").repartition(3)


def test_each_label_is_at_its_minimum(table):
    x, y, rows = table
    models = ml.train(rows, FEATURES, l1=0.02, steps=400, close=1e-8)
    assert models.labels == ("every", "noise", "one", "two")
    z = (x - x.mean(0)) / x.std(0)
    for at, label in enumerate(["one", "two", "noise"]):
        w = models.weights[models.labels.index(label)]
        have = y[:, at].astype(float)
        weight = np.where(have == 1, 0.5 / have.sum(), 0.5 / (1 - have).sum())
        error = (1 / (1 + np.exp(-(x @ w[:3] + w[3]))) - have) * weight
        scaled, slope = w[:3] * x.std(0), error @ z
        assert error.sum() == pytest.approx(0, abs=1e-4)
        for v, g in zip(scaled, slope, strict=True):
            assert (g == pytest.approx(-0.02 * np.sign(v), abs=1e-4)) if v else abs(g) <= 0.02 + 1e-4
    by = models.by_label()
    assert by["one"]["a"] > 0.5 and by["every"] == {"_": 30.0}
    # a higher penalty leaves what decides
    sparse = ml.train(rows, FEATURES, l1=0.15).by_label()
    assert set(sparse["one"]) == {"a", "_"} and set(sparse["noise"]) == {"_"}


def test_ranks(table):
    _, _, rows = table
    models = ml.train(rows, FEATURES, labels=["one", "two"])
    out = ml.ranked(rows, models, ["qid"], least=0.0).collect()
    assert len(out) == 600 and {r["rank"] for r in out} == {1, 2}
    scores = {(r.qid, r["rank"]): r.score for r in out}
    assert all(scores[q, 1] >= scores[q, 2] for q in range(300))


def test_any_rows(spark):
    odd = spark.createDataFrame([(1, None, ["x"]), (2, 1.0, None), (3, 2.0, []), (3, 2.0, ["x", "x", None])], "qid long, a double, labels array<string>")
    models = ml.train(odd, ["a"], steps=5)
    assert models.labels == ("x",) and np.isfinite(models.weights).all()
    none = ml.train(odd.limit(0), ["a"])
    assert none.labels == () and none.weights.shape == (0, 2)
    assert ml.train(odd.limit(0), ["a"], labels=["x"], steps=2).by_label() == {"x": {"_": -30.0}}
    assert ml.train(odd.withColumn("a", F.lit(1.0)), ["a"], steps=3).weights.shape == (1, 2)
