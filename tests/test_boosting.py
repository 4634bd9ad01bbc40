"""Boosted trees of few leaves against a plain version that tries every split of every leaf."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sibyl.operators import boosting, scoring

KIND = "qid long, a double, b double, c double, class int"


def values(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(-6, 6, n) / 2, (rng.random(n) < 0.05) * rng.integers(1, 4, n)], 1).astype(float)
    p = 1 / (1 + np.exp(-((x[:, 0] > 5) * 2.0 - (x[:, 1] > 0) * 1.5 + (x[:, 2] > 0) * 2 - 1)))
    return x, (rng.random(n) < p).astype(int)


def plain(x, y, trees, leaves, rate, least_split=10, least_leaf=5):
    """Scores by opening the best leaf after the other, every split tried."""
    w = np.where(y > 0, 0.5 * len(y) / y.sum(), 1.0)
    score = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))

    def split(rows, r):
        best = (0.0, None)
        if len(rows) >= least_split:
            for f in range(x.shape[1]):
                for t in np.unique(x[rows, f])[:-1]:
                    a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    if min(len(a), len(b)) >= least_leaf:
                        wa, wb = w[a].sum(), w[b].sum()
                        gain = wa * wb / (wa + wb) * ((w[a] * r[a]).sum() / wa - (w[b] * r[b]).sum() / wb) ** 2
                        if gain > best[0] + 1e-10:
                            best = (gain, (a, b))
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        r = y - p
        ends = [np.arange(len(y))]
        while len(ends) < leaves:
            found = [split(e, r) for e in ends]
            best = int(np.argmax([g for g, _ in found]))
            if not found[best][1]:
                break
            ends[best : best + 1] = found[best][1]
        for e in ends:
            score[e] += rate * (w[e] * r[e]).sum() / (w[e] * p[e] * (1 - p[e])).sum()
    return 1 / (1 + np.exp(-score))


@pytest.fixture(scope="module")
def table(spark):
    x, y = values()
    return x, y, spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], KIND).repartition(3)


@pytest.mark.parametrize("leaves", [2, 6])
def test_as_the_plain_version(table, leaves):
    x, y, rows = table
    model, losses = boosting.train(rows, ["a", "b", "c"], trees=6, leaves=leaves, rate=0.3, sampled=3, kept=4)
    model = scoring.parse_forest("// a comment\n" + json.dumps(model))
    got = dict(rows.select("qid", scoring.forest_score(model)).collect())
    assert [got[i] for i in range(len(y))] == pytest.approx(plain(x, y, 6, leaves, 0.3), abs=1e-9)
    assert len(losses) == 6 and all(b < a for a, b in zip(losses, losses[1:], strict=False))
    assert max(sum(c < 0 for c in t["children_left"]) for t in model["forest"]) == leaves


def test_sampled_features_and_other_partitions(table):
    x, y, rows = table
    one, _ = boosting.train(rows, ["a", "b", "c"], trees=5)
    two, _ = boosting.train(rows.repartition(2), ["a", "b", "c"], trees=5)
    assert [t["features"] for t in one["forest"]] == [t["features"] for t in two["forest"]]
    assert [t["thresholds"] for t in one["forest"]] == [t["thresholds"] for t in two["forest"]]
    score = dict(rows.select("qid", scoring.forest_score(one)).collect())
    right = [score[i] for i in range(len(y)) if y[i]]
    assert np.mean(right) > np.mean([score[i] for i in range(len(y)) if not y[i]]) + 0.05


def test_any_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0, 0.0, 1), (2, float("nan"), 1.0, None, 0), (3, 2.0, 1.0, 1.0, None), (4, float("inf"), 1.0, 0.0, 1)], KIND)
    model, losses = boosting.train(rows, ["a", "b", "c"], trees=2, least_split=2, least_leaf=1)
    assert len(model["forest"]) == 2 and losses[1] <= losses[0]
    assert boosting.train(rows.limit(0), ["a"])[0] == {"prior": 0.0, "learning_rate": 0.1, "labels": ["a"], "forest": []}
    assert boosting.train(rows.filter("class = 1"), ["a"])[0]["prior"] == 30.0
    assert boosting.train(rows.filter("class = 0"), ["a"])[0]["prior"] == -30.0
    same = boosting.train(rows, ["b"], trees=2)
    assert same[0]["forest"] == [] and same[1] == []
    odd = rows.withColumn("@x.y", F.col("qid").cast("double"))
    assert boosting.train(odd, ["@x.y"], trees=1, least_split=2, least_leaf=1)[0]["labels"] == ["@x.y"]
