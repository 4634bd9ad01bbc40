"""The sequence tagger against exhaustive sums over all label paths, and trained on labelled mentions."""

import itertools

import numpy as np
import pytest

from sibyl.operators import candidates, tagging


def exhaustive(scores, moves, first):
    """Marginals, expected moves, log of the sum, and the best path, by going through all paths."""
    n, k = scores.shape
    total, p, pairs, best = 0.0, np.zeros((n, k)), np.zeros((k, k)), (-np.inf, None)
    for path in itertools.product(range(k), repeat=n):
        v = first[path[0]] + sum(scores[i, x] for i, x in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
        best = max(best, (v, path))
        w = np.exp(v)
        total += w
        for i, x in enumerate(path):
            p[i, x] += w
        for a, b in itertools.pairwise(path):
            pairs[a, b] += w
    return p / total, pairs / total, np.log(total), best[1]


@pytest.mark.parametrize("block", [2, 64])
def test_chain_equals_all_paths(monkeypatch, block):
    monkeypatch.setattr(tagging, "CHAIN", block)
    rng = np.random.default_rng(0)
    moves, first, sizes = rng.normal(size=(3, 3)), rng.normal(size=3), [1, 5, 2, 6]
    scores = rng.normal(size=(sum(sizes), 3)) * 2
    got, at, log_z, pairs = tagging.chain(scores, np.array(sizes), moves, first), 0, 0.0, 0
    for n in sizes:
        p, x, z, path = exhaustive(scores[at : at + n], moves, first)
        assert got.marginals()[at : at + n] == pytest.approx(p)
        assert tuple(tagging.best_path(scores[at : at + n], moves, first)) == path
        log_z, pairs, at = log_z + z, pairs + x, at + n
    assert got.log_z == pytest.approx(log_z) and got.moves() == pytest.approx(pairs)


def test_descent_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = tagging.minimised(lambda x: (0.5 * float((x - 1) @ a @ (x - 1)), a @ (x - 1)), np.zeros(3), 60, close=0)
    assert x == pytest.approx(np.ones(3), abs=1e-3)


def test_mentions_are_learned(spark):
    """Names follow 'was' and are two words long: the tag depends on what stands around a word and on the tag before."""
    names, fill = ["alan turing", "ada lovelace", "grace hopper", "emmy noether", "kurt goedel"], ["it", "then", "who", "seen", "by"]
    rng = np.random.default_rng(1)
    rows = []
    for s in range(60):
        words = [*rng.choice(fill, 2), "was", *names[s % 5].split(), *rng.choice(fill, 2)]
        rows += [(s, i, str(w)) for i, w in enumerate(words)]
    tokens = spark.createDataFrame(rows, "sid long, i int, token string")
    mentions = spark.createDataFrame([(s, 3, 4) for s in range(60)], "sid long, begin int, `end` int")
    gold = tagging.gold_tags(tokens, mentions, ["sid"])
    data = tagging.encoded(candidates.context_features(gold, ["sid"], "token"), ["sid"], 4096, tag="tag")
    tagger = tagging.train(data.filter("sid < 40").select("ids", "tags"), ("B", "I", "O"), 4096, rounds=20, decay=0.1)
    out = tagging.tag(data.filter("sid >= 40").drop("tags"), tagger, ["sid"])
    assert {(r.sid, r.i, r.tag) for r in out.collect()} == {(r.sid, r.i, r.tag) for r in gold.filter("sid >= 40").collect()}
    assert out.filter("prob < 0.7 OR prob > 1").count() == 0
    chunks = candidates.bio_chunks(out.join(tokens, ["sid", "i"]), ["sid"]).collect()
    assert sorted((r.sid, r.begin, r.end, r.text) for r in chunks) == [(s, 3, 4, names[s % 5]) for s in range(40, 60)]


def test_gradient_is_the_slope_of_the_cost(spark, monkeypatch):
    rows = [(0, [[1], [2, 3], []], ["B", "I", "O"]), (1, [[3]], ["O"]), (2, [[1], [1]], ["O", "B"]), (3, [], []), (4, [[1]], [None]), (5, [[1]], ["X"])]
    data = spark.createDataFrame(rows, "sid long, ids array<array<int>>, tags array<string>")
    seen = {}
    monkeypatch.setattr(tagging, "minimised", lambda cost, x, rounds: seen.update(cost=cost) or x)
    tagging.train(data, ("B", "I", "O"), 4, decay=0.5)
    x = np.random.default_rng(2).normal(size=4 * 3 + 9 + 3)
    value, slope = seen["cost"](x)
    for i in (0, 5, 11, 13, 20, 23):
        e = np.zeros(len(x))
        e[i] = 1e-5
        assert (seen["cost"](x + e)[0] - value) / 1e-5 == pytest.approx(slope[i], abs=1e-3)


def test_without_rows(spark):
    none = spark.createDataFrame([], "sid long, places array<int>, ids array<array<int>>, tags array<string>")
    tagger = tagging.train(none, ("B", "O"), 16)
    assert not tagger.weights.any() and tagging.tag(none, tagger, ["sid"]).count() == 0
    blank = spark.createDataFrame([(1, [0, 1], [[], []])], "sid long, places array<int>, ids array<array<int>>")
    assert [round(r.prob, 6) for r in tagging.tag(blank, tagger, ["sid"]).collect()] == [0.5, 0.5]


def test_paths_of_many_sequences():
    rng = np.random.default_rng(3)
    moves, first, sizes = rng.normal(size=(3, 3)), rng.normal(size=3), np.array([3, 1, 7, 3, 2])
    scores, at = rng.normal(size=(sizes.sum(), 3)), 0
    got = tagging.best_paths(scores, sizes, moves, first)
    for n in sizes.tolist():
        assert tuple(got[at : at + n]) == exhaustive(scores[at : at + n], moves, first)[3]
        at += n


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_one_pass_is_as_the_tables(spark, monkeypatch, block):
    """What the query finds without a shuffle is what tokens, features, tags and chunks as tables give, with ids that repeat or are null too."""
    from pyspark.sql import functions as F

    from sibyl.functions import text as tx
    from sibyl.queries import sequences as sq

    monkeypatch.setattr(tagging, "TOKENS", block)
    texts = ["Anna Berg met Über Karl. then 12 dogs ran! ", "", None, "...", "Ada Lovelace Und éa X y Z. \nOne. Two Three Four five", "ǅungla a " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tagger = tagging.Tagger(("B", "I", "O"), sq.BUCKETS, np.random.default_rng(0).normal(size=sq.BUCKETS * 3 + 12))
    keys = ["doc_id", "sent"]
    words = sq._tokens(docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent", "sentence")), keys, "sentence")
    tags = tagging.tag(tagging.encoded(sq._features(words, keys), keys, sq.BUCKETS), tagger, keys)
    want = {tuple(r)[:5] + (round(r.score, 6),) for r in candidates.bio_chunks(tags.join(words, [*keys, "i"]), keys).collect()}
    lines = docs.select("doc_id", F.transform(tx.sentences(F.col("text")), tx.spaced_words).alias("s"))
    got = tagging.mentions(lines, tagger, "doc_id", "s", sq._shaped_ids)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r)[:5] + (round(r.score, 6),) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 20
