"""Leftmost longest names, by trie and by join, against a plain search."""

import random

import pytest

from sibyl.operators.names import longest_names


def plain(words, names):
    out, i = [], 0
    while i < len(words):
        fit = [n for n in names if tuple(words[i : i + len(n)]) == n]
        if fit:
            best = max(fit, key=len)
            out.append((i, i + len(best) - 1, " ".join(best)))
            i += len(best)
        else:
            i += 1
    return out


@pytest.mark.parametrize("most", [1000, 0])
def test_overlapping_names(spark, most):
    rng = random.Random(7)
    names = {tuple(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {("z", "y")}
    texts = ["", "a", "e e e"] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid int, sentence string")
    listed = spark.createDataFrame([(" ".join(n), "k") for n in names], "name string, kind string")
    got = sorted((r.qid, r.begin, r.end, r.text) for r in longest_names(rows, listed, ["qid"], most=most).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in plain(t.split(), names))


@pytest.mark.parametrize("most", [1000, 0])
def test_any_rows(spark, most):
    rows = spark.createDataFrame([(1, "New  York-City, new york.", "x"), (2, None, "x"), (3, "", "x")], "qid int, sentence string, begin string")
    listed = spark.createDataFrame([("New York", "city"), ("new york city", "place"), ("NEW YORK", "state"), ("New York", "city"), (None, "k"), ("!", "k"), ("absent word", "k")], "name string, kind string")
    got = sorted(map(tuple, longest_names(rows, listed, ["qid"], most=most).collect()))
    assert got == [(1, 0, 2, "new york city", "place"), (1, 3, 4, "new york", "city"), (1, 3, 4, "new york", "state")]
    assert longest_names(rows, listed.limit(0), ["qid"], most=most).isEmpty() and longest_names(rows.limit(0), listed, ["qid"], most=most).isEmpty()
