"""Learned lemmas against a plain learner, on held-out pairs, and against the four patterns."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sibyl.functions import annotate
from sibyl.operators import lemmas as lm
from sibyl.queries import QUERIES
from sibyl.queries.sequences import GUESSES

BASES = "walk talk jump play plan stop carry marry study copy bake like move race wash watch fix pass kiss city party lady box fox dish class bus cat dog tree house horse".split()


def inflected(w):
    out = [(w + "es" if w.endswith(("s", "x", "ch", "sh")) else w[:-1] + "ies" if w.endswith("y") and w[-2] not in "aeo" else w + "s", w), (w, w)]
    past = w + "d" if w.endswith("e") else w[:-1] + "ied" if w.endswith("y") and w[-2] not in "aeo" else w + "ed"
    return [*out, (past, w), ((w[:-1] if w.endswith("e") else w) + "ing", w)]


def plain(pairs, words, least=2, most=8):
    votes = defaultdict(Counter)
    for form, lemma in pairs:
        if not form or lemma is None:
            continue
        form, lemma = form.lower(), lemma.lower()
        same = max(k for k in range(min(len(form), len(lemma)) + 1) if form[:k] == lemma[:k])
        goes, comes = form[same:], lemma[same:]
        for e in {form[len(form) - k :] for k in range(min(len(form), most) + 1)} | {"^" + form}:
            if e.endswith(goes):
                votes[e][goes, comes] += 1
    best = {e: min(c, key=lambda r: (-c[r], len(r[0]), r)) for e, c in votes.items()}
    best = {e: r for e, r in best.items() if votes[e][r] >= least or e.startswith("^")}
    out = {}
    for w in words:
        low = w.lower()
        fits = ["^" + low] + [low[len(low) - k :] for k in range(min(len(low), most), -1, -1)]
        goes, comes = next((best[e] for e in fits if e in best), ("", ""))
        out[w] = low[: len(low) - len(goes)] + comes or low
    return out


def test_held_out_pairs(spark):
    rng = random.Random(3)
    bases = sorted({a + b for a in BASES for b in BASES[:12]} | set(BASES))
    rng.shuffle(bases)
    seen = [p for b in bases[:200] for p in inflected(b)] + [("went", "go"), ("Children", "child")]
    held = [p for b in bases[200:] for p in inflected(b)]
    rules = lm.learn(spark.createDataFrame([*seen, (None, "x"), ("", "y"), ("z", None)], "form string, lemma string"))
    words = spark.createDataFrame([(f,) for f, _ in [*seen, *held]] + [("GOES",), ("",), (None,), ("went",), ("ß" * 40,)], "word string")
    got = dict(lm.lemmas(words, rules).collect())
    assert got == plain(seen, got) and got["went"] == "go" and got["Children"] == "child"
    share = sum(got[f] == lemma for f, lemma in held) / len(held)
    by_pattern = dict(words.filter("word IS NOT NULL").distinct().select("word", annotate.lemma(F.col("word"))).collect())
    assert share > 0.93 and share > sum(by_pattern[f] == lemma for f, lemma in held) / len(held) + 0.3


@pytest.mark.parametrize("sent", [0, 20])
def test_rules_too_many_to_send(spark, monkeypatch, sent):
    seen = [p for b in BASES for p in inflected(b)]
    rules = lm.learn(spark.createDataFrame(seen, "form string, lemma string"))
    words = spark.createDataFrame([(f,) for f, _ in seen] + [("boxing",), ("ties",)], "word string")
    want = dict(lm.lemmas(words, rules).collect())
    monkeypatch.setattr(lm, "SENT", sent)
    assert dict(lm.lemmas(words, rules).collect()) == want == plain(seen, want)


def test_rules_by_part_of_speech(spark):
    rows = [("V", "saw", "see"), ("N", "saw", "saw"), ("N", "saw", "saw"), ("V", "lights", "light"), ("V", "rights", "right")]
    rules = lm.learn(spark.createDataFrame(rows, "pos string, form string, lemma string"), ["pos"])
    words = spark.createDataFrame([("V", "saw"), ("N", "saw"), ("V", "nights"), ("N", "nights"), ("X", "Tights")], "pos string, word string")
    assert {tuple(r) for r in lm.lemmas(words, rules, ["pos"]).collect()} == {("V", "saw", "see"), ("N", "saw", "saw"), ("V", "nights", "night"), ("N", "nights", "nights"), ("X", "Tights", "tights")}
    none = lm.learn(spark.createDataFrame([], "form string, lemma string"))
    assert lm.lemmas(spark.createDataFrame([("A",)], "word string"), none).collect() == [("A", "a")]


def test_lemmas_of_documents(spark, tmp_path):
    texts = ["She walks and talks; we walk, we talk, he walked. Parties: party!", "Baking, bake, bakes. Moves and moved: move. Zebras", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(QUERIES["corpus_lemmas"].run(spark, str(tmp_path)).collect())
    import re

    vocabulary = {w for t in texts if t for w in re.findall(r"[^\W_]+", t.lower())}
    pairs = []
    for w in vocabulary:
        found = {w[: len(w) - len(g)] + c for g, c in GUESSES if w.endswith(g) and len(w) > len(g) + 2} & vocabulary - {w}
        pairs += [(w, x) for x in found or {w}]
    assert got == plain(pairs, vocabulary) and got["zebras"] == "zebras" and got["parties"] == "party" and got["walked"] == "walk"
