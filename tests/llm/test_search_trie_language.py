"""Ranked search, the conversation trie and language identification against brute force, and on nulls, ties, repeated rows, empty and long texts."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sibyl.llm import conversations, language_id, lexical, queries

DIR = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute_search(docs, items, k=10):
    tokens = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for *_, n in tokens), sum(n for *_, n in tokens)
    df = Counter(t for _, c, _ in tokens for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in tokens:
            m = 100 - 75 + (75 * n * n_docs) // max(1, length)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcÉßx") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    docs = [(rng.randint(0, 10**6), " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(1, 80)))) for _ in range(n)]
    docs += [docs[3], docs[3], (docs[3][0], "another a b"), (None, docs[5][1]), (None, docs[5][1]), (7, None), (8, ""), (9, "... --"), (10, "the-Word Ünd İ 名前 a_b"), (11, "a " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(20)]
    items += [items[0], (None, "ab a a"), (50, None), (51, "nowhere"), (52, "名前 İ ünd THE word b")]
    return docs, items


@pytest.mark.parametrize("shard_docs", [1, 7, 2_048])
def test_search_equals_brute_force(spark, shard_docs):
    docs, items = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("own")).withColumn("score", F.lit(1))
    index = lexical.build(rows, shard_docs=shard_docs)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    want = brute_search(docs, items)
    assert sorted(map(tuple, lexical.search(index, asked).collect()), key=str) == want
    # queries in several blocks
    assert sorted(map(tuple, lexical.search(index, asked, block=5).collect()), key=str) == want


def test_search_breaks_ties_by_id(spark):
    docs = [(i, "same text here") for i in (9, 2, 7, 4, 30, 12, 1, 5, 8, 3, 6, 11)] + [(i, "other") for i in range(100, 140)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), shard_docs=5)
    found = lexical.search(index, spark.createDataFrame([(1, "text")], "item_id long, text string"), k=6)
    assert [r.doc_id for r in sorted(found.collect(), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5, 6]


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    none, blank = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for docs in (none, blank):
        assert lexical.search(lexical.build(docs), items).count() == 0
    assert lexical.search(lexical.build(spark.createDataFrame([(1, "a")], "doc_id long, text string")), items.limit(0)).count() == 0


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, t in own.items():
        h = crc32(str(c).encode()) % 9
        anchor = c - int(math.fmod(c, 5))
        rebuilt[c] = own.get(anchor, [])[:h] + t[h:]
    members, ends = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(1 for x in members if x and x[:-1] == node), sum(x not in kids for x in below), saved, digest))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def talks(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 40), 1_000_000_007]:
        if c % 7 != 3:
            rows += [(c, i, rng.choice(["user", "assistant"]), rng.choice(["hi", "tell é me", "no"])) for i in range(rng.randint(1, 14))]
    rows += [(55, None, None, None), (55, 2, None, "x"), (55, 2, "a", "x"), (55, 2, "a", None), (55, None, "b", "y"), (None, 1, "user", "lost"), (56, 0, "user", "z" * 50_000), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("run,fan", [(2, 2), (4096, 16)])
def test_trie_equals_brute_force(spark, monkeypatch, run, fan):
    monkeypatch.setattr(conversations, "RUN", run)
    monkeypatch.setattr(conversations._merged, "__defaults__", (fan,))
    rows = talks()
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("depth", F.lit(1)).withColumn("part", F.lit("own"))
    out = conversations.trie(*conversations.rebuilt(df)).collect()
    assert sorted(map(tuple, out), key=str) == brute_trie(rows)


def test_trie_of_long_and_missing_conversations(spark):
    long_ = [(5, i, "user", f"turn {i % 3}") for i in range(3_000)]
    assert sorted(map(tuple, conversations.trie(*conversations.rebuilt(spark.createDataFrame(long_[:300], CONVERSATIONS))).collect()), key=str) == brute_trie(long_[:300])
    rows = conversations.trie(*conversations.rebuilt(spark.createDataFrame(long_, CONVERSATIONS))).filter("n_leaves = 1")
    assert rows.count() == 3_001 and rows.agg(F.max("depth")).first()[0] == 3_000
    assert conversations.trie(*conversations.rebuilt(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    # every turn falls away: one conversation, at the root
    alone = next(c for c in range(1, 100) if c % 5 and crc32(str(c).encode()) % 9 > 1)
    out = conversations.trie(*conversations.rebuilt(spark.createDataFrame([(alone, 0, "user", "x")], CONVERSATIONS))).collect()
    assert [tuple(r) for r in out] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


@pytest.mark.parametrize("name", ["op11_dual_sorted_search", "op12_conversation_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(cur.fetchall(), key=str)


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    return docs, language_id.fit(docs.filter("doc_id % 4 <> 2"), texts=40, rounds=12)


def test_languages_held_out(languages):
    docs, model = languages
    out = language_id.labelled(docs, model, ["doc_id", "lang"]).filter("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_switches_inside_a_text_are_found(spark, languages):
    docs, model = languages
    texts = {r.lang: " ".join(r.text.split()[:30]) for r in docs.filter("size(split(text, ' ')) > 60").orderBy("doc_id").collect()}
    mixed = " ".join(texts[x] for x in ("de", "fr", "en"))
    (row,) = language_id.spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, ["doc_id"]).collect()
    by_word = [s.lang for s in row.spans for _ in range(s.end - s.begin)]
    assert len(by_word) == 90 and sum(a == b for a, b in zip(by_word, ["de"] * 30 + ["fr"] * 30 + ["en"] * 30, strict=True)) >= 80
    assert model.tagger.parts[1].diagonal().min() > 0 > (model.tagger.parts[1] - 99 * np.eye(4)).max()


def test_languages_of_any_rows(spark, languages):
    _, model = languages
    rows = [(1, None), (2, ""), (3, " \n 12 -- !"), (4, "the " * 30_000), (None, "the and of"), (4, "é"), (6, "a" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("k0", F.lit(1))
    out = language_id.labelled(docs, model, ["doc_id", "text"]).collect()
    assert len(out) == len(rows) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert all(r.score == 0 for r in out if r.lang_pred == "und") and next(r.lang_pred for r in out if r.text and len(r.text) == 120_000) == "en"
    assert sum(len(r.spans) for r in language_id.spans(docs, model, ["doc_id"]).collect()) >= 4
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    blank = language_id.fit(none)
    assert {(r.lang_pred, r.score) for r in language_id.labelled(docs, blank, ["doc_id"]).collect()} == {("und", 0.0)}
    assert language_id.labelled(none, model, ["doc_id"]).count() == 0
    odd = spark.createDataFrame([(None, "a", "en"), (1, None, "en"), (2, "b c", None), (3, "d e", "xx"), (3, "d e", "xx"), (3, "f", "yy")], "doc_id long, text string, lang string")
    assert language_id.fit(odd, rounds=2).languages == ("xx", "yy")


def test_long_texts_are_cut_in_parts(languages, monkeypatch):
    _, model = languages
    words = [b"the", b"und", b"le"] * 40
    monkeypatch.setattr(language_id, "MOST_AT_ONCE", 50)
    got = list(model.word_probabilities([words, [b"x"], []]))
    assert [(i, len(p)) for i, p, _ in got] == [(0, 50), (0, 50), (0, 20), (1, 1)]


def test_a_letterless_word_has_no_feature():
    owner, ids = language_id.features(["ab", "", "c"], {"c": (1,)})
    assert owner.tolist() == [0] * 6 + [2] * 4 and ids.max() < language_id.BUCKETS
