"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import uuid
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sibyl.llm import components, mixing, near_copies, ngram_lm, packing, paragraphs, pivot_search, quality, queries, rules, sharding, simhash, store, suffix

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample(n=40, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        out.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
    out[7] = (7, out[5][1], "en", "s3", 0)
    return out


def messy():
    """Nulls in every column, empty, blank and long texts, repeated rows, shared ids, no id."""
    rows = sample(20)
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s1", 3), (103, "word " * 30_000, "en", "s0", 150_000), (104, "x", "en", None, 1)]
    rows += [rows[3], rows[3], (3, "other text of the same id", "en", "s1", 5), (None, rows[3][1], "en", "s1", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(messy(), DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(docs):
    """Columns named like the helpers' own."""
    names = ["shard", "slot", "score", "fp", "component_id", "_text", "_id", "key", "size", "target", "copies", "kept", "n_words", "Score2", "k0", "x0", "row", "value"]
    out = docs
    for c in names:
        out = out.withColumn(c, F.lit("own"))
    return out


def test_sharding(spark, docs, empty, clashing):
    out = sharding.shard_documents(docs, [1.0] * 4).collect()
    assert len(out) == len(messy())
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    for r in out:
        key = "null" if r.doc_id is None else str(r.doc_id)
        u = lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: E731, B023
        assert r["shard"] == max(range(4), key=lambda i: -1 / math.log(u(i))) and r.grown_shard in (r["shard"], 4)
    sizes = Counter((d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t, *_ in messy())
    assert sizes == Counter((r.doc_id, r["size"], r.text_crc32) for r in out)
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    shares = {r["shard"]: r["count"] / 20_000 for r in sharding.shard(ids, "doc_id", [1, 3]).groupBy("shard").count().collect()}
    assert shares[1] == pytest.approx(0.75, abs=0.02)
    assert sharding.shard_documents(empty, [1.0]).count() == 0 and sharding.shard_documents(clashing, [1.0, 2.0]).count() == len(messy())


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = (left - sum(full.values())) / max(1e-12, sum(w[s] for s in open_)) if open_ else 0
        over = [s for s in open_ if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | {s: level * w[s] for s in open_}
        full |= {s: most * sizes[s] for s in over}


def test_mixing(spark, docs, empty, clashing):
    out = mixing.copies(docs, (3, 1, 2)).collect()
    assert len(out) == len(messy()) and sorted(map(str, out)) == sorted(map(str, mixing.copies(docs, (3, 1, 2)).collect()))
    sizes = Counter()
    for _, t, _, s, _ in messy():
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes), (3, 1, 2), 1.5, 2.0)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r._source] and r.target == pytest.approx(want[r._source], abs=1e-6) and r.copies <= 2
        taken[r._source] += r.copies * r["size"]
    most = {s: max(r["size"] for r in out if r._source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes if want[s] > 0)
    mixed = mixing.mix(docs, (3, 1, 2))
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(empty, (1,)).count() == 0 and mixing.mix(clashing, (3, 1, 2)).columns == clashing.columns


def test_mixing_comes_near_its_targets(spark):
    out = queries.op8_pareto_mixing(spark, DIR).toPandas()
    by = out.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), most=("size", "max"), n=("target", "size")).reset_index()
    assert ((by.taken - by.target * by.n / 10).abs() <= by.most / 2).all() and (out.taken <= 2 * out["size"]).all()
    again = queries.op8_pareto_mixing(spark, DIR).toPandas()
    assert sorted(map(tuple, out.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def test_mixing_includes_documents_as_often_as_wanted(spark):
    """Over many seeds, documents of every length are taken as often as expected; expected words add up to the target."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([3, 20, 100, 400, 1500]), "en", f"s{i % 2}", 0) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    runs = [mixing.copies(df, (3, 2), seed=k).toPandas() for k in range(12)]
    one = runs[0]
    for _, g in one.groupby("_source"):
        assert (g.expected * g["size"]).sum() == pytest.approx(g.target.iloc[0])
    rates = sum(r.groupby(["_source", "size"]).copies.mean() for r in runs) / len(runs)
    wanted = one.groupby(["_source", "size"]).expected.mean()
    assert wanted.groupby("_source").nunique().min() >= 4 and ((rates - wanted).abs() < 0.08).all()
    for r in runs:
        assert (r.copies >= np.floor(r.expected)).all() and (r.copies <= np.ceil(r.expected)).all()


def test_rule_statistics(docs, empty, clashing):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)

    rule = [(rules.Condition("symbols_per_word", True, 0.5),)]
    out = rules.judged(docs, rule, ["doc_id", "text"]).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert rules.judged(empty, rule, ["doc_id"]).count() == 0 and rules.judged(clashing, rule, ["doc_id", "score"]).count() == len(messy())


def test_rules_are_learned():
    rng = np.random.default_rng(0)
    x = {"mean_word": rng.uniform(2, 9, 900), "symbols_per_word": rng.uniform(0, 1, 900)}
    poor = ((x["mean_word"] > 6) & (x["symbols_per_word"] > 0.5)) | (x["mean_word"] < 2.5)
    found = rules.learn(x, poor)
    took = np.zeros(900, bool)
    for r in found:
        took |= rules._covered(r, x, 900)
    assert (took == poor).mean() > 0.97 and rules.learn(x, np.zeros(900, bool)) == []


@pytest.mark.parametrize("query", [queries.op1_factorisation_machine, queries.op7_decision_list])
def test_held_out_quality(spark, query):
    sf = "/root/testdata/sf0.01"
    out = query(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    got = out.join(labels, how="inner")
    assert len(out) == 1000
    if "predicted" in got:
        got = got[got.held_out]
        assert ((got.score >= 0.7).astype(int) == got.predicted).all()
        assert (got[got.quality == 1].predicted == 1).mean() > 0.95 and (got[got.quality == 0].predicted == 0).mean() > 0.7
    else:
        fair = got[~got.base_failed]
        assert fair[fair.quality == 1].kept.mean() > 0.95 and (~got[got.quality == 0].kept).mean() > 0.8


def test_factorisation_machine(spark, docs, empty, clashing):
    m = quality.FactorisationMachine(50)
    rng = np.random.default_rng(4)
    m.w, m.v = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, quality.FACTORS)).astype(np.float32)
    at, x = np.array([3, 7, 20, 5, 9]), np.array([1, 0.5, 2, 1, 1], np.float32)
    pairs = lambda a, v: sum(float(m.v[a[i]] @ m.v[a[j]]) * v[i] * v[j] for i in range(len(a)) for j in range(i))
    want = [float(m.w[a] @ v) + pairs(a, v) for a, v in ((at[:3], x[:3]), (at[3:], x[3:]))]
    assert m.raw(at, x, np.array([0, 3])) == pytest.approx(want, rel=1e-4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, labels, metadata=("n_chars",))
    out = quality.scored(docs, fitted, ["doc_id"], metadata=("n_chars",)).collect()
    assert len(out) == len(messy()) and all(0 <= r.score <= 1 for r in out)
    none = quality.fit(docs, labels.limit(0))
    assert quality.scored(empty, none, ["doc_id"]).count() == 0 and {r.score for r in quality.scored(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.accepted(clashing, none, 0.4).columns == clashing.columns


def fingerprint(t, n=4):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    s = [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s if x]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(docs, empty, clashing):
    out = simhash.near_duplicates(docs).collect()
    rows = messy()
    fps = [fingerprint(t) for _, t, *_ in rows]
    assert Counter((d, f) for (d, *_), f in zip(rows, fps, strict=True)) == Counter((r.doc_id, r.fp % 2**64) for r in out)
    label = {f: f for f in fps}
    for _ in fps:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (d, *_), f in zip(rows, fps, strict=True):
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    assert all(r.component_id == least.get(label[r.fp % 2**64]) for r in out)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(clashing).count() == len(messy())


def jaccard(s, t):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (s.lower().split(), t.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [4, 2048])
def test_near_copies_by_shingles(spark, block):
    rng = random.Random(8)
    rows, copies, far = [], set(), set()
    for g in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((10 * g, " ".join(words), "en", "s0", 0))
        for k, least in enumerate((0.8, 0.85, 0.9, 0.6), 1):
            edited, order = list(words), rng.sample(range(400), 400)
            for at in order:  # edits as long as the similarity stays
                tried = [*edited[:at], f"x{rng.randrange(10**6)}", *edited[at + 1 :]]
                if jaccard(rows[-k][1], " ".join(tried)) < least:
                    break
                edited = tried
            (copies if k < 4 else far).add(10 * g + k)
            rows.append((10 * g + k, " ".join(edited), "en", "s0", 0))
    assert all(least <= jaccard(rows[5 * g][1], rows[5 * g + k][1]) < least + 0.02 for g in range(20) for k, least in ((1, 0.8), (2, 0.85), (3, 0.9), (4, 0.6)))
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS), block=block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, *_ in rows} - copies)
    assert sum((fingerprint(rows[5 * g][1], 5) ^ fingerprint(rows[5 * g + 1][1], 5)).bit_count() > 4 for g in range(20)) > 10


def test_near_copies_of_any_rows(docs, empty, clashing):
    assert near_copies.keep_one(empty).count() == 0
    kept = near_copies.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.filter("doc_id = 7").count() == 0 and kept.filter("doc_id IS NULL").count() == 2
    kept = near_copies.keep_one(docs)
    assert kept.filter("doc_id IN (100, 101, 102)").count() == 1
    assert sorted(r.text == "other text of the same id" for r in kept.filter("doc_id = 3").collect()) == [False, True]


def test_golay_keys_lose_no_pair():
    patterns = simhash.near_patterns()
    assert Counter((patterns >= 0).sum(1)) == {1: 277, 6: 1771}
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 400)
    for bits in (0, 1, 2):
        other = words.copy()
        for _ in range(bits):
            other ^= 1 << rng.integers(0, 23, 400)
        a, b = simhash.codeword_indices(words, patterns), simhash.codeword_indices(other, patterns)
        assert all({*x} & {*y} - {-1} for x, y in zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("block", [4, 32_768])
def test_dense_groups_of_fingerprints(spark, block):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 3))) for b in base for _ in range(60)}
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect()
    assert all((r.a ^ r.b).bit_count() <= 4 for r in links)
    par = {f: f for f in fps}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for r in links:
        par[find(r.a)] = find(r.b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i + 1, i) for i in range(300)]
    pairs = chain + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5, 5), (None, 1), (7000, 7001), (7000, 7001)]
    got = dict(components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(301)) and got[7001] == 7000 and None not in got
    assert all(got[a] == got[b] for a, b in pairs if a is not None and a != b)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_paragraphs(rows, least=20):
    """Brute force: every two paragraphs are compared by their shingles."""
    items = {}
    for d, t, *_ in rows:
        if d is not None and t is not None:
            w, c = t.encode().split(), paragraphs.cut([t])
            for a, n in zip(c.begin.tolist(), c.n_words.tolist(), strict=True):
                p = w[a : a + n]
                items[d, t, a, n] = {tuple(p[k : k + 5]) for k in range(n - 4)}
    keys, par = sorted(items), {}

    def find(x):
        while par.get(x, x) != x:
            x = par[x]
        return x

    for a in keys:
        for b in keys:
            x, y = items[a], items[b]
            if a < b and len(x & y) >= 0.8 * len(x | y):
                u, v = sorted((find(a), find(b)))
                par[v] = u
    gone, out = {}, set()
    for k in keys:
        if find(k) != k:
            gone.setdefault(k[:2], []).append(k)
    for places in gone.values():
        run, reach = [], 0
        for k in [*places, (None, None, math.inf, 0)]:
            if run and k[2] > reach:
                if reach - run[0][2] >= least:
                    out |= {(r[0], r[2], r[3], find(r)[0], find(r)[2], False) for r in run}
                    out |= {(h[0], h[2], h[3], h[0], h[2], True) for h in map(find, run)}
                run = []
            run.append(k)
            reach = max(reach, k[2] + k[3]) if len(run) > 1 else k[2] + k[3]
    return out


@pytest.mark.parametrize("block", [4, 8192])
def test_paragraphs(spark, empty, clashing, block):
    rows = [r for r in messy() if r[:2] != (3, "other text of the same id")]
    words = sample(9, 9)[0][1].split()
    base = (words * 40)[:90]
    for i in range(12):  # a chain of edited copies
        edited = list(base)
        edited[5 * i % 90 : 5 * i % 90 + 2] = ["x" * (i + 2), "y"]
        rows.append((200 + i, "intro\n" + " ".join(edited), "en", "s0", 0))
    out = paragraphs.repeated(spark.createDataFrame(rows, DOCS), block=block).collect()
    assert {tuple(r) for r in out} == near_paragraphs(rows) and len(out) == len({tuple(r) for r in out})
    assert paragraphs.repeated(empty).count() == 0
    cut = paragraphs.without_repeats(clashing)
    assert cut.columns == clashing.columns and cut.filter("doc_id = 7").count() == 0
    assert cut.filter("doc_id = 3 AND text = 'other text of the same id'").count() == 1 and cut.filter("doc_id IS NULL").count() == 2


def test_texts_are_cut_alike_wherever_they_stand():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bc", "def.", "g\nh", "ijk!", "lm"]) for _ in range(rng.randint(0, 120))) for _ in range(40)] + [None, "", " \n"]
    alone = [paragraphs.cut([t]) for t in texts]
    both = paragraphs.cut(texts)
    for i, c in enumerate(alone):
        own = both.text == i
        assert (both.begin[own].tolist(), both.n_words[own].tolist(), both.pid[own].tolist()) == (c.begin.tolist(), c.n_words.tolist(), c.pid.tolist())
        units = sorted((a, a + n) for a, n in zip(c.begin.tolist(), c.n_words.tolist()))
        words = (texts[i] or "").split()
        assert all(b - a >= 5 and b <= len(words) for a, b in units)
        whole = [0] * len(words)
        for a, b in units:
            whole[a:b] = [1] * (b - a)
        assert whole.count(0) < 5  # only what is left at the end may be short


def test_texts_are_cut_once(spark, tmp_path, monkeypatch):
    plain = paragraphs.cut

    def counted(texts, *more):
        (tmp_path / uuid.uuid4().hex).write_text(str(len(texts)))
        return plain(texts, *more)

    monkeypatch.setattr(paragraphs, "cut", counted)
    rows = [r for r in messy() if r[0] is not None and r[1] is not None]
    assert paragraphs.repeated(spark.createDataFrame(rows, DOCS)).count()
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == len(rows)


def test_words_met_before_keep_their_hashes():
    rng = random.Random(5)
    words = [b"a", b"bc", b"12345678", b"123456789", b"x" * 63, b"x" * 64, b"x" * 65, b"z" * 300, "\u65e5\u672c".encode(), b"\x00", b"\x1f", b"a\x00", *[str(i).encode() for i in range(3000)]]
    met = paragraphs.Met()
    for _ in range(20):
        own = [rng.choice(words) for _ in range(2000)]
        letters = np.frombuffer(b"".join(w + rng.choice([b" ", b"\n", b" \t\r", b"\x0b\x0c"]) for w in own), np.uint8)
        _, starts, ends = paragraphs._words(letters)
        assert [letters[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == own
        assert met.find(letters, starts, ends).tolist() == [xxhash.xxh3_64_intdigest(w) for w in own]
        quick = paragraphs._quick_hashes(letters, starts, ends).tolist()
        assert len(set(quick)) == len(set(own)) == len(set(zip(quick, own, strict=True)))


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_shared_bands_are_those_of_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(paragraphs, "HELD", held)
    rows = [r for r in messy() if r[0] is not None and r[1] is not None]
    texts = spark.createDataFrame(rows, DOCS).select("doc_id", F.xxhash64("text").alias("row"), "text").repartition(3)
    holders, places = {}, {}
    for d, t, *_ in rows:
        c = paragraphs.cut([t])
        keys = paragraphs.band_keys(paragraphs._shingles(c.hashes), c.at, c.at + c.n_words - 4, 4, 2).view(np.uint64) >> np.uint64(16)
        for own, a, n, pid in zip(keys.tolist(), c.begin.tolist(), c.n_words.tolist(), c.pid.tolist(), strict=True):
            places[pid] = [*places.get(pid, []), (d, a, n)]
            for k in own:
                holders.setdefault(k, set()).add(pid)
    equal = {p for p, at in places.items() if len(at) > 1}
    banded = {p for own in holders.values() if len(own) > 1 for p in own}
    signed = paragraphs._signed(texts, 4, 2)
    shared = paragraphs._shared_bands(signed, 4)
    got = shared.collect()
    assert {r.pid for r in got if r.key is None} == equal and equal - banded
    pairs = [(r.key, r.pid) for r in got if r.key is not None]
    assert sorted(pairs) == sorted((k, p) for k, own in holders.items() if len(own) > 1 for p in own) and pairs
    found = paragraphs._places(signed, shared).collect()
    assert sorted((r.pid, r.banded, r.doc_id, r.begin, r.n_words) for r in found) == sorted((p, p in banded, *at) for p in equal | banded for at in places[p])


def test_similar_sets_are_linked():
    rng = random.Random(4)
    for size in (2, 30):
        base = [rng.sample(range(400), rng.randint(1, 40)) for _ in range(4)]
        sets = []
        for i in range(size):
            s = set(base[i % 4])
            for _ in range(rng.randint(0, 4)):
                s ^= {rng.randrange(400)}
            sets.append(np.array(sorted(s or {1}), np.uint64))
        par = list(range(size))

        def find(x, par=par):
            while par[x] != x:
                x = par[x]
            return x

        a, b = paragraphs.linked(np.arange(size), sets, 0.8)
        for x, y in zip(a, b, strict=True):
            assert len(set(sets[x]) & set(sets[y])) >= 0.8 * len(set(sets[x]) | set(sets[y]))
            par[find(x)] = find(y)
        for x in range(size):
            for y in range(size):
                if len(set(sets[x]) & set(sets[y])) >= 0.8 * len(set(sets[x]) | set(sets[y])):
                    assert find(x) == find(y)


def test_planted_passages_are_found(spark):
    """Passages of 51 to 70 words at any place of other texts: nine in ten or more are found, and clean texts with a stock sentence stay."""
    rng = random.Random(21)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    sentence = lambda: " ".join([rng.choice(vocabulary) for _ in range(rng.randint(5, 16))]) + "."
    text = lambda n: " ".join(sentence() for _ in range(n)).split()
    rows, planted = [], set()
    for i in range(150):
        words = text(rng.randint(5, 40))
        if i % 3 == 0:
            p = text(12)
            at = rng.randrange(len(p) - 75)
            passage = p[at : at + rng.randint(51, 70)]
        if i % 3 < 2:
            at = rng.randrange(len(words))
            words[at:at] = passage
            planted |= {i} if i % 3 == 1 else set()
        else:
            words += "This stock sentence of nine words is everywhere here.".split()
        rows.append((i, " ".join(words), "en", "s0", 0))
    out = paragraphs.repeated(spark.createDataFrame(rows, DOCS)).filter("NOT kept").collect()
    got = {r.doc_id for r in out}
    assert len(got & planted) >= 0.9 * len(planted) and not got - planted


def test_passages_inside_long_and_over_short_lines(spark, empty, clashing):
    rng = random.Random(12)
    own = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    sentences = [[*own(11), "end."] for _ in range(6)]
    passage, plain = [w for s in sentences for w in s], own(120)
    wrapped = "\n".join(" ".join(passage[i : i + 9]) for i in range(0, 72, 9))
    texts = [
        " ".join([*own(300), "stop.", *passage, *own(300)]),
        " ".join([*own(500), "stop.", *passage, *own(90)]),
        "\n".join(["Intro of its own here.", wrapped, "Outro of its own there."]),
        " ".join([*own(200), *plain, *own(200)]),
        " ".join([*own(20), *plain, *own(300)]),
    ]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in corpus_pipeline.repeated_paragraphs(spark, spark.createDataFrame(rows, DOCS), DIR).collect()}
    assert out[0].text == texts[0] and out[3].text == texts[3]
    for i in (1, 2):
        want = [w for w in texts[i].split() if w not in set(passage) or w == "end."]
        assert [w for w in out[i].text.split() if w != "end."] == [w for w in want if w != "end."] and out[i].n_chars == len(out[i].text)
    left, own_words = out[4].text.split(), set(texts[4].split()) - set(plain)
    assert len(own_words - set(left)) <= 2 and len(set(left) & set(plain)) < 60  # a similar unit may take a word beside the passage
    assert out[2].text == "Intro of its own here.\nOutro of its own there."
    assert paragraphs.without_repeats(empty).count() == 0


def test_bands_are_tuned_for_recall():
    bands, rows = paragraphs.tuned_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 80


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, k in ((0, 2), (1, 2), (200, 1), (400, 2), (1000, 4)):
        data = rng.integers(1, k + 1, n)
        want = sorted(range(n), key=lambda i, d=data.tolist(): d[i:])
        order = suffix.suffix_array(data)
        assert order.tolist() == want
        d = data.tolist()
        lcp = [0] * n
        for i in range(1, n):
            a, b = want[i - 1], want[i]
            while lcp[i] < 50 and a + lcp[i] < n and b + lcp[i] < n and d[a + lcp[i]] == d[b + lcp[i]]:
                lcp[i] += 1
        assert suffix.common_prefixes(data, order, 50).tolist() == lcp


def brute_removed(rows):
    first, out = {}, []
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for d, t, *_ in named:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(b), tuple(spans), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize(("contexts", "most"), [(5_000, 20_000), (7, 2)])
def test_repeated_bytes(spark, docs, empty, clashing, monkeypatch, contexts, most):
    monkeypatch.setattr(suffix, "CONTEXTS", contexts)
    monkeypatch.setattr(suffix, "MOST_OF_AN_ANCHOR", most)
    rows = [r for r in messy() if r[0] != 103] + [(300, "aaaa" * 60, "en", "s", 0), (301, "b" + "aaaa" * 40, "en", "s", 0)]
    out = suffix.without_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in out) == brute_removed(rows)
    assert suffix.without_repeats(empty).count() == 0 and suffix.without_repeats(clashing).count() == len(messy())


def test_strings_are_keyed_once_evenly_and_by_32_bytes():
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, (3, 40_000), dtype=np.uint8)
    letters[1, 500:580] = letters[0, 900:980]  # a passage of 80 bytes, and runs of 28 that no string of 50 can share
    for k in range(2_000, 30_000, 100):
        letters[2, k : k + 28] = letters[0, k + 7 : k + 35]
    bounds = np.array([0, 40_000, 40_000, 80_000, 120_000])
    at, low, high, doc, key = suffix._strings_by_key(letters.reshape(-1), bounds)
    starts = np.concatenate([np.arange(a, e + 1) for a, e in zip(low, high)])
    assert sorted(starts.tolist()) == [s for a in (0, 40_000, 80_000) for s in range(a, a + 40_000 - 49)]
    assert (at - high >= 0).all() and (at - low <= 34).all() and set(doc.tolist()) == {0, 2, 3}
    of = dict(zip(starts.tolist(), np.repeat(key, high - low + 1).tolist()))
    assert all(of[900 + j] == of[40_500 + j] for j in range(31))
    assert set(key[doc == 0].tolist()) & set(key[doc == 2].tolist()) and not set(key[doc == 0].tolist()) & set(key[doc == 3].tolist())
    shards = np.bincount(store.shard_of(key, 16).astype(int), minlength=16)  # the smallest of 35 hashes as a key would put nine of ten into the first
    assert shards.max() < 1.3 * shards.mean()


def test_strings_of_too_many_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "CONTEXTS", 40)
    rng = np.random.default_rng(2)
    pieces = list({bytes(rng.integers(97, 99, n, dtype=np.uint8)) + b"x" * 45 + bytes(rng.integers(97, 99, 6, dtype=np.uint8)) for n in (0, 2, 5) for _ in range(200)})
    docs = rng.permutation(len(pieces))
    want = [sum(1 << j for j in range(len(p) - 49) if min(d for q, d in zip(pieces, docs) if p[j : j + 50] in q) < docs[i]) for i, p in enumerate(pieces)]
    assert suffix._earlier_of_many(pieces, docs).tolist() == want
    assert suffix.earlier_strings(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), docs).tolist() == want


def test_packing(spark, docs, empty, clashing):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, packing.public_encoder()).toPandas()
    want = Counter()
    for d, text, *_ in messy():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, p, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 1
    assert packing.pack_documents(empty, packing.public_encoder()).count() == 0 and packing.pack_documents(clashing, packing.public_encoder()).count() == len(out)


@pytest.mark.parametrize("text", ["a b", "hi <|endoftext|>there", " a", "a  b\n c", "it's 's don't  \n\n z ", "\x1c \x85 a　b c", "", "é ñ a1b2 ***$$ |", "tail ", "a  b"])
def test_word_by_word_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.public_encoder().ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_genetic_packing_is_no_worse_than_best_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randint(150, 500) for _ in range(120)), reverse=True)
    best = packing._Bins(1024)
    for i, s in enumerate(sizes):
        best.best_fit(i, s)
    for a in packing.evolve(sizes, [], 1, 1024):
        fill = Counter()
        for s, b in zip(sizes, a, strict=True):
            fill[b] += s
        assert max(fill.values()) <= 1024 and len(fill) <= len(best.items)


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(15)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [0.5, 0.25]), (305, []), (10, rows[4][1]), (10, rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("own"))
    out = pivot_search.top_k(df, F.col("vec_id") % 10 == 0, pivots=7).collect()
    valid = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (6 - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, v) in enumerate(valid):
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(valid) if m != n)[:10]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(map(tuple, out)) == want
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert pivot_search.top_k(few, F.col("vec_id") == 0).collect() == [(0, 1, 1, 2 * 1024 * 1024)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    out = queries.queries()[name](spark, DIR)
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(cur.fetchall())


def brute_kn(train, test):
    tok = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())] + [2]
    pairs, uni = Counter(), Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        pairs.update(zip([1, *w], w, strict=False))
    cont = Counter(w for _, w in pairs)

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(1, 5)]
        return ngram_lm._discounts(n)

    d2, d1, n, v = discounts(pairs), discounts(cont), sum(uni.values()), len(uni)
    left = sum(d1[min(c, 3) - 1] for c in cont.values()) / max(1, len(pairs))
    base, score = 0.0, 0.0
    w = tok(test)
    for a, b in zip([1, *w], w, strict=False):
        base += math.log10((uni[b] + 1) / (n + v + 1))
        p = left / (v + 1) + (max(cont[b] - d1[min(cont[b], 3) - 1], 0) / len(pairs) if cont[b] else 0)
        follow = [c for (x, _), c in pairs.items() if x == a]
        if follow:
            c = pairs[a, b]
            p = (max(c - d2[min(c, 3) - 1], 0) if c else 0) / sum(follow) + sum(d2[min(x, 3) - 1] for x in follow) / sum(follow) * p
        score += math.log10(p)
    return len(w), sum(uni[x] > 0 for x in w), base, score


def test_language_model(spark, docs, empty, clashing):
    rows = [r for r in messy() if r[0] != 103]
    df = spark.createDataFrame(rows, DOCS)
    train = df.filter("doc_id % 3 > 0")
    model = ngram_lm.fit(train)
    texts = [t for d, t, *_ in rows if d is not None and d % 3 > 0]
    by_text = {t: brute_kn(texts, t) for _, t, *_ in rows}
    for r in ngram_lm.scored(df, model, ["text"]).collect():
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == pytest.approx(by_text[r.text], rel=1e-9)
    words = {w for t in texts if t for w in t.lower().encode().split()} | {b"unseen"}
    ids = np.array([*(ngram_lm._ids[w] for w in words), ngram_lm.END])
    for before in (int(ids[0]), int(ngram_lm.BEGIN)):
        assert (10 ** model.log10(ids, np.full(len(ids), before))[0]).sum() == pytest.approx(1)
    none = ngram_lm.fit(empty)
    assert {r.score for r in ngram_lm.scored(docs, none, ["doc_id"]).collect()} == {0.0}
    assert ngram_lm.scored(empty, model, ["doc_id"]).count() == 0
    assert ngram_lm.scored(clashing, model, ["score", "key"]).count() == len(messy())


def test_store(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 500))
    s = store.build(spark.createDataFrame([(int(k), i + 1) for i, k in enumerate(keys)], "k long, v long"), "t", 5)
    asked = np.concatenate([keys[::3], [17, 17]])
    (got,) = s.find(store.mix(asked.view(np.uint64)))
    assert got.tolist() == [*range(1, len(keys) + 1, 3), 0, 0]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == names, name
    out = corpus_pipeline.run(spark, DIR).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_take_any_rows(spark, docs, empty, tmp_path, stage):
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, empty):
        rows.write.mode("overwrite").parquet(str(tmp_path / "d"))
        stage[1](spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path)).write.format("noop").mode("overwrite").save()
