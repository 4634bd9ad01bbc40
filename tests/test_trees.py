"""Tree edit distance in batches, against a plain recursion and against all scripts; alignment features on literal trees."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from sibyl.functions import edit_batches, trees
from sibyl.operators import alignment as al
from sibyl.queries.plans import passage_edit_features


def random_tree(rng, n, words="abc"):
    """Nodes whose parents come in any order; the numbers are shuffled, as words of a sentence are."""
    order = list(range(n))
    rng.shuffle(order)
    parent = {i: (order[rng.randrange(k)] if k else -1) for k, i in enumerate(order)}
    return [{"lemma": rng.choice(words), "pos": rng.choice(["NN", "DT"]), "rel": rng.choice("xy"), "parent": parent[i]} for i in range(n)]


def nested(nodes):
    def below(p):
        return tuple((i, below(i)) for i, n in enumerate(nodes) if n["parent"] == p)

    return below(-1)


def plain_distance(a, b, cost=3.0, stop_words=False):
    """Forests by recursion from the right: delete, insert, or match the last trees."""
    size = lambda f: sum(1 + size(kids) for _, kids in f)

    def rename(i, j):
        x, y = a[i], b[j]
        if x["lemma"] != y["lemma"]:
            return float("inf")
        if stop_words and x["pos"] == "DT" and y["pos"] == "DT":
            return 2.5
        return (x["pos"] != y["pos"]) + (x["rel"] != y["rel"])

    @cache
    def go(f, g):
        if not f or not g:
            return cost * (size(f) + size(g))
        (i, kf), (j, kg) = f[-1], g[-1]
        return min(go(f[:-1] + kf, g) + cost, go(f, g[:-1] + kg) + cost, go(f[:-1], g[:-1]) + go(kf, kg) + rename(i, j))

    return go(nested(a), nested(b))


@pytest.mark.parametrize("stop_words", [False, True])
@pytest.mark.parametrize("cells", [1, 300, 1 << 21])
def test_batches_equal_recursion(monkeypatch, stop_words, cells):
    monkeypatch.setattr(edit_batches, "CELLS", cells)
    rng = random.Random(cells)
    made = [(random_tree(rng, rng.randrange(0, 9)), random_tree(rng, rng.randrange(0, 9))) for _ in range(60)]
    pairs = edit_batches.Pairs([a for a, _ in made], [b for _, b in made], stop_words=stop_words)
    want = [plain_distance(a, b, stop_words=stop_words) for a, b in made]
    assert list(pairs.distances()) == want
    for (a, b), distance, script in zip(made, want, pairs.scripts(), strict=True):
        paid = 0.0
        for e in script:
            if e["type"] != "REN":
                paid += 3
            else:
                x, y = a[e["word_a"]], b[e["word_b"]]
                assert x["lemma"] == y["lemma"]
                both = stop_words and x["pos"] == "DT" and y["pos"] == "DT"
                paid += 2.5 if both else (x["pos"] != y["pos"]) + (x["rel"] != y["rel"])
        assert paid == distance
        assert sorted(e["word_a"] for e in script if e["type"] != "INS") == list(range(len(a)))
        assert sorted(e["word_b"] for e in script if e["type"] != "DEL") == list(range(len(b)))
        kept = [(e["a"], e["b"]) for e in script if e["type"] == "REN"]
        assert kept == sorted(kept) and [y for _, y in kept] == sorted(y for _, y in kept)
        assert ancestors_kept(a, b, [(e["word_a"], e["word_b"]) for e in script if e["type"] == "REN"])


def ancestors_kept(a, b, matched):
    def above(nodes, i, j):
        while j >= 0 and j != i:
            j = nodes[j]["parent"]
        return j == i

    return all(above(a, i, k) == above(b, j, m) for i, j in matched for k, m in matched)


def test_forests_and_cycles():
    two = [{"lemma": w, "pos": "", "rel": "", "parent": -1} for w in "ab"]
    assert trees.edit_distance(two, two[:1])[0] == 3 and trees.edit_distance(two, two)[0] == 0
    assert trees.edit_distance([], []) == (0.0, [])
    for parents in ([1, 0], [5, -1]):
        with pytest.raises(ValueError, match="cycle"):
            trees.edit_distance([{"lemma": "a", "pos": "", "rel": "", "parent": p} for p in parents], two)


def test_long_chain():
    chain = lambda words: [{"lemma": w, "pos": "", "rel": "", "parent": i - 1} for i, w in enumerate(words)]
    assert trees.edit_distance(chain("x" * 1500), chain("x" * 1499 + "y"))[0] == 6


def test_bound_and_columns(spark):
    rng = random.Random(5)
    made = [(i, random_tree(rng, rng.randrange(0, 8)), random_tree(rng, rng.randrange(0, 8))) for i in range(40)] + [(40, None, []), (41, [], None)]
    df = spark.createDataFrame(made, f"id int, first {trees.NODES}, second {trees.NODES}")
    rows = df.select("id", trees.tree_distance("first", "second").alias("d"), trees.distance_bound("first", "second").alias("least")).collect()
    for r in rows:
        _, a, b = made[r.id]
        if a is None or b is None:
            assert r.d is None and r.least is None
        else:
            assert r.d == pytest.approx(plain_distance(a, b) / max(1, len(a) + len(b))) and r.least <= r.d + 1e-9
    assert sum(r.least > 1.0 for r in rows if r.least is not None) > 3


def test_whole_subtrees(spark):
    a = trees.parse_brackets("{r/N/x{k/N/x}{g/N/x{h/N/x{i/N/x}}{j/N/x}}{m/N/x}}")
    b = trees.parse_brackets("{r/V/x{k/N/x}}")
    df = spark.createDataFrame([(a, b), (b, a), (None, a)], f"a {trees.NODES}, b {trees.NODES}").select(trees.tree_edits("a", "b").alias("e"))
    got = [r[0] and [(e.kind, e.word_a, e.word_b) for e in r[0]] for r in df.select(trees.compact_edits(F.col("e"))).collect()]
    assert got[0] == [("align", 1, 1), ("delSubtree", 2, -1), ("delLeaf", 6, -1), ("renPos", 0, 0)]
    assert sorted(got[1]) == [("align", 1, 1), ("insLeaf", -1, 6), ("insSubtree", -1, 2), ("renPos", 0, 0)]
    assert got[2] is None


def test_chunk_tree(spark):
    texts = ["The famous author wrote a long book about old Berlin", "second book", "of of", "", None, "is was are", "Ada wrote. Ada is here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    words = F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    got = {r.i: r.tree for r in df.select("i", al.chunk_tree(words).alias("tree")).collect()}
    assert [(n.lemma, n.rel, n.parent) for n in got[1]] == [("second", "mod", 1), ("book", "root", -1)]
    assert [n.parent for n in got[2]] == [-1, 0] and got[3] == [] and got[4] is None and [n.parent for n in got[5]] == [-1, 0, 1]
    # "wrote" has the form of a noun for the rules, so the first phrase is up to it; every tree has one root and no cycle
    assert [n.parent for n in got[0]][:4] == [3, 3, 3, -1]
    for tree in got.values():
        if tree:
            assert edit_batches.Pairs([tree], [tree]).distances()[0] == 0 and [n.rel for n in tree].count("root") == 1


def plain_features(a, b):
    script = edit_batches.Pairs([a], [b]).scripts()[0]
    stays = sorted(e["word_a"] for e in script if e["type"] == "REN" and e["word_a"] < len(a) - 1)
    out = {}
    for e in script:
        i = e["word_a"]
        if e["type"] == "INS":
            continue
        if e["type"] == "REN":
            x, y = a[i], b[e["word_b"]]
            out[i] = ["edit=align", f"edit(align)_0Pos={x['pos']}", f"edit(align)_0Dep={x['rel']}", f"edit(align)_1Pos={y['pos']}", f"edit(align)_1Dep={y['rel']}", f"edit(align)_Pos={x['pos']}_{y['pos']}", f"edit(align)_Dep={x['rel']}_{y['rel']}"]
            continue
        out[i] = [f"edit={e['kind']}", f"edit({e['kind']})_Pos={a[i]['pos']}", f"edit({e['kind']})_Dep={a[i]['rel']}"]
        if stays:
            j = min(stays, key=lambda j: (abs(j - i), j))
            out[i] += [f"nearest_aligned={j - i}", f"nearest_aligned_Pos={a[j]['pos']}", f"nearest_aligned_Dep={a[j]['rel']}"]
    return out


def test_edit_features_and_near_trees(spark):
    rng = random.Random(11)
    made = [(i, random_tree(rng, rng.randrange(0, 12), "abcde"), random_tree(rng, rng.randrange(0, 8), "abcde")) for i in range(60)] + [(60, None, []), (61, [], None)]
    df = spark.createDataFrame(made, f"id int, tree {trees.NODES}, other {trees.NODES}")
    got = {}
    for r in al.edit_features(df, ["id"]).collect():
        got.setdefault(r.id, {})[r.i] = r.features
    assert got == {i: f for i, a, b in made[:60] if (f := plain_features(a, b))}
    for limit in (0.0, 0.9, 1.5, 3.0):
        near = {r.id: r.distance for r in al.near_trees(df, "tree", "other", limit).collect()}
        want = {i: plain_distance(a, b) / max(1, len(a) + len(b)) for i, a, b in made[:60]}
        assert near == pytest.approx({i: x for i, x in want.items() if x <= limit})


def test_passages_are_aligned_with_their_question(spark, tmp_path):
    asked = [(1, "Who wrote the famous book?"), (2, "zzz")]
    docs = [(1, "Ada Lovelace wrote the famous book. Nothing else."), (2, "Unrelated words are here."), (3, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r.qid, r.doc_id, r.sent, r.i): r.features for r in passage_edit_features(spark, str(tmp_path)).collect()}
    assert {k[:3] for k in rows} == {(1, 1, 0)} and len(rows) == 6
    assert all(rows[1, 1, 0, i].startswith("edit=align") for i in (2, 3, 4, 5)) and rows[1, 1, 0, 1].startswith("edit=delLeaf")
