"""Passages aligned with their question: trees of both, the cheapest edits between them, and features of each passage word.

The tree is any (`functions.trees.NODES`); where no parser is at hand, `chunk_tree` makes one from letters of parts of speech. Edits are worked
out for all pairs of an Arrow batch together, everything else is column expressions, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotate, trees
from . import candidates as cd


def chunk_tree(words: Column) -> Column:
    """A sentence's words as a tree, by rule; null for null words.

    The last word of a noun phrase governs the others in it. All else hangs on the verb before it, and the first verb is the root; without a
    verb the first phrase's last word is, or the first word. Relations: root, mod (inside a phrase), subj and obj (phrases before and after the root), dep.
    """
    def numbers(letters: Column) -> Column:
        return F.filter(F.when(F.length(letters) > 0, F.sequence(F.lit(0), F.length(letters) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(letters, i + 1, F.lit(1)) == "V")

    def tree(letters: Column, verbs: Column, phrases: Column) -> Column:
        root = F.coalesce(F.get(verbs, F.lit(0)), F.get(phrases, F.lit(0))["end"], F.lit(0))

        def node(w: Column, i: Column) -> Column:
            head = F.get(F.filter(phrases, lambda x: (x["begin"] <= i) & (i <= x["end"])), F.lit(0))["end"]
            before = F.coalesce(F.array_max(F.filter(verbs, lambda v: v < i)), root)
            inside = head.isNotNull() & (head != i)
            rel = F.when(i == root, "root").when(inside, "mod").when(head.isNull(), "dep").when(i < root, "subj").otherwise("obj")
            return F.struct(annotate.lemma(w).alias("lemma"), F.substr(letters, i + 1, F.lit(1)).alias("pos"), rel.alias("rel"), F.when(i == root, -1).when(inside, head).otherwise(before).cast("int").alias("parent"))

        return F.transform(words, node)

    once = cd.once
    first_level = lambda letters: F.filter(cd.phrase_spans(letters), lambda x: x["level"] == 1)
    made = once(cd.tag_letters(words), lambda a: once(numbers(a), lambda v: once(first_level(a), lambda p: tree(a, v, p))))
    return F.when(words.isNotNull(), made)


def near_trees(pairs: DataFrame, first: str, second: str, at_most: float, cost: float = 3.0) -> DataFrame:
    """Pairs of trees at a distance (over the sum of their nodes) of at_most or less, with `distance`. Pairs that their words alone put farther apart are left out before any table is made; pairs with a null tree go."""
    likely = pairs.filter(trees.distance_bound(first, second, cost) <= at_most + 1e-9)
    return likely.withColumn("distance", trees.tree_distance(first, second, cost)).filter(F.col("distance") <= at_most + 1e-9)


def edit_features(pairs: DataFrame, keys: Sequence[str], first: str = "tree", second: str = "other", stop_words: bool = False) -> DataFrame:
    """keys, i, features: "name=value" strings for each word of the first tree (the passage's), by what happens to it on the way to the second (the question's).

    A word that goes has the kind of its edit, with its part of speech and relation; a word that stays has both words' parts of speech and
    relations, apart and joined. A word that goes also has the signed distance, part of speech and relation of the nearest word that stays;
    of two as near the earlier; the passage's last word is never taken for it. Pairs with a null tree, and empty first trees, have no rows.
    """
    edits = pairs.select(*keys, F.col(first).alias("_t"), F.col(second).alias("_u"), trees.tree_edits(first, second, stop_words=stop_words).alias("_e"))
    stays = F.transform(F.filter("_e", lambda e: (e["type"] == "REN") & (e["word_a"] < F.size("_t") - 1)), lambda e: e["word_a"])
    rows = edits.withColumn("_s", stays)
    fact = lambda name, value: F.concat(F.lit(name + "="), F.coalesce(value, F.lit("")))

    def of(e: Column) -> Column:
        mine, other = F.get("_t", e["word_a"]), F.get("_u", e["word_b"])
        nearest = F.array_min(F.transform("_s", lambda j: F.struct(F.abs(j - e["word_a"]).alias("far"), j.alias("j"))))["j"]
        by = F.get("_t", nearest)
        both = lambda part: F.concat(F.coalesce(mine[part], F.lit("")), F.lit("_"), F.coalesce(other[part], F.lit("")))
        # The names of the features.
        aligned = F.array(
            fact("edit", F.lit("align")), fact("edit(align)_0Pos", mine["pos"]), fact("edit(align)_0Dep", mine["rel"]), fact("edit(align)_1Pos", other["pos"]), fact("edit(align)_1Dep", other["rel"]),
            fact("edit(align)_Pos", both("pos")), fact("edit(align)_Dep", both("rel")),
        )
        named = lambda part, value: F.concat(F.lit("edit("), e["kind"], F.lit(f")_{part}="), F.coalesce(value, F.lit("")))
        gone = F.array(fact("edit", e["kind"]), named("Pos", mine["pos"]), named("Dep", mine["rel"]))
        near = F.array(fact("nearest_aligned", (nearest - e["word_a"]).cast("string")), fact("nearest_aligned_Pos", by["pos"]), fact("nearest_aligned_Dep", by["rel"]))
        return F.struct(e["word_a"].alias("i"), F.when(e["type"] == "REN", aligned).when(nearest.isNull(), gone).otherwise(F.concat(gone, near)).alias("features"))

    each = F.transform(F.filter("_e", lambda e: e["word_a"] >= 0), of)
    return rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.i", "x.features")
