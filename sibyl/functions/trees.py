"""Labelled trees, their edit distance and edit scripts.

A tree is an array of nodes (label parts lemma, pos, rel, and the parent's number, -1 for the root). Pairs of trees are dealt out by
Spark; a task works on all pairs of an Arrow batch at once (`edit_batches`). Pairs that can't be near are told by column expressions before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import edit_batches

NODES = "array<struct<lemma: string, pos: string, rel: string, parent: int>>"


def parse_brackets(text: str) -> list[dict]:
    """Nodes of "{a{b}{c}}", labels as lemma/pos/rel; the order is that of the text."""
    nodes, stack, label = [], [], ""

    def close() -> None:
        nonlocal label
        if label:
            parts = [*label.split("/"), "", ""][:3]
            nodes[stack[-1]] |= {"lemma": parts[0], "pos": parts[1], "rel": parts[2]}
            label = ""

    for c in text:
        if c == "{":
            if stack:
                close()
            nodes.append({"lemma": "", "pos": "", "rel": "", "parent": stack[-1] if stack else -1})
            stack.append(len(nodes) - 1)
        elif c == "}":
            close()
            stack.pop()
        else:
            label += c
    return nodes


def least_common(first: Column, second: Column) -> Column:
    """How many nodes of two trees can keep their lemma at most: the words both have, with repeats."""
    def numbered(nodes: Column) -> Column:
        words = F.array_sort(F.transform(nodes, lambda n: F.coalesce(n["lemma"], F.lit(""))))
        return F.transform(words, lambda w, i: F.struct(w.alias("w"), (i - F.array_position(words, w)).alias("n")))

    return F.size(F.array_intersect(numbered(first), numbered(second)))


def distance_bound(first: Column | str, second: Column | str, cost: float = 3.0) -> Column:
    """A number that `tree_distance` never falls below, from the words alone: every node whose lemma has no partner must be deleted or inserted. Null for a null tree."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (first, second))
    nodes = F.size(a) + F.size(b)
    return F.when(a.isNotNull() & b.isNotNull(), cost * (nodes - 2 * least_common(a, b)) / F.greatest(F.lit(1), nodes))


def tree_distance(first: Column | str, second: Column | str, cost: float = 3.0, stop_words: bool = False) -> Column:
    """Distance of two trees (arrays of nodes), over the sum of their nodes; null for a null tree."""

    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        pairs = edit_batches.Pairs([a.iloc[i] for i in known], [b.iloc[i] for i in known], cost, stop_words)
        out[known] = pairs.distances() / np.maximum(1, pairs.nodes())
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return F.pandas_udf(distances, "double")(first, second)


def tree_edits(first: Column | str, second: Column | str, cost: float = 3.0, stop_words: bool = False) -> Column:
    """Edits that turn the first tree into the second, null for a null tree: type (DEL, INS, REN), places a and b in postorder and numbers
    word_a and word_b in the trees' arrays, -1 for none, the kind (`edit_batches.KINDS`), whether it is the top of a whole subtree that goes or comes, and the place
    of the first leaf under it. Order: by a, then by b."""

    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list = [None] * len(a)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        pairs = edit_batches.Pairs([a.iloc[i] for i in known], [b.iloc[i] for i in known], cost, stop_words)
        for i, script in zip(known, pairs.scripts(), strict=True):
            out[i] = script
        return pd.Series(out, dtype=object)

    return F.pandas_udf(edits, "array<struct<type: string, a: int, b: int, word_a: int, word_b: int, kind: string, subtree: boolean, first: int>>")(first, second)


def edit_distance(first: list, second: list, cost: float = 3.0, stop_words: bool = False) -> tuple[float, list[tuple[str, int, int]]]:
    """Distance and edits (DEL, INS, REN with places in postorder from 0, -1 for none) of one pair. Of equally cheap scripts the one that, from the end, deletes rather than inserts and inserts rather than renames."""
    pairs = edit_batches.Pairs([first], [second], cost, stop_words)
    return float(pairs.distances()[0]), [(e["type"], e["a"], e["b"]) for e in pairs.scripts()[0]]


def compact_edits(edits: Column) -> Column:
    """Edits in which a whole subtree of two nodes or more that goes, or comes, is one edit, at its top, of kind delSubtree or insSubtree."""
    tops = F.filter(edits, lambda e: e["subtree"])
    place = lambda e: F.greatest(e["a"], e["b"])  # noqa: E731  (of a deleted or inserted node the other place is -1)
    inside = lambda e: F.exists(tops, lambda s: (e["type"] == s["type"]) & (s["first"] <= place(e)) & (place(e) < place(s)))
    kept = F.filter(edits, lambda e: ~inside(e))
    return F.transform(kept, lambda e: e.withField("kind", F.when(e["subtree"], F.concat(F.lower(e["type"]), F.lit("Subtree"))).otherwise(e["kind"])))


def tree_nodes(tokens: Column, heads: Column) -> Column:
    """Nodes of a dependency tree from token structs (lemma, pos, rel) and head numbers from 0, -1 for the root; null if there is no root."""
    nodes = F.zip_with(tokens, heads, lambda t, h: F.struct(t["lemma"].alias("lemma"), t["pos"].alias("pos"), t["rel"].alias("rel"), h.cast("int").alias("parent")))
    return F.when(F.exists(heads, lambda h: h < 0), nodes)


def alignment(edits: Column) -> Column:
    """Renamed places of the first tree with their places in the second."""
    return F.map_from_entries(F.transform(F.filter(edits, lambda e: e["type"] == "REN"), lambda e: F.struct(e["a"], e["b"])))


def label_hash(label: Column, length: int) -> Column:
    """A label as a fixed-length string."""
    return F.substring(F.sha2(label, 256), 1, length)
