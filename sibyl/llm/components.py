"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Links that a task joins up by itself before they are sent on.
CHUNK = 200_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: each id above its component's smallest, and that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _joined_up(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0

        def flush() -> pa.RecordBatch:
            u, v = _stars(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= CHUNK:
                yield flush()
                a, b, held = [], [], 0
        if held:
            yield flush()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (two columns of ids): the smallest id reachable, itself included.

    Links that join an id to itself, and null ids, say nothing; an id that has no other link is not in the result.
    Rounds of large-star and small-star: every id's neighbours are linked to its smallest neighbour, the larger ones
    first, then the smaller ones, until only stars are left. No step needs an id's links in one place.
    """
    a, b = links.columns[:2]
    clean = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v")
    edges = written(_joined_up(clean).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select("u", F.col("m").alias("v")).union(near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        drop_written(edges)
        edges = new
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("v", "v"))
