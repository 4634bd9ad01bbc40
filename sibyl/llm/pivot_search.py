"""Exact top-k search by inner product, over a pivot-distance index.

Vectors are lifted to one length M by one more component, sqrt(M^2 - |x|^2); for queries it is 0. The largest inner product
is then the smallest distance, and the triangle inequality holds: a vector at distance r from a pivot is at least
|d(query, pivot) - r| away from the query. The index keys each vector by its nearest pivot and that distance, cuts each pivot's
distances into rings, and the rings into blocks. A query first looks into a block of the ring that it lies in itself; the bound found
there leaves out whole rings, and in each block that is left the sorted distances are walked outwards from the query's,
annulus by annulus, until no closer one can come. Queries of one pivot go together, and a block is sent only to those that want it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, written

#: Pivots, rings of a pivot at most, rows of a block, queries compared with a block at once, and rows of the first annulus.
PIVOTS, RINGS, BLOCK_ROWS, QUERY_ROWS, ANNULUS = 48, 32, 4096, 4096, 256


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as double; null where the vector is null or holds a null or non-finite component."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width) if width else np.zeros((len(column), 0), np.int64)


def _distances(x: np.ndarray, top: np.ndarray, pivots: np.ndarray, pivot_top: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to the lifted pivots."""
    square = (x**2).sum(1)[:, None] + (top**2)[:, None] + ((pivots**2).sum(1) + pivot_top**2)[None] - 2 * (x @ pivots.T + top[:, None] * pivot_top[None])
    return np.sqrt(np.maximum(square, 0))


class _Best:
    """The k best rows so far: highest score, then smallest id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.row = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        keep = np.lexsort((rows, ids, -score))[: self.k]
        self.score, self.id, self.row = score[keep], ids[keep], rows[keep]


def _search_block(block: pa.Table, queries: pa.Table, width: int, k: int, longest: float) -> pa.Table:
    """Best rows of one block for each query that needs it."""
    r = np.asarray(block.column("r"))
    order = np.argsort(r, kind="stable")
    r, ids, rows = r[order], np.asarray(block.column("id"))[order], np.asarray(block.column("row"))[order]
    x = _matrix(block.column("v").combine_chunks(), width)[order]
    q = _matrix(queries.column("v").combine_chunks(), width)
    exact = np.float64 if width * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**52 else np.int64
    x, q, margin, out = x.astype(exact), q.astype(exact), 1e-6 * longest + 1e-3, []
    for i, (qrow, d, bound) in enumerate(zip(queries.column("row").to_pylist(), queries.column("d").to_pylist(), queries.column("bound").to_pylist(), strict=True)):
        best, reach = _Best(k), bound
        left = right = int(np.searchsorted(r, d))
        size, q_square = ANNULUS, float((q[i].astype(float) ** 2).sum())
        while True:  # the next annulus on either side, as far as the bound reaches
            low, high = np.searchsorted(r, d - reach - margin), np.searchsorted(r, d + reach + margin, side="right")
            a, b = max(low, left - size), min(high, right + size)
            if a >= left and b <= right:
                break
            at = np.concatenate([np.arange(a, left), np.arange(right, b)]) if a < left else np.arange(right, b)
            left, right, size = min(a, left), max(b, right), size * 2
            score = (x[at] @ q[i]).astype(np.int64)
            other = rows[at] != qrow
            best.add(score[other], ids[at][other], rows[at][other])
            if len(best.score) == k:
                reach = min(reach, math.sqrt(max(0.0, q_square + longest**2 - 2 * float(best.score[-1]))))
        out.append((np.full(len(best.id), qrow), best.id, best.row, best.score))
    return pa.table([np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(4)], names=["qrow", "vec_id", "row", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k highest integer inner products with all other rows.

    Ties go to the smaller id. Rows whose vector is null or holds a null or non-finite component take no part; shorter vectors
    count as filled up with zeros; null ids sort first. Rows that share an id are rows of their own: each queries, and is found, by itself.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = written(rows.filter(F.col("v").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, longest = rows.agg(F.max(F.size("v")), F.max(square)).first()
    width, longest = width or 0, math.sqrt(longest or 0.0)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    found_pivots = [r[0] for r in rows.orderBy(F.xxhash64("v"), "row").limit(pivots).select("v").collect()]  # at most `pivots` rows
    chosen = np.unique(np.array(found_pivots, float).reshape(len(found_pivots), width), axis=0) if found_pivots and width else np.zeros((1, width))
    chosen_top = np.sqrt(np.maximum(longest**2 - (chosen**2).sum(1), 0))

    def key(v: list) -> list[np.ndarray]:
        x = np.array(v, float).reshape(len(v), width)
        d = _distances(x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0)), chosen, chosen_top)
        return [d.argmin(1).astype(np.int32), d.min(1)]

    index = written(map_columns(rows, ["id", "row", "v", "is_query"], [F.col("v")], [("pivot", "int"), ("r", "double")], key, rows=4096), "index")
    spark, margin = vectors.sparkSession, 1e-6 * longest + 1e-3
    # at most a row for each pivot: the distances that cut its rings, so many that a ring has some blocks' rows
    shares = F.array(*[F.lit(k / RINGS) for k in range(1, RINGS)])
    cuts = {}
    for p, n, at in index.groupBy("pivot").agg(F.count(F.lit(1)), F.percentile_approx("r", shares, 1000)).collect():
        step = max(1, RINGS // max(1, -(-n // BLOCK_ROWS)))
        cuts[p] = sorted(set(at[step - 1 :: step]))
    ring_cuts = spark.createDataFrame([(p, c) for p, c in cuts.items()], "pivot int, cuts array<double>")
    ringed = index.join(F.broadcast(ring_cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts")
    # at most a row for each ring
    rings = sorted(map(tuple, ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)), F.min("r"), F.max("r")).collect()))
    ring_pivot, low, high = (np.array([x[k] for x in rings]) for k in (0, 3, 4))
    n_blocks = np.array([-(-x[2] // BLOCK_ROWS) for x in rings], np.int64)
    first = np.cumsum(n_blocks) - n_blocks
    block_of = spark.createDataFrame([(int(x[0]), int(x[1]), int(f), int(n)) for x, f, n in zip(rings, first, n_blocks, strict=True)], "pivot int, ring int, first long, n long")
    blocks = ringed.join(F.broadcast(block_of), ["pivot", "ring"]).select("id", "row", "v", "r", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("n"))).alias("block"))
    of_pivot = {p: (n, -(-n // QUERY_ROWS)) for p, n in index.filter("is_query").groupBy("pivot").count().collect()}  # at most a row for each pivot
    n_queries = sum(n for n, _ in of_pivot.values())
    chunk_of = spark.createDataFrame([(p, c) for p, (_, c) in of_pivot.items()], "pivot int, chunks long")

    def found(queries: DataFrame) -> DataFrame:
        """queries: row, chunk, v, bound, and want, which has (block, d) for each block."""
        asked = queries.select("row", "v", "bound", "chunk", F.explode("want").alias("w")).select("row", "v", "bound", "chunk", F.col("w.block").alias("block"), F.col("w.d").alias("d"))
        # a block meets the chunks of queries of which one wants it, so neither side of a group outgrows a task
        pairs = queries.select(F.col("chunk").alias("to_chunk"), F.explode("want.block").alias("to_block")).distinct()
        dealt = blocks.join(pairs, F.col("block") == F.col("to_block")).drop("block")
        both = dealt.groupBy("to_block", "to_chunk").cogroup(asked.groupBy("block", "chunk"))
        return both.applyInArrow(lambda b, q: _search_block(b, q, width, k, longest), "qrow long, vec_id long, row long, score long")

    def near(v: list) -> list[list]:
        x = np.array(v, float).reshape(len(v), width)
        d = _distances(x, np.zeros(len(x)), chosen, chosen_top)
        off = np.maximum(low - d[:, ring_pivot], d[:, ring_pivot] - high)
        off[ring_pivot[None] != np.where(np.isin(np.arange(d.shape[1]), ring_pivot), d, np.inf).argmin(1)[:, None]] = np.inf
        own = off.argmin(1)  # the ring of the nearest pivot that has the query's distance
        return [[[{"block": int(first[a]), "d": float(d[i, ring_pivot[a]])}] for i, a in enumerate(own)]]

    def within(v: list, worst: list) -> list[list]:
        x = np.array(v, float).reshape(len(v), width)
        d = _distances(x, np.zeros(len(x)), chosen, chosen_top)
        bound = [math.inf if w is None else math.sqrt(max(0.0, float((a**2).sum()) + longest**2 - 2 * w)) + margin for a, w in zip(x, worst, strict=True)]
        want = []
        for row, reach in zip(d[:, ring_pivot], bound, strict=True):
            some = np.flatnonzero((low - reach - margin <= row) & (row <= high + reach + margin))
            want.append([{"block": int(first[a] + j), "d": float(row[a])} for a in some for j in range(n_blocks[a])])
        return [bound, want]

    if not n_queries:
        return index.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("row").alias("score"))
    kind = "array<struct<block: long, d: double>>"
    chunk = F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("chunks"))
    queries = index.filter("is_query").join(F.broadcast(chunk_of), "pivot").select("id", "row", "v", chunk.alias("chunk"))
    seeds = found(written(map_columns(queries, ["row", "chunk", "v"], [F.col("v")], [("want", kind)], near).withColumn("bound", F.lit(float("inf"))), "seeds"))
    worst = seeds.groupBy(F.col("qrow").alias("row")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("worst"))
    bounded = written(map_columns(queries.join(worst, "row", "left"), ["id", "row", "chunk", "v"], [F.col("v"), F.col("worst")], [("bound", "double"), ("want", kind)], within), "queries")
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("row"))
    ranked = found(bounded).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(bounded.select(F.col("row").alias("qrow"), F.col("id").alias("query_id")), "qrow").select("query_id", "rank", "vec_id", "score")
