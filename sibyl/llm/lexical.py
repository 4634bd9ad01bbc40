"""Ranked lexical search over dual-sorted wavelet trees.

The index is a table of shards. A shard's posting lists are laid end to end, each by falling impact, and the sequence of their documents is
a wavelet matrix: level by level the bits of the documents' places in the order of doc_id, positions dealt stably by bit. So a list's interval can be
followed to any range of doc_ids, and there still lies by falling impact: its first posting is the greatest that the term has in the range.

A search keeps a frontier of (query, range of doc_ids) nodes with the sum of these greatest impacts as bound, opens the best ones first, and
leaves out nodes whose bound can't reach the query's k-th best document. A node of one document has its exact score as bound.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, written

#: Documents and bytes of text of a shard; a longer text is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 2_048, 8 << 20
#: Queries that are searched with one broadcast, and that meet a shard at once; nodes that a step opens for each query, at least.
BLOCK, AT_ONCE, OPENED = 4_096, 32, 16

#: ASCII letters in lower case; all other ASCII characters but digits end a term.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text: runs of ASCII letters and digits and all characters beyond ASCII; only A-Z in lower case. Null: none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


@dataclass
class Index:
    """shards: the written table; documents: those with a term; length: terms of all documents."""

    shards: DataFrame
    documents: int
    length: int


def _shard(ids: list, words: list[list[bytes]], documents: int, length: int) -> dict:
    """One shard: documents in the order of their ids (null last), lists of terms in order."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(words[i]) for i in order], np.int64)
    at = np.fromiter((x for i in order for x in map(vocabulary.__getitem__, words[i])), np.int64, int(sizes.sum()))
    names = list(vocabulary)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    pairs, tf = np.unique(rank[at] * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    m = 25 + (75 * sizes * documents) // max(1, length)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    fall = np.lexsort((doc, -impact, term))
    sequence, levels = doc[fall], []
    for shift in range(max(1, (len(ids) - 1).bit_length()) - 1, -1, -1):
        bit = (sequence >> shift & 1).astype(bool)
        levels.append(np.packbits(bit).tobytes())
        sequence = np.concatenate([sequence[~bit], sequence[bit]])
    return {
        "ids": [ids[i] for i in order], "terms": b"\n".join(names[i] for i in by_name), "starts": np.searchsorted(term, np.arange(len(names) + 1)).astype("<i8").tobytes(),
        "levels": levels, "impacts": impact[fall].astype("<i4").tobytes(),
    }


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("starts", pa.binary()), ("levels", pa.list_(pa.binary())), ("impacts", pa.binary())])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> Index:
    """Indexes every row. Documents without a term have no postings. Each task makes its own shards; nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sized = map_columns(rows, [], [F.col("text")], [("n", "long")], lambda texts: [[len(terms(t)) for t in texts]])
    sums = sized.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    documents, length = sums.documents, sums.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(ids, words, documents, length)], schema=_SCHEMA)

        for b in batches:
            for k in range(0, b.num_rows, 64):
                for i, t in zip(*[c.slice(k, 64).to_pylist() for c in b.columns], strict=True):
                    if ids and (len(ids) >= shard_docs or held + len(t or "") > shard_bytes):
                        yield flush()
                        ids, words, held = [], [], 0
                    ids.append(i)
                    words.append(terms(t))
                    held += len(t or "")
        if ids:
            yield flush()

    shards = rows.mapInArrow(run, "ids array<long>, terms binary, starts binary, levels array<binary>, impacts binary")
    return Index(written(shards, "lexical-index"), documents, length)


class _Shard:
    """A shard as a search reads it: ranks of ones before each position, and the impacts as each level lays them out."""

    def __init__(self, row: dict, asked: set[bytes]) -> None:
        self.ids = row["ids"]
        starts = np.frombuffer(row["starts"], "<i8")
        names = row["terms"].split(b"\n") if row["terms"] else []
        self.lists = {t: (int(starts[i]), int(starts[i + 1])) for i, t in enumerate(names) if t in asked}
        impacts = np.frombuffer(row["impacts"], "<i4")
        n, self.height = len(impacts), len(row["levels"])
        self.width = n + 1
        self.ones, self.impacts = np.zeros((self.height, n + 1), np.int32), np.empty((self.height + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        for k, data in enumerate(row["levels"]):
            bit = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
            np.cumsum(bit, out=self.ones[k, 1:])
            self.impacts[k + 1, :n] = np.concatenate([self.impacts[k, :n][~bit], self.impacts[k, :n][bit]])
        self.zeros = n - self.ones[:, -1].astype(np.int64)
        self.ones, self.impacts = self.ones.ravel(), self.impacts.ravel()

    def best(self, queries: list[list[tuple[bytes, int]]], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document's place, score) of the k best documents of each query (term, weight); those under least[query] are left out."""
        found = [(q, w, *self.lists[t]) for q, ts in enumerate(queries) for t, w in ts if w > 0 and t in self.lists]
        rows = np.array(found, np.int64).reshape(-1, 4)
        # a node is a query, a level and a first document, with the weights and intervals of its terms in the pools
        tw, tl, tr = rows[:, 1], rows[:, 2], rows[:, 3]
        q, offset, size = np.unique(rows[:, 0], return_index=True, return_counts=True)
        level, first = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        bound = np.add.reduceat(tw * self.impacts[tl], offset) if len(q) else np.zeros(0, np.int64)
        top_q, top_d, top_s = (np.zeros(0, np.int64) for _ in range(3))
        floor, floor_doc = least.copy(), np.full(len(queries), np.iinfo(np.int64).max)
        while len(q):
            order = np.lexsort((first, -bound, q))
            q, offset, size, level, first, bound = (x[order] for x in (q, offset, size, level, first, bound))
            head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            length = np.diff(np.append(head, len(q)))
            open_ = np.arange(len(q)) - np.repeat(head, length) < np.repeat(np.maximum(OPENED, length // 4), length)
            nodes = np.flatnonzero(open_)
            # the terms of both halves of each opened node
            n = size[nodes]
            at = np.repeat(offset[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            lev, w, a, b = np.repeat(level[nodes], n), tw[at], tl[at], tr[at]
            one_a, one_b = self.ones[lev * self.width + a].astype(np.int64), self.ones[lev * self.width + b].astype(np.int64)
            owner = np.repeat(np.arange(len(nodes)), n)
            z = self.zeros[lev]
            half = np.concatenate([owner, owner + len(nodes)])
            left, right = np.concatenate([a - one_a, z + one_a]), np.concatenate([b - one_b, z + one_b])
            some = right > left
            half, left, right, w = half[some], left[some], right[some], np.concatenate([w, w])[some]
            child, c_offset, c_size = np.unique(half, return_index=True, return_counts=True)
            of = nodes[child % len(nodes)]
            c_level = level[of] + 1
            c_first = first[of] + np.where(child >= len(nodes), np.int64(1) << (self.height - c_level), 0)
            value = w * self.impacts[np.repeat(c_level, c_size) * self.width + left]
            c_bound = np.add.reduceat(value, c_offset) if len(child) else np.zeros(0, np.int64)
            c_q = q[of]
            leaf = c_level == self.height
            if leaf.any():
                top_q, top_d, top_s = np.concatenate([top_q, c_q[leaf]]), np.concatenate([top_d, c_first[leaf]]), np.concatenate([top_s, c_bound[leaf]])
                by = np.lexsort((top_d, -top_s, top_q))
                top_q, top_d, top_s = top_q[by], top_d[by], top_s[by]
                head = np.flatnonzero(np.concatenate([[True], top_q[1:] != top_q[:-1]]))
                place = np.arange(len(top_q)) - np.repeat(head, np.diff(np.append(head, len(top_q))))
                last = place == k - 1
                better = top_s[last] > floor[top_q[last]]
                full = top_q[last]
                floor_doc[full] = np.where(better | (top_s[last] == floor[full]), top_d[last], floor_doc[full])
                floor[full] = np.maximum(floor[full], top_s[last])
                top_q, top_d, top_s = (x[place < k] for x in (top_q, top_d, top_s))
            # the pools keep only what is still to be opened
            go, kept = ~leaf, np.flatnonzero(~open_)
            pool = len(tw)
            tw, tl, tr = np.concatenate([tw, w]), np.concatenate([tl, left]), np.concatenate([tr, right])
            q, offset, size = np.concatenate([q[kept], c_q[go]]), np.concatenate([offset[kept], c_offset[go] + pool]), np.concatenate([size[kept], c_size[go]])
            level, first, bound = np.concatenate([level[kept], c_level[go]]), np.concatenate([first[kept], c_first[go]]), np.concatenate([bound[kept], c_bound[go]])
            alive = (bound > 0) & ((bound > floor[q]) | (bound == floor[q]) & (first <= floor_doc[q]))
            q, offset, size, level, first, bound = (x[alive] for x in (q, offset, size, level, first, bound))
            if len(tw) > 4 * size.sum() + 100_000:
                at = np.repeat(offset - (np.cumsum(size) - size), size) + np.arange(size.sum())
                tw, tl, tr, offset = tw[at], tl[at], tr[at], np.cumsum(size) - size
        good = (top_s > 0) & (top_s >= least[top_q])
        return top_q[good], top_d[good], top_s[good]


def document_frequencies(index: Index, asked: set[bytes]) -> dict[bytes, int]:
    """Documents of all shards that hold each of the asked terms."""
    shared = index.shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df = np.diff(np.frombuffer(starts, "<i8"))
                got = [(t, int(df[i])) for i, t in enumerate(names.split(b"\n")) if t in shared.value]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.binary()), pa.array([n for _, n in got], pa.int64())], ["term", "df"])

    out = index.shards.filter("length(terms) > 0").select("terms", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in out.collect()}


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of queries; equal scores by doc_id, null last.

    Queries go to the shards in blocks of about `block` rows. Rows that share an id are queries of their own. A query without terms has no row.
    """
    spark = queries.sparkSession
    asked = written(queries.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_q", F.monotonically_increasing_id()), "asked")
    kind = dict(asked.dtypes)["item_id"]
    n_blocks = max(1, -(-asked.count() // block))
    found = None
    for n in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(n_blocks)) == n).select("_q", "text").collect()
        counts = [(r._q, Counter(terms(r.text))) for r in rows]
        df = document_frequencies(index, {t for _, c in counts for t in c})
        weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for t, d in df.items()}
        shared = spark.sparkContext.broadcast([(q, [(t, weight[t] * c) for t, c in ts.items() if t in weight]) for q, ts in counts])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [x for x in shared.value if x[1]]
            names = {t for _, ts in own for t, _ in ts}
            best: list[list[tuple]] = [[] for _ in own]
            for b in batches:
                for i in range(b.num_rows):
                    shard = _Shard(b.slice(i, 1).to_pylist()[0], names)
                    for s in range(0, len(own), AT_ONCE):
                        part = own[s : s + AT_ONCE]
                        least = np.array([-best[s + j][-1][0] if len(best[s + j]) == k else 0 for j in range(len(part))], np.int64)
                        for q, d, score in zip(*[x.tolist() for x in shard.best([ts for _, ts in part], k, least)], strict=True):
                            doc = shard.ids[d]
                            best[s + q].append((-score, doc is None, doc or 0))
                        for j in range(s, s + len(part)):
                            best[j] = sorted(best[j])[:k]
            out = [(own[j][0], None if null else doc, -score) for j, rows in enumerate(best) for score, null, doc in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["_q", "doc_id", "score"])

        got = index.shards.mapInArrow(run, "_q long, doc_id long, score long")
        ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        part = ranked.join(asked.select("_q", "item_id"), "_q").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        part = written(part, "found") if n_blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found
