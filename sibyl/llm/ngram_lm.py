"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Counting: each task turns its texts into word ids (48 bits of a hash), counts word pairs and sends them, packed, to the
shard that the pair's key falls into. There the counts are added up and written as a sorted array; what a shard knows of
each preceding and each following word goes on to that word's shard, which adds it up to the context table (total, number
of followers seen once, twice, more often) and the word table (count, number of different words before it).

Scoring: the workers memory-map the three tables and look up a few thousand documents' words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, new_folder, spread, written
from .store import Store, mix, put_arrays, runs, shard_of

#: Ids beyond the 48 bits of a word's hash.
END, BEGIN = np.int64(1 << 48), np.int64((1 << 48) + 1)
#: Bytes of text for each shard of the tables.
SHARD_BYTES = 8_000_000
#: Words whose hashes a worker keeps, and words whose pairs it counts at once.
MOST_KEPT, MOST_AT_ONCE = 200_000, 400_000


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word) >> 16
        return value


_ids = _Ids()


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words and of each text's end; the id before each; tokens of each text. A null text has its end only."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ids = np.full(int(sizes.sum()), END, np.int64)
    ends = np.cumsum(sizes) - 1
    at = np.ones(len(ids), bool)
    at[ends] = False
    ids[at] = np.fromiter((i for w in words for i in map(_ids.__getitem__, w)), np.int64, len(ids) - len(sizes))
    before = np.concatenate([[BEGIN], ids[:-1]])
    before[ends - sizes + 1] = BEGIN
    return ids, before, sizes


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before.astype(np.uint64)) + word.astype(np.uint64))


def word_key(word: np.ndarray) -> np.ndarray:
    return mix(word.astype(np.uint64))


def _pack(*columns: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; sorted columns shrink most."""
    planes = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return np.int64(len(columns[0])).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, n_columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n * n_columns), np.uint8)
    return [np.ascontiguousarray(p.T).view("<i8").reshape(-1) for p in planes.reshape(n_columns, 8, n)]


def _packets(shard: np.ndarray, n_shards: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Rows packed for each shard; the order within a shard is kept."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n_shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[s] : cuts[s + 1]]
        yield int(s), _pack(*[c[rows] for c in columns])


def _gathered(sent: DataFrame, n_shards: int, fn, schema: str) -> DataFrame:
    """fn(shard, packets) for every shard, whose packets meet in one task; fn yields rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(data)
        for s in sorted(held):
            yield from fn(s, held.pop(s))

    return sent.repartitionById(n_shards, F.col("shard").cast("int")).mapInArrow(run, schema)


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of entries seen once to four times; where one is 0, the plain discount stands in."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else y for k in range(3)]
    return [min(max(d, 0.01), k + 0.99) for k, d in enumerate(out)]


@dataclass
class KneserNey:
    """The tables' places and the sums. n_tokens: training tokens; n_types: distinct ones; n_pairs: distinct pairs."""

    pairs: Store
    contexts: Store
    words: Store
    n_tokens: int
    n_types: int
    n_pairs: int
    pair_discounts: list[float]
    word_discounts: list[float]
    word_left: float

    def log10(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after the one before it, and the token's training count.

        Unknown words share what the words' discounts leave over; after an unknown word the word probability stands alone.
        """
        count, histories = self.words.find(word_key(ids))
        cut = np.array([0.0, *self.word_discounts])
        p = self.word_left / (self.n_types + 1) + np.maximum(histories - cut[np.minimum(histories, 3)], 0) / max(1, self.n_pairs)
        if not self.n_pairs:
            p[:] = 1.0
        total, once, twice, more = self.contexts.find(word_key(before))
        (pair,) = self.pairs.find(pair_key(before, ids))
        cut = np.array([0.0, *self.pair_discounts])
        left = (cut[1] * once + cut[2] * twice + cut[3] * more) / np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(pair - cut[np.minimum(pair, 3)], 0) / np.maximum(total, 1) + left * p, p)
        return np.log10(p), count


def fit(docs: DataFrame, text_col: str = "text") -> KneserNey:
    """Counts all texts of docs. Null texts count as empty: they hold an end. What is shuffled and stored grows with the corpus."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(spread(spark), -(-size // SHARD_BYTES))
    folders = [new_folder(spark, f"lm-{x}") for x in ("pairs", "contexts", "words")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[np.ndarray], before: list[np.ndarray]) -> pa.RecordBatch:
            w, b = np.concatenate(ids), np.concatenate(before)
            key = pair_key(b, w)
            order = np.argsort(key)
            first = runs(key[order])
            w, b, c = w[order][first], b[order][first], np.diff(np.append(first, len(key)))
            shard = shard_of(key[order][first], n)
            by = np.lexsort((b,))
            sent = list(_packets(shard[by], n, [b[by], w[by], c[by]]))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in sent], pa.int32()), pa.array([d for _, d in sent], pa.binary())], ["shard", "data"])

        ids, before, held = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                i, b, _ = tokens(batch.column(0).slice(k, 512).to_pylist())
                ids.append(i)
                before.append(b)
                held += len(i)
                if held >= MOST_AT_ONCE:
                    yield flush(ids, before)
                    ids, before, held = [], [], 0
        if held:
            yield flush(ids, before)

    def add_pairs(s: int, packets: list[bytes]) -> Iterator[pa.RecordBatch]:
        b, w, c = (np.concatenate(x) for x in zip(*[_unpack(p, 3) for p in packets], strict=True))
        packets.clear()
        key = pair_key(b, w)
        order = np.argsort(key)
        first = runs(key[order])
        c = np.add.reduceat(c[order], first)
        b, w, key = b[order][first], w[order][first], key[order][first]
        put_arrays(folders[0], s, [key, np.minimum(c, 2**32 - 1).astype("u4")])
        out = [(-1, b"")]
        for column, sums in ((b, [c, c == 1, c == 2, c > 2]), (w, [c, np.ones_like(c)])):
            order = np.argsort(column, kind="stable")
            first = runs(column[order])
            rows = [column[order][first], *[np.add.reduceat(x[order].astype(np.int64), first) for x in sums]]
            out += [(t + n * (column is w), d) for t, d in _packets(shard_of(word_key(rows[0]), n), n, rows)]
        often = np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()  # pairs seen once to four times
        numbers = [pa.array([x, *[None] * (len(out) - 1)], pa.int64()) for x in often]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary()), *numbers], ["shard", "data", "n1", "n2", "n3", "n4"])

    def add_words(s: int, packets: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*[_unpack(p, 5 if s < n else 3) for p in packets], strict=True)]
        packets.clear()
        key = word_key(columns[0])
        order = np.argsort(key, kind="stable")
        first = runs(key[order])
        sums = [np.add.reduceat(x[order], first) for x in columns[1:]]
        put_arrays(folders[1 if s < n else 2], s % n, [key[order][first], *sums])
        counts = np.bincount(np.minimum(sums[-1], 5), minlength=6)[1:5] if s >= n else np.zeros(4)
        row = [int(sums[0].sum()) if s >= n else 0, len(first) if s >= n else 0, int(sums[-1].sum()) if s >= n else 0, *[int(x) for x in counts]]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["tokens", "types", "pairs", "n1", "n2", "n3", "n4"])

    pairs = docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(count, "shard int, data binary")
    onward = written(_gathered(pairs, n, add_pairs, "shard int, data binary, n1 long, n2 long, n3 long, n4 long"), "lm-sums")
    pair_counts = onward.filter("shard < 0").select("n1", "n2", "n3", "n4").groupBy().sum().first()
    sums = _gathered(onward.filter("shard >= 0").select("shard", "data"), 2 * n, add_words, "tokens long, types long, pairs long, n1 long, n2 long, n3 long, n4 long").groupBy().sum().first()
    total = [int(x or 0) for x in sums]
    word_discounts = _discounts(total[3:])
    left = sum(d * k for d, k in zip(word_discounts, [total[3], total[4], total[1] - total[3] - total[4]], strict=True)) / max(1, total[2])
    return KneserNey(Store(folders[0], n, ("u4",)), Store(folders[1], n, ("i8",) * 4), Store(folders[2], n, ("i8", "i8")), total[0], total[1], total[2], _discounts([int(x or 0) for x in pair_counts]), word_discounts, left)


def scored(docs: DataFrame, model: KneserNey, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns, n_tokens, n_known, base_score (add-one word probabilities) and score (the model's) of each whole text, log10. Null texts count as empty."""

    def score(texts: list[str | None]) -> list[np.ndarray]:
        ids, before, sizes = tokens(texts)
        p, count = model.log10(ids, before)
        starts = np.cumsum(sizes) - sizes
        base = np.log10((count + 1) / (model.n_tokens + model.n_types + 1))
        return [sizes, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(p, starts)]

    return map_columns(docs, keep, [F.col(text_col)], [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")], score, rows=512)


def perplexity(score: Column, n_tokens: Column) -> Column:
    """Perplexity from a log10 score."""
    return F.pow(F.lit(10.0), -score / n_tokens)
