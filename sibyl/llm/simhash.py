"""SimHash near-duplicates by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into three segments of up to 23 bits. Of two fingerprints that differ in 4 bits or fewer, two segments
together differ in 2 or fewer. The binary Golay code (23, 12) covers all 23-bit words within 3 bits, so words that differ in at
most 2 bits are both within 4 bits of a common codeword; a word has 1 or 6 such codewords. The key of a pair of segments is the
pair of their codewords' indices: every linked pair of fingerprints shares one. Fingerprints that share a key are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, spread, written
from .components import components

#: Segments of the fingerprint: first bit and number of bits. Their differences are at most DISTANCE together.
SEGMENTS, DISTANCE = ((0, 22), (22, 21), (43, 21)), 4
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints with one key that a task compares at once; larger groups are compared in blocks.
BLOCK = 32_768

#: For each byte, its bits in the eight bytes of a number: sums of up to 255 of them count bits.
_LANES = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials after division by the generator."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def near_patterns() -> np.ndarray:
    """For each remainder the error patterns of up to 4 bits that leave it: 1 or 6, filled up with -1."""
    patterns = np.array([sum(1 << b for b in bits) for k in range(5) for bits in combinations(range(23), k)], np.int64)
    rest = _remainders(patterns)
    order = np.argsort(rest, kind="stable")
    out, starts = np.full((2048, 6), -1, np.int64), np.searchsorted(rest[order], np.arange(2049))
    for s in range(2048):
        found = patterns[order[starts[s] : starts[s + 1]]]
        out[s, : len(found)] = found
    return out


def codeword_indices(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each word, -1 where there are fewer than 6."""
    near = patterns[_remainders(words)]
    return np.where(near >= 0, (words.astype(np.int64)[:, None] ^ near) >> 11, -1)


def fingerprints(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of whole texts: a bit is set if it is set in over half of the shingles' hashes, repeats included. No words: 0."""
    hashes, sizes = [], []
    digest = xxhash.xxh64_intdigest
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        text = b" ".join(words)
        if len(words) <= shingle:
            hashes += [digest(text, seed)] if words else []
            sizes.append(min(1, len(words)))
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -shingle]]).tolist()
        hashes += [digest(text[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        sizes.append(len(words) - shingle + 1)
    out, sizes = np.zeros(len(texts), np.uint64), np.array(sizes, np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    planes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    blocks = -(-n // 255)  # at most 255 hashes are summed up in one number
    first_block = np.cumsum(blocks) - blocks
    at = np.repeat(np.cumsum(n) - n, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first_block, blocks))
    for k in range(8):
        sums = np.add.reduceat(_LANES[planes[:, k]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, first_block) * 2 > n[:, None]
        out[some] |= np.packbits(ones, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4, column: str = "fp") -> DataFrame:
    """keep's columns and the fingerprint as a signed long. Null texts have no words."""
    return map_columns(docs, keep, [F.col(text_col)], [(column, "long")], lambda texts: [fingerprints(texts, shingle).view(np.int64)])


def _linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among these fingerprints: a tree for each component."""
    a, b, left = [], [], np.unique(fps)
    while len(left):
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            x = open_.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= DISTANCE
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x))
                b.append(got)
                open_ += got.tolist()
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _group_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of a sorted key column; small groups are compared all at once, by distance in the column."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    few = np.repeat(sizes, sizes) <= 8
    for k in range(1, min(8, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[k:] == key[:-k]) & few[k:])
        i = i[np.bitwise_count((fp[i] ^ fp[i + k]).view(np.uint64)) <= DISTANCE]
        a.append(fp[i])
        b.append(fp[i + k])
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        x, y = _linked(fp[s : s + n])
        a.append(x)
        b.append(y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.minimum(np.concatenate(a), np.concatenate(b)), np.maximum(np.concatenate(a), np.concatenate(b))]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pairs[0], pairs[1]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all fingerprints within DISTANCE bits of each other."""
    patterns = near_patterns()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False)
                near = [codeword_indices((fp.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << n) - 1), patterns) for a, n in SEGMENTS]
                for p, (x, y) in enumerate(combinations(near, 2)):
                    key = np.where((x[:, :, None] >= 0) & (y[:, None, :] >= 0), (x[:, :, None] << 12) | y[:, None, :], -1).reshape(len(fp), -1)
                    row, at = np.nonzero(key >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key[row, at] | (p << 24), pa.int64()), pa.array(fp[row], pa.int64())], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        key, fp, too_large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            if too_large is not None:  # the rest of a group that is compared later
                n = int(np.searchsorted(key, too_large, side="right"))
                yield out(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                too_large = None
            last = int(np.searchsorted(key, key[-1]))  # its group may go on in the next batch
            if last:
                yield out(0, *_group_links(key[:last], fp[:last]))
                key, fp = key[last:], fp[last:]
            if len(key) > block:
                yield out(1, key, fp)
                too_large, key, fp = key[-1], key[:0], fp[:0]
        if len(key):
            yield out(0, *_group_links(key, fp))

    # each fingerprint makes some 85 keys: the small table is dealt over many tasks first
    tasks = min(10_000, max(spread(distinct.sparkSession), -(-distinct.count() // 20_000)))
    keyed = distinct.select("fp").repartition(tasks).mapInArrow(keys, "key long, fp long")
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "kind int, a long, b long"), "fp-links")
    large = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if large.isEmpty():
        return found.filter("kind = 0").select("a", "b")
    # a large group is dealt into blocks, and each two blocks meet
    counted = large.join(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block / 2)).cast("int").alias("n")), "key")
    dealt = counted.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    met = met.groupBy("key", "i", "j").applyInArrow(lambda t: pa.table(list(_linked(t.column("fp").to_numpy())), names=["a", "b"]), "a long, b long")
    return found.filter("kind = 0").select("a", "b").unionByName(met).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest id that links reach, itself included.

    Equal fingerprints are one vertex, so copies make no pairs. Rows without an id stay rows, and have the component of
    their fingerprint (null if no row there has an id). Repeated rows share a component. An empty table gives no rows.
    """
    fps = written(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), ["doc_id"], "_text", shingle), "fps")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-groups")
    member = components(links(distinct)).withColumnRenamed("id", "fp")
    grouped = written(distinct.join(member, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "fp-roots")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(grouped.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
