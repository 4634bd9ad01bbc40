"""Exact substring deduplication over suffix arrays.

What can repeat is found first. Every 50-byte string holds a byte string of 16 whose hash is the smallest of the 35 in it, the leftmost
of equal ones: its anchor. Equal strings have equal anchors at equal places, and with them the 16 bytes before the anchor (where 17 or more
of the string's bytes lie there) or the 16 bytes after it. These 32 bytes are the string's key. Strings of one key that follow each
other in a text are a piece, of 50 to 67 bytes. Keys that occur in two documents are gathered in a sorted store; only their pieces go on. Equal
pieces are one, with the smallest document that holds it.

The distinct pieces go to shards by key. What several pieces of a key have is told by a suffix array of their bytes, refined by prefix
doubling (8, 16, 32, 50 bytes: no more is asked) and only over suffixes of so many bytes; suffixes that share 50 bytes are a run, and the
smallest document of a run tells which strings of a piece also start earlier. Pieces of a key with too many places are cut into
pieces of up to six strings, which go to shards by the 45 bytes that these share.

At last every document looks its pieces up, by binary search in sorted stores, and removes what they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, new_folder, spread, written
from .store import Store, build, mix, put_arrays, runs, shard_of

#: Length of a repeated string and of an anchor, both in bytes.
LENGTH, ANCHOR = 50, 16
#: Strings of LENGTH that hold one anchor, and bytes from the first of them to the anchor.
WINDOW = LENGTH - ANCHOR + 1
SIDE = WINDOW - 1
#: Strings that have their anchor so far on, or farther, share the bytes before it; the others those after it.
HALF = ANCHOR + 1
#: Keys of a shard in the first pass and places of a shard in the second (they bound a task's memory), pieces of a suffix array, and places of one key beyond which its pieces are cut.
KEYS_PER_SHARD, PLACES_PER_SHARD, CONTEXTS, MOST_OF_AN_ANCHOR = 600_000, 150_000, 5_000, 20_000
#: Strings of a piece of such a key.
FEW = 6
#: Low bytes of a key that are not kept. Keys that look equal only add pieces; the suffix arrays compare bytes.
DROPPED = 2
#: Bytes of texts that are worked on at once (more only where one text has more), and those after which keys or pieces are sent on.
STRETCH, HELD = 1 << 22, 1 << 25
#: Keys or pieces after which these are sent on.
MOST_HELD = 600_000


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every n neighbours."""
    have = 1
    while have * 2 <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def anchors(data: np.ndarray) -> np.ndarray:
    """For each 50-byte string of at most 2^17 bytes, from the first on, the place of its anchor."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    h, have = data.astype(np.uint32) + np.uint32(1), 1
    for factor in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F):
        h = h[:-have] * np.uint32(factor) + h[have:]
        have *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    # 15 bits of the hash, then the place: the least of these is the leftmost of the smallest
    h = (h & np.uint32(0xFFFE0000)) | np.arange(len(h), dtype=np.uint32)
    return (_sliding(h, WINDOW, np.minimum) & np.uint32(0x1FFFF)).astype(np.int64)


def _documents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one sequence, and where each begins (and the last ends). Null: empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (id, text), about STRETCH bytes of texts at a time."""
    for b in batches:
        if b.num_rows:
            group = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)).astype(np.int64)) // STRETCH
            edges = [*runs(group).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield b.slice(lo, hi - lo)


def _strings_by_key(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all strings of one key that follow each other in a document: place of the anchor, first and last string, number of the document, key."""
    at, low, before, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], -1, 1 << 16
    for a in range(0, len(data) - LENGTH + 1, step):
        place = anchors(data[a : a + step + LENGTH - 1]) + a
        new = np.concatenate([[place[0] != before], place[1:] != place[:-1]])
        begins = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, a + len(place))]
        new[begins - a] = True
        new, before = np.flatnonzero(new), place[-1]
        at.append(place[new])
        low.append(new + a)
    at, low = np.concatenate(at), np.concatenate(low)
    doc = np.searchsorted(bounds, low, side="right") - 1
    high = np.minimum(np.append(low[1:], max(0, len(data) - LENGTH + 1))[: len(low)] - 1, bounds[doc + 1] - LENGTH)
    whole = low <= high
    at, low, high, doc = at[whole], low[whole], high[whole], doc[whole]
    words = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)) if len(data) > 7 else np.zeros(0, "<u8")
    own = mix(mix(words[at]) ^ words[at + 8])
    left, right = np.flatnonzero(low <= at - HALF), np.flatnonzero(high > at - HALF)
    keys = [mix(mix(own[left] ^ words[at[left] - 16]) ^ words[at[left] - 8]), mix(mix(~own[right] ^ words[at[right] + 16]) ^ words[at[right] + 24])]
    both, cut = np.concatenate([left, right]), np.uint64(8 * DROPPED)
    low = np.concatenate([low[left], np.maximum(low[right], at[right] - HALF + 1)])
    high = np.concatenate([np.minimum(high[left], at[left] - HALF), high[right]])
    return at[both], low, high, doc[both], np.concatenate(keys) >> cut << cut


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of the suffixes of data; symbols are 0 to 256, beyond the end lies -1.

    The first order is by 7 symbols packed in one number; then the compared length doubles, and only suffixes that still
    share their rank are sorted again, by the rank of the suffix that lies the compared length further on.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    have = 7
    while True:
        open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # places of the groups of more than one suffix
        if not len(open_):
            break
        who = order[open_]
        pair = rank[who] * (n + 2) + rank[np.minimum(who + have, n)] + 1
        sub = np.argsort(pair)
        who, pair = who[sub], pair[sub]
        order[open_] = who
        split = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[open_] |= split
        rank[who] = np.maximum.accumulate(np.where(split, open_, 0))
        have *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, lane: int = 16) -> np.ndarray:
    """Kasai's lengths, by place in the order: symbols that a suffix shares with the one before it, up to `depth`; 0 for the first.

    From one place of the text to the next the length falls by 1 at most. The text is cut into lanes that are walked side
    by side; each starts its next comparison where the last one allows.
    """
    n = len(data)
    by_place = np.zeros(n, np.int64)
    if n < 2:
        return by_place
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int32), np.full(depth, -1, np.int32)])
    last = np.zeros(-(-n // lane), np.int64)
    for j in range(lane):
        at = np.arange(j, n, lane)
        known = np.maximum(last[: len(at)] - 1, 0)
        prior = before[at]
        known[prior < 0] = 0
        live = np.flatnonzero((prior >= 0) & (known < depth))
        while len(live):
            x, y, k = at[live], prior[live], known[live]
            same = (padded[x + k] == padded[y + k]) & (np.maximum(x, y) + k < n)
            live = live[same]
            known[live] += 1
            live = live[known[live] < depth]
        by_place[at] = known
        last[: len(at)] = known
    return by_place[order]


def sorted_strings(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array cut at 50 bytes: the places with so many bytes left, ordered by these, and whether each differs from the one before.

    left: bytes from each place to the end of its text. Prefix doubling: the first order is by 8 bytes, then by 16, 32 and 50, each from ranks
    of the order before, over the places that have so many bytes. Equal ranks at 50 are what Kasai's lengths of 50 or more would tell.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key, have = np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64), 8
    at = np.flatnonzero(left >= have)
    key, rank = key[at], np.zeros(len(data), np.uint64)
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        if have == LENGTH:
            return at[order], new
        rank[at[order]] = np.cumsum(new, dtype=np.uint64)
        step = min(have, LENGTH - have)
        at, have = np.flatnonzero(left >= have + step), have + step
        key = (rank[at] << np.uint64(32)) | rank[at + step]


def earlier_strings(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each piece (its bytes follow the last one's) a mask of its 50-byte strings (bit j: from byte j on) that a piece of a smaller document holds too."""
    ends = np.cumsum(sizes)
    at, new = sorted_strings(data, np.repeat(ends, sizes) - np.arange(len(data)))
    owner = np.repeat(np.arange(len(sizes)), sizes)[at]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner], first)
    earlier = np.repeat(least, np.diff(np.append(first, len(at)))) < docs[owner]
    owner, byte = owner[earlier], (at - (ends - sizes)[owner])[earlier]
    return np.bincount(owner, (1 << byte).astype(float), len(sizes)).astype(np.int64)  # each bit once


def _earlier_of_many(pieces: list[bytes], docs: np.ndarray) -> np.ndarray:
    """The same for pieces of one key that are too many for an array: their strings go to arrays one by one, equal ones to the same, as these take whole ranges of a hash."""
    n = np.array([len(p) - LENGTH + 1 for p in pieces])
    owner, byte = np.repeat(np.arange(len(pieces)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = np.fromiter((xxhash.xxh3_64_intdigest(p[j : j + LENGTH]) for p in pieces for j in range(len(p) - LENGTH + 1)), np.uint64, len(owner))
    order = np.argsort(h)
    mask = np.zeros(len(pieces), np.int64)
    for a, e in _whole(runs(h[order]), len(order), CONTEXTS):
        o, j = owner[order[a:e]], byte[order[a:e]]
        data = b"".join([pieces[k][b : b + LENGTH] for k, b in zip(o.tolist(), j.tolist(), strict=True)])
        np.bitwise_or.at(mask, o, earlier_strings(np.frombuffer(data, np.uint8), np.full(e - a, LENGTH), docs[o]) << j)
    return mask


def _whole(starts: np.ndarray, n: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `most` of n rows that hold whole groups, which begin at starts."""
    edges, a = np.append(starts, n), 0
    while a < n:
        e = max(int(edges[np.searchsorted(edges, a + most, side="right") - 1]), int(edges[np.searchsorted(edges, a, side="right")]))
        yield a, e
        a = e


def _copies(texts: DataFrame) -> tuple[Store, int]:
    """A store of the texts that several rows have: smallest document, and 64 more bits of the text's hash; and the bytes of all texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _stretches(batches):
            data, bounds = _documents(b.column(1))
            keys = _text_keys(data, bounds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.diff(bounds))], ["doc_id", "key", "check", "n_bytes"])

    keys = written(texts.select("doc_id", "_text").mapInArrow(sign, "doc_id long, key long, check long, n_bytes long"), "text-keys")
    many = written(keys.groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("key").agg(F.min(F.struct("check", "first")).alias("x")).select("key", "x.first", "x.check"), "copies")
    n_bytes = keys.agg(F.sum("n_bytes")).first()[0] or 0
    store = build(many, "copies-store", max(spread(texts.sparkSession), -(-many.count() // 500_000)))
    drop_written(keys)
    drop_written(many)
    return store, n_bytes


def _text_keys(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw, digest, edges = memoryview(data), xxhash.xxh3_128_digest, bounds.tolist()
    return np.frombuffer(b"".join([digest(raw[a:e]) for a, e in zip(edges[:-1], edges[1:], strict=True)]), "<i8").reshape(-1, 2)


def _later_copies(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, copies: Store) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, bool)
    keys = _text_keys(data, bounds)
    first, check = copies.find(mix(keys[:, 0].astype(np.uint64)))
    return (check == keys[:, 1]) & (check != 0) & (first < ids)


def _first_texts(b: pa.RecordBatch, copies: Store) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and bounds of the rows (id, text) that are no later copies of a text."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    data, bounds = _documents(b.column(1))
    later = _later_copies(ids, data, bounds, copies)
    if later.any():
        data, bounds = _documents(b.column(1).filter(pa.array(~later)))
    return ids[~later], data, bounds


def _packets(shard: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])


def _shared_keys(texts: DataFrame, copies: Store, n: int) -> tuple[Store, int]:
    """A store of the keys that two rows hold, with the number of their places, and the sum of these numbers."""
    folder = new_folder(texts.sparkSession, "keys")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h)
            h, d = h[order], d[order]
            first = runs(h)
            split = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.zeros(0, bool)
            counts = (np.diff(np.append(first, len(h))).clip(max=2**30) * 2 + split).astype("<u4")
            h = h[first]
            cuts = np.searchsorted(shard_of(h, n), np.arange(n + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            cut_off = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, DROPPED:]
            return _packets(some, [cut_off[cuts[s] : cuts[s + 1]].tobytes() + counts[cuts[s] : cuts[s + 1]].tobytes() for s in some])

        hashes, docs, held, row = [], [], 0, 0
        for b in _stretches(batches):
            _, data, bounds = _first_texts(b, copies)
            *_, d, h = _strings_by_key(data, bounds)
            hashes.append(h)
            docs.append((d + row).astype(np.int32))
            held, row = held + len(h), row + len(bounds)
            if held >= MOST_HELD:
                yield flush()
                hashes, docs, held, row = [], [], 0, 0
        if hashes:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(x)
        for s in sorted(held):
            packets = held.pop(s)
            each = [len(x) // (12 - DROPPED) for x in packets]
            h = np.zeros((sum(each), 8), np.uint8)
            h[:, DROPPED:] = np.concatenate([np.frombuffer(x, np.uint8, (8 - DROPPED) * m).reshape(m, -1) for x, m in zip(packets, each, strict=True)])
            h = h.view("<u8")[:, 0]
            c = np.concatenate([np.frombuffer(x, "<u4", m, (8 - DROPPED) * m) for x, m in zip(packets, each, strict=True)]).astype(np.int64)
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = runs(h)
            places, split, parts = np.add.reduceat(c >> 1, first), np.maximum.reduceat(c & 1, first), np.diff(np.append(first, len(h)))
            shared = (split > 0) | (parts > 1)
            put_arrays(folder, s, [h[first][shared], np.minimum(places[shared], 2**31).astype("u4")])
            yield pa.RecordBatch.from_arrays([pa.array([int(places[shared].sum())], pa.int64())], ["n"])

    sent = texts.select("doc_id", "_text").mapInArrow(collect, "shard int, data binary").repartitionById(n, "shard")
    total = sent.mapInArrow(add, "n long").agg(F.sum("n")).first()[0] or 0
    return Store(folder, n, ("u4",)), total


def _shared_pieces(data: np.ndarray, bounds: np.ndarray, shared: Store) -> tuple[np.ndarray, ...]:
    """The pieces of shared keys: their group's hash, document number, first and last byte, and own key. Pieces of one group are compared."""
    at, low, high, doc, group = _strings_by_key(data, bounds)
    (places,) = shared.find(group) if len(group) else (np.zeros(0, "u4"),)
    some, hot = (places > 0) & (places <= MOST_OF_AN_ANCHOR), places > MOST_OF_AN_ANCHOR
    parts, raw = [(group[some], doc[some], low[some], high[some] + LENGTH)], data.tobytes()
    at, low, high, doc = at[hot], low[hot], high[hot], doc[hot]
    for k in range(0, WINDOW if len(at) else 0, FEW):
        begin = at - SIDE + k
        a, e = np.maximum(low, begin), np.minimum(high, begin + FEW - 1)
        has = a <= e
        common = [raw[b : b + LENGTH - FEW + 1] for b in (begin[has] + FEW - 1).tolist()]
        parts.append((mix(np.array([xxhash.xxh3_64_intdigest(c, k) for c in common], np.uint64)), doc[has], a[has], e[has] + LENGTH))
    group, doc, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    digest = xxhash.xxh3_64_intdigest
    key = np.array([digest(raw[a:e]) for a, e in zip(low.tolist(), high.tolist(), strict=True)], np.uint64)
    return group, doc, low, high, key


def _piece_masks(texts: DataFrame, copies: Store, shared: Store, places: int) -> Store:
    """A store by piece, in the shard of its group: the smallest document that holds it, and the mask of its strings that start in one still smaller."""
    n, folder = max(spread(texts.sparkSession), -(-places // PLACES_PER_SHARD)), new_folder(texts.sparkSession, "pieces")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            group, doc, key, low, size = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            first = runs(key[order])
            doc, one = np.minimum.reduceat(doc[order], first) if len(first) else doc, order[first]
            order = np.argsort(group[one])  # which is the order of shards too
            doc, one = doc[order], one[order]
            group, low, size, raw = group[one], low[one], size[one], b"".join(raws)
            cuts = np.searchsorted(shard_of(group, n), np.arange(n + 1, dtype=np.uint64))
            some, squeeze, packets = np.flatnonzero(np.diff(cuts)), zstandard.ZstdCompressor(level=1), []
            for s in some:
                x = slice(cuts[s], cuts[s + 1])
                head = np.column_stack([group[x], doc[x].view(np.uint64)])
                body = b"".join([raw[a : a + m] for a, m in zip(low[x].tolist(), size[x].tolist(), strict=True)])
                packets.append(squeeze.compress(np.int64(len(head)).tobytes() + head.view(np.uint8).reshape(len(head), 16).T.tobytes() + size[x].astype(np.uint8).tobytes() + body))
            return _packets(some, packets)

        held, raws, n_held, n_bytes = [], [], 0, 0
        for b in _stretches(batches):
            ids, data, bounds = _first_texts(b, copies)
            group, doc, low, high, key = _shared_pieces(data, bounds, shared)
            held.append((group, ids[doc], key, low + n_bytes, high - low))
            raws.append(data.tobytes())
            n_held, n_bytes = n_held + len(key), n_bytes + len(data)
            if n_held >= MOST_HELD or n_bytes >= HELD:
                yield flush()
                held, raws, n_held, n_bytes = [], [], 0, 0
        if held:
            yield flush()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(x)
        for s in sorted(held):
            heads, sizes, bodies = [], [], []
            for x in map(zstandard.ZstdDecompressor().decompress, held.pop(s)):
                m = int(np.frombuffer(x, np.int64, 1)[0])
                heads.append(np.ascontiguousarray(np.frombuffer(x, np.uint8, 16 * m, 8).reshape(16, m).T).view(np.uint64))
                sizes.append(np.frombuffer(x, np.uint8, m, 8 + 16 * m))
                bodies.append(x[8 + 17 * m :])
            (group, doc), size, body = np.concatenate(heads).T, np.concatenate(sizes).astype(np.int64), b"".join(bodies)
            ends = np.cumsum(size).tolist()
            pieces = [body[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)]
            key = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64)
            order = np.lexsort((key, group))
            g, k = group[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
            doc, one, g, k = np.minimum.reduceat(doc.view(np.int64)[order], first), order[first], g[first], k[first]
            mask, begin = np.zeros(len(g), np.int64), runs(g)
            n_of = np.repeat(np.diff(np.append(begin, len(g))), np.diff(np.append(begin, len(g))))
            many = np.flatnonzero(n_of > 1)  # a group of a single piece has nothing to compare
            for a, e in _whole(runs(g[many]), len(many), CONTEXTS):
                rows = many[a:e]
                part = [pieces[i] for i in one[rows].tolist()]
                if n_of[rows[0]] > MOST_OF_AN_ANCHOR:
                    mask[rows] = _earlier_of_many(part, doc[rows])
                else:
                    mask[rows] = earlier_strings(np.frombuffer(b"".join(part), np.uint8), size[one[rows]], doc[rows])
            order = np.argsort(k)
            put_arrays(folder, s, [k[order], doc[order], mask[order].astype("u4")])
            yield pa.RecordBatch.from_arrays([pa.array([len(k)], pa.int64())], ["n"])

    texts.select("doc_id", "_text").mapInArrow(collect, "shard int, data binary").repartitionById(n, "shard").mapInArrow(work, "n long").agg(F.sum("n")).first()
    return Store(folder, n, ("i8", "u4"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each removed run of bytes) and kept (the bytes that are left) of every row.

    A byte goes if a 50-byte string that covers it, within one text, also starts in a row of a smaller id; strings are judged on
    the input. Rows of equal ids don't remove each other's bytes; rows without an id neither remove nor lose any; null
    texts are empty. Texts under 50 bytes stay whole. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    texts = rows.filter("doc_id IS NOT NULL AND _text IS NOT NULL")
    copies, n_bytes = _copies(texts)
    shared, places = _shared_keys(texts, copies, max(spread(docs.sparkSession), -(-n_bytes // (12 * KEYS_PER_SHARD))))
    pieces = _piece_masks(texts, copies, shared, places)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _stretches(batches):
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            all_data, all_bounds = _documents(b.column(1))
            sizes = np.diff(all_bounds)
            later = known & _later_copies(ids, all_data, all_bounds, copies)
            looked = known & ~later
            data, bounds = _documents(b.column(1).filter(pa.array(looked)))
            group, doc, low, high, key = _shared_pieces(data, bounds, shared)
            least, mask = pieces.find(key, shard_of(group, pieces.shards).astype(np.int64))
            mask = np.where(least < ids[looked][doc], np.int64(2**WINDOW - 1), mask.astype(np.int64))
            starts = np.zeros(len(data) + LENGTH, bool)  # where a string that goes begins, LENGTH places on
            for j in range(HALF + 1):
                starts[low[((mask >> j) & 1 == 1) & (low + j + LENGTH <= high)] + j + LENGTH] = True
            so_far = np.cumsum(starts, dtype=np.int32)
            gone = np.repeat(later & (sizes >= LENGTH), sizes)
            gone[np.repeat(looked, sizes)] = so_far[LENGTH:] > so_far[:-LENGTH]
            # a run of bytes that go begins and ends in one text
            begins, ends = np.concatenate([gone, [False]]), np.concatenate([[False], gone])
            begins[1:] &= ~gone
            ends[:-1] &= ~gone
            inner = all_bounds[(all_bounds > 0) & (all_bounds < len(gone))]
            begins[inner], ends[inner] = gone[inner], gone[inner - 1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
            row = np.searchsorted(all_bounds, begins, side="right") - 1
            offset = lambda at: pa.array(at.astype(np.int32))
            spans = pa.ListArray.from_arrays(offset(np.searchsorted(begins, all_bounds)), pa.StructArray.from_arrays([pa.array(begins - all_bounds[row]), pa.array(ends - all_bounds[row])], ["start", "end"]))
            rest = all_data[~gone]
            kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offset(all_bounds - np.concatenate([[0], np.cumsum(gone)])[all_bounds]).buffers()[1], pa.py_buffer(rest.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), spans, kept], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
