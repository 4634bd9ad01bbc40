"""Substring deduplication by MinHash bands over paragraphs.

A paragraph is a unit (a sentence, or a part of a long one, of the text's words, wherever its lines break) or a line of LEAST_LINE words
or more. Units are cut at places that the words around them decide, so a passage has the same units in every text. Equal paragraphs
are one from the start. Distinct ones get MinHash values over their five-word shingles, cut into bands; of the paragraphs that share a
band, the exact Jaccard similarity of the shingle sets decides which are linked. Components of these links, and of equality, are
the classes; the first paragraph of a class (smallest document id, then place) stays. The others count as repeated where they adjoin or
overlap to a run of LEAST_RUN words, so that a stock phrase alone, which any text may hold, is no repeated passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_SENT, drop_written, map_columns, written
from .components import components
from .store import mix

#: Words of a shingle, similarity from which paragraphs are linked, words from which a line is a paragraph beside its units, and words of a run that is removed.
SHINGLE, SIMILARITY, LEAST_LINE, LEAST_RUN = 5, 0.8, 40, 20
#: Words on both sides that a cut inside a sentence of more than twice as many depends on.
REACH = 8
#: Share of the pairs at the similarity that some band must find: of documents, and of paragraphs, of which a passage has several.
RECALL, PARAGRAPH_RECALL = 0.9995, 0.98
#: Bands of a paragraph at most: what is shuffled is a row for each paragraph and band.
MOST_BANDS = 4
#: Paragraphs of a band that are compared in one task; larger bands are compared in blocks.
BLOCK = 8_192
#: Places for the hashes of paragraphs that a task has sent, so as not to send equal ones again; a power of 2.
SENT = 1 << 20
#: Bytes of a band's key: a key shared by chance costs one comparison, no wrong link.
KEY = 6
#: Bits of a key that name its range, and pairs of key and paragraph that a task gathers before it deals them to the ranges.
RANGE_BITS, HELD = 12, 1 << 20
#: Bits of the number of words whose hashes a task keeps at hand.
MET_BITS = 19
#: Masks for the first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_PLACE = ("doc_id", "row", "begin", "n_words")
#: A paragraph of a text, in bytes.
UNIT = np.dtype([("begin", "<i4"), ("n_words", "<i4"), ("pid", "<i8")])


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, most_rows: int = 8, most_bands: int = 80) -> tuple[int, int]:
    """(bands, rows of a band): of the pairs that find the share `recall` at the similarity, the one with the fewest chance candidates (at 0.3) for up to 80 values."""
    found = []
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= 80 and bands <= most_bands:
            found.append((1 - (1 - 0.3**rows) ** bands, bands, rows))
    return min(found)[1:]


@dataclass
class Cut:
    """Paragraphs of some texts: their text's number, first word in it, number of words, and hash of the words; `at` is their first word in all the texts' word hashes."""

    hashes: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    n_words: np.ndarray
    at: np.ndarray
    pid: np.ndarray


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of n neighbours, from each place on."""
    out, have = x, 1
    while have * 2 <= n:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(x) - n + 1], out[n - have :]) if have < n else out


def _words(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are white space, and where words begin and end; the last byte must be white space."""
    space = (letters == 32) | ((letters >= 9) & (letters <= 13))
    edge = space[1:] != space[:-1]
    starts = np.flatnonzero(np.concatenate([~space[:1], edge & space[:-1]]))
    return space, starts, np.flatnonzero(edge & space[1:]) + 1


def _quick_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, of eight bytes of all words at a time; words of more than 64 bytes have another hash."""
    eights = np.ndarray(len(letters), "<u8", np.concatenate([letters, np.zeros(8, np.uint8)]), 0, (1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix(left.astype(np.uint64))
    long = np.flatnonzero(left > 64)
    own = np.flatnonzero(left <= 64) if len(long) else np.arange(len(left))
    at, left = starts[own], left[own]
    while len(own):
        out[own] = mix(out[own] ^ (eights[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(letters[starts[i] : ends[i]].tobytes())
    return out


class Met:
    """Hashes of words that were met before, at places that their quick hashes name; newer words take the places of older ones."""

    def __init__(self) -> None:
        self.quick, self.hashes = np.zeros(1 << MET_BITS, np.uint64), np.zeros(1 << MET_BITS, np.uint64)

    def find(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The XXH3 of each word."""
        quick = _quick_hashes(letters, starts, ends)
        place = quick >> np.uint64(64 - MET_BITS)
        out, new = self.hashes[place], np.flatnonzero(self.quick[place] != quick)
        if len(new):
            one, first, back = np.unique(quick[new], return_index=True, return_inverse=True)
            at, data = new[first], letters.tobytes()
            made = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)), np.uint64, len(at))
            out[new] = made[back]
            self.quick[place[at]], self.hashes[place[at]] = one, made
        return out


def cut(texts: list[str | None], met: Met | None = None) -> Cut:
    """The paragraphs of texts, in order.

    A unit ends with a sentence, where it has the words of a shingle. Inside long sentences, a unit begins where the hash of a word and the
    next is the least of REACH places before and after. Lines of LEAST_LINE words are paragraphs too. What has fewer words than a shingle is none.
    met has the hashes of words of texts cut before.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    letters = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    space, words, stops = _words(letters)  # where words begin and end
    bounds = np.searchsorted(words, np.cumsum([0, *[len(d) + 1 for d in data]]))
    n = len(words)
    hashes = (met or Met()).find(letters, words, stops)
    none = np.zeros(0, np.int64)
    if not n:
        return Cut(hashes, none, none, none, none, none)
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[bounds[1:]] = True
    last_of_text = last_of_text[1:]
    kept = ~space
    kept[stops] = True  # one space after each word
    raw, off = np.where(space, np.uint8(32), letters)[kept].tobytes(), np.concatenate([[0], np.cumsum(stops - words + 1)])
    last = letters[stops - 1]
    ends = (last == ord(".")) | (last == ord("!")) | (last == ord("?")) | last_of_text
    place = np.arange(n)
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), place, 0))
    end = np.flatnonzero(ends)[np.cumsum(ends) - ends]
    pair = mix(np.where(ends, hashes, mix(hashes) + np.append(hashes[1:], np.uint64(0))))
    inside = none
    if n > 2 * REACH:
        low, p = _least(pair, REACH), np.arange(REACH, n - REACH)
        inside = p[(pair[p] < low[p - REACH]) & (pair[p] <= low[p + 1]) & (p - begin[p] >= REACH) & (end[p] - p >= REACH)]
    after = np.flatnonzero(ends) + 1
    events = np.concatenate([inside, after])
    kinds = np.concatenate([np.ones(len(inside), bool), last_of_text[after - 1]])
    order = np.argsort(events, kind="stable")
    starts, before = [0], 0
    for at, always in zip(events[order].tolist(), kinds[order].tolist(), strict=True):
        if always or at - before >= SHINGLE:
            starts.append(at)
            before = at
    line = np.cumsum(letters == 10, dtype=np.int32)[words]  # texts end lines too
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    many = np.diff(np.append(head, n))
    starts, lines = np.array(starts, np.int64), many >= LEAST_LINE
    both = np.unique((np.concatenate([starts[:-1], head[lines]]) << 32) | np.concatenate([np.diff(starts), many[lines]]))
    at, n_words = both >> 32, both & 0xFFFFFFFF
    long = n_words >= SHINGLE
    at, n_words = at[long], n_words[long]
    text = np.searchsorted(bounds, at, side="right") - 1
    digest = xxhash.xxh3_64_intdigest
    pid = np.fromiter((digest(raw[a:b]) for a, b in zip(off[at].tolist(), (off[at + n_words] - 1).tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
    return Cut(hashes, text, at - bounds[text], n_words, at, pid)


def without_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """text without these runs, given as (first word, number of words) in order; a line break after a removed run stays."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, kept = [], 0
    for a, n in runs:
        b = a + n
        out.append(data[kept : spans[a][0]])
        kept = spans[b][0] if b < len(spans) else spans[b - 1][1]
        if b < len(spans) and b"\n" in data[spans[b - 1][1] : kept]:
            before = b"".join(out).rstrip(b" \t")
            out = [before if not before or before.endswith(b"\n") else before + b"\n"]
    return b"".join([*out, data[kept:]]).decode("utf-8", "surrogatepass")


def _shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles that begin at each word, from the words' hashes."""
    n = max(0, len(h) - size + 1)
    out = h[:n]
    for k in range(1, size):
        out = mix(out) + h[k : n + k]
    return mix(out)


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles; fewer words than a shingle: one of the whole sequence."""
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(_shingles(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), size))


def band_keys(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """A 64-bit key for each band of each stretch of flat, which may overlap and are not empty: the band's number and MinHash values."""
    if not len(starts):
        return np.zeros((0, bands), np.int64)
    rng = np.random.default_rng(seed)
    factor, add = rng.integers(1, 2**32, bands * rows, np.uint64) | np.uint64(1), rng.integers(0, 2**32, bands * rows, np.uint64)
    at = np.stack([starts, ends], 1).ravel()
    flat = np.append(flat, np.uint64(0))  # a place for the last end
    keys = np.zeros((len(starts), bands), np.uint64)
    high, low = (flat >> np.uint64(32)).astype(np.uint32), flat.astype(np.uint32)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            k = b * rows + r
            mixed = (low * np.uint32(factor[k])) ^ (high + np.uint32(add[k]))
            mixed *= np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(factor[k])
            key = mix(key + np.minimum.reduceat(mixed, at)[::2].astype(np.uint64))
        keys[:, b] = key
    return keys.view(np.int64)


def set_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """band_keys of sets of hashes."""
    ends = np.cumsum([len(s) for s in sets]).astype(np.int64)
    return band_keys(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], ends[:-1]]) if sets else ends, ends, bands, rows)


def linked(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect all sets of this group that are connected by similar pairs: a tree for each component.

    Similar sets share one of their rarest hashes (those that may be missing, and one), so a set is compared only with the sets that have
    one of these among their own rarest.
    """
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        near = both >= similarity * (len(sets[0]) + len(sets[1]) - both) - 1e-9
        return ([int(ids[0])], [int(ids[1])]) if near else ([], [])
    sizes = np.array([len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[at], owner))
    token, starts = rank[at][order], np.concatenate([[0], np.cumsum(sizes)])
    rare = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    among = np.arange(len(token)) - np.repeat(starts[:-1], sizes) < np.repeat(rare, sizes)
    by_token = np.argsort(token[among], kind="stable")
    holders, cuts = owner[among][by_token], np.searchsorted(token[among][by_token], np.arange(len(count) + 1))
    a, b, left, mark, n_left = [], [], np.ones(len(sets), bool), np.zeros(len(count), bool), len(sets)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], open_, n_left = False, [seed], n_left - 1
        while open_ and n_left:
            x = open_.pop()
            own = token[starts[x] : starts[x + 1]]
            near = np.concatenate([holders[cuts[t] : cuts[t + 1]] for t in own[: rare[x]].tolist()])
            near = np.unique(near[left[near]])
            if not len(near):
                continue
            mark[own] = True
            ends = np.cumsum(sizes[near])
            flat = np.arange(ends[-1]) + np.repeat(starts[near] - (ends - sizes[near]), sizes[near])
            shared = np.add.reduceat(mark[token[flat]].astype(np.int64), ends - sizes[near])
            mark[own] = False
            near = near[shared >= similarity * (sizes[near] + sizes[x] - shared) - 1e-9]
            a += [int(ids[x])] * len(near)
            b += ids[near].tolist()
            open_ += near.tolist()
            left[near] = False
            n_left -= len(near)
    return a, b


def _bytes(key: np.ndarray) -> np.ndarray:
    """The KEY bytes of each key, a row for each."""
    return np.ascontiguousarray(key, np.uint64).view(np.uint8).reshape(-1, 8)[:, :KEY]


def _numbers(rows: np.ndarray) -> np.ndarray:
    """The keys that _bytes gave."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :KEY] = rows
    return out.view(np.uint64).ravel()


def _stretches(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values, each of the rows up to one of the ends."""
    offsets = np.concatenate([[0], ends * rows.shape[1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _signed(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id and row of every text that has paragraphs, and in bytes its paragraphs (units, as UNIT) and their bands (keys); a text is cut once, here."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                c = cut(part.column(2).to_pylist(), met)
                units = np.empty(len(c.pid), UNIT)
                units["begin"], units["n_words"], units["pid"] = c.begin, c.n_words, c.pid
                keys = band_keys(_shingles(c.hashes), c.at, c.at + c.n_words - SHINGLE + 1, bands, rows).view(np.uint64) >> np.uint64(64 - 8 * KEY)
                ends = np.flatnonzero(np.diff(c.text, append=-1)) + 1
                at = pa.array(c.text[ends - 1])
                found = [_stretches(units.view(np.uint8).reshape(-1, UNIT.itemsize), ends), _stretches(_bytes(keys).reshape(-1, bands * KEY), ends)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *found], ["doc_id", "row", "units", "keys"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return written(texts.select("doc_id", "row", "text").mapInArrow(sign, f"doc_id {kind}, row long, units binary, keys binary"), "paragraphs")


def _shared_bands(signed: DataFrame, bands: int) -> DataFrame:
    """(key, pid) of the bands that two or more different paragraphs have, and (null, pid) of the paragraphs that stand at two places or more.

    Pairs go to ranges of keys, many in a row, and a range is sorted by itself.
    """

    def dealt(keys: list[np.ndarray], pids: list[np.ndarray]) -> pa.RecordBatch:
        key, pid = np.concatenate(keys), np.concatenate(pids)
        part = (key >> np.uint64(8 * KEY - RANGE_BITS)).astype(np.int16)
        order = np.argsort(part, kind="stable")
        part, ends = part[order], np.flatnonzero(np.diff(part[order], append=-1)) + 1
        pairs = np.hstack([_bytes(key[order]), pid[order].view(np.uint8).reshape(-1, 8)])
        return pa.RecordBatch.from_arrays([pa.array(part[ends - 1].astype(np.int32)), _stretches(pairs, ends)], ["part", "pairs"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, keys, pids, held = np.zeros(SENT, np.int64), [], [], 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                units, own = (b"".join(c.slice(k, 256).to_pylist()) for c in b.columns)
                pid, key = np.frombuffer(units, UNIT)["pid"], _numbers(np.frombuffer(own, np.uint8).reshape(-1, KEY)).reshape(-1, bands)
                one, first, times = np.unique(pid, return_index=True, return_counts=True)
                place = one & (SENT - 1)
                old = sent[place] == one
                sent[place] = one
                new, again = first[~old], first[old | (times > 1)]  # a pair that comes again tells of a second place
                keys.append(np.concatenate([key[new].T.ravel(), key[again, 0]]))
                pids.append(np.concatenate([np.tile(pid[new], bands), pid[again]]))
                held += len(pids[-1])
                if held >= HELD:
                    yield dealt(keys, pids)
                    keys, pids, held = [], [], 0
        if held:
            yield dealt(keys, pids)

    def shared(pairs: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(pairs), np.uint8).reshape(-1, KEY + 8)
        key, pid = _numbers(rows[:, :KEY]), np.ascontiguousarray(rows[:, KEY:]).view(np.int64).ravel()
        order = np.lexsort((pid, key))
        key, pid = key[order], pid[order]
        twice = np.concatenate([[False], (key[1:] == key[:-1]) & (pid[1:] == pid[:-1])])
        equal, key, pid = np.unique(pid[twice]), key[~twice], pid[~twice]
        same = key[1:] == key[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, none = np.concatenate([key[some].view(np.int64), equal]), np.arange(some.sum() + len(equal)) >= some.sum()
        return pa.RecordBatch.from_arrays([pa.array(key, mask=none), pa.array(np.concatenate([pid[some], equal]))], ["key", "pid"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield shared(held)
                    held = []
                now = part
                held.append(pairs)
        if held:
            yield shared(held)

    pairs = signed.select("units", "keys").mapInArrow(deal, "part int, pairs binary")
    return written(pairs.repartition("part").sortWithinPartitions("part").mapInArrow(share, "key long, pid long"), "shared-bands")


def _places(signed: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, row, begin, n_words and pid of the paragraphs in shared; banded: some other paragraph has a band of it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                own = part.column(2).to_pylist()
                units = np.frombuffer(b"".join(own), UNIT)
                at = pa.array(np.repeat(np.arange(len(own)), [len(x) // UNIT.itemsize for x in own]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *[pa.array(np.ascontiguousarray(units[c])) for c in UNIT.names]], [*_PLACE, "pid"])

    kind = signed.schema["doc_id"].dataType.simpleString()
    wanted = shared.groupBy("pid").agg(F.max(F.col("key").isNotNull()).alias("banded"))
    places = signed.select("doc_id", "row", "units").mapInArrow(place, f"doc_id {kind}, row long, begin int, n_words int, pid long")
    return written(places.join(wanted, "pid"), "shared-paragraphs")


def _links(places: DataFrame, texts: DataFrame, shared: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): links of similar paragraphs of one band, by exact similarity."""
    first = places.filter("banded").groupBy("pid").agg(F.min(F.struct(*_PLACE)).alias("at")).select("pid", "at.*")
    asked = first.groupBy("doc_id", "row").agg(F.collect_list(F.struct("begin", "n_words", "pid")).alias("asked"))  # at most the paragraphs of one text

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                pids, found = [], []
                for v, places in zip(b.column(0).slice(k, 256).to_pylist(), b.column(1).slice(k, 256).to_pylist(), strict=True):
                    words = v.encode("utf-8", "surrogatepass").split()
                    for x in places:
                        pids.append(x["pid"])
                        found.append(b" ".join(words[x["begin"] : x["begin"] + x["n_words"]]))
                yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(found, pa.binary())], ["pid", "words"])

    held = texts.join(asked, ["doc_id", "row"]).select("text", "asked").mapInArrow(words_of, "pid long, words binary")
    held = written(held.dropDuplicates(["pid"]), "paragraph-words")
    sized = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block / 2)).cast("int").alias("n"))
    # up to half a block: compared whole; more: dealt into blocks, of which each two meet
    dealt = shared.join(sized, "key").withColumn("i", F.pmod(F.xxhash64("pid"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "pid").join(held, "pid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([*rest, batch])
                group = np.stack([c.to_numpy() for c in rows.columns[:3]])
                last = int(np.flatnonzero((group != group[:, -1:]).any(0)).max(initial=-1)) + 1  # the last group may go on in the next batch
                yield _compared(rows.slice(0, last), similarity)
                rest = rows.slice(last).to_batches()
        if rest:
            yield _compared(pa.Table.from_batches(rest), similarity)

    met = met.select("key", "i", "j", "pid", "words").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(compare, "a long, b long")


def _by_group(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The order by group (0 to n - 1), then value; numbers of 16 bits are sorted in linear time."""
    order = np.argsort(value)
    return order[np.argsort((group.astype(np.uint16) if n <= 1 << 16 else group)[order], kind="stable")]


def _compared(rows: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links within the groups (key, i, j) of sorted rows; groups of two, the most, are compared all at once."""
    a, b = [], []
    if rows.num_rows:
        group, pid = np.stack([c.to_numpy() for c in rows.columns[:3]]), rows.column(3).to_numpy()
        words = rows.column(4).to_pylist()
        letters = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        _, starts, stops = _words(letters)
        many = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(w) + 1 for w in words]])))
        own = _shingles(_quick_hashes(letters, starts, stops))
        # the shingles of a paragraph begin at all but its last words; each counts once
        here = many - SHINGLE + 1
        row = np.repeat(np.arange(len(many)), here)
        value = own[np.arange(len(row)) + np.repeat(np.cumsum(many) - many - (np.cumsum(here) - here), here)]
        order = _by_group(row, value, len(many))
        row, value = row[order], value[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
        row, flat = row[once], value[once]
        sizes = np.bincount(row, minlength=len(many))
        ends = np.cumsum(sizes)
        first = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        n = np.diff(np.append(first, rows.num_rows))
        x = first[n == 2]
        both = np.concatenate([x, x + 1])
        if len(x):
            far = np.cumsum(sizes[both])
            at = np.arange(far[-1]) + np.repeat(ends[both] - far, sizes[both])
            pair, value = np.repeat(np.tile(np.arange(len(x)), 2), sizes[both]), flat[at]
            order = _by_group(pair, value, len(x))
            pair, value = pair[order], value[order]
            shared = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(x))
            near = shared >= similarity * (sizes[x] + sizes[x + 1] - shared) - 1e-9
            a += pid[x[near]].tolist()
            b += pid[x[near] + 1].tolist()
        for s, m in zip(first[n > 2].tolist(), n[n > 2].tolist(), strict=True):
            u, v = linked(pid[s : s + m], [flat[e - k : e] for e, k in zip(ends[s : s + m].tolist(), sizes[s : s + m].tolist(), strict=True)], similarity)
            a += u
            b += v
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, least_run: int, block: int) -> DataFrame:
    """Every paragraph of a class of two or more: its place, `head` (the class's first place), kept, and of the others the run that they lie in (run, run_words)."""
    bands, rows = tuned_bands(similarity, PARAGRAPH_RECALL, most_bands=MOST_BANDS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = _signed(texts, bands, rows)
    shared = _shared_bands(signed, bands)
    places, equal = _places(signed, shared), shared.filter("key IS NULL").select("pid").distinct()
    drop_written(signed)
    classes = components(_links(places, texts, shared.filter("key IS NOT NULL"), similarity, block)).select(F.col("id").alias("pid"), F.col("component").alias("root"))
    roots = written(equal.join(classes, "pid", "full").select("pid", F.coalesce("root", "pid").alias("root")), "paragraph-classes")
    members = written(places.join(roots, "pid").select("root", *_PLACE).distinct(), "paragraph-members")
    heads = members.groupBy("root").agg(F.min(F.struct(*_PLACE)).alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    named = members.join(heads, "root").withColumn("kept", F.struct(*_PLACE) == F.col("head"))
    # repeated paragraphs that adjoin or overlap are one run
    gone, end = named.filter("NOT kept"), F.col("begin") + F.col("n_words")
    by_place = Window.partitionBy("doc_id", "row").orderBy("begin", "n_words", "root")
    far = F.col("begin") > F.coalesce(F.max(end).over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gone = gone.withColumn("_new", far.cast("int")).withColumn("run", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    run = Window.partitionBy("doc_id", "row", "run")
    gone = gone.withColumn("run_words", F.max(end).over(run) - F.min("begin").over(run)).filter(F.col("run_words") >= least_run)
    gone = written(gone, "repeated-paragraphs")
    first = named.filter("kept").join(gone.select("root").distinct(), "root", "left_semi").withColumn("run", F.lit(None).cast("long")).withColumn("run_words", F.lit(None).cast("int"))
    return gone.unionByName(first.select(gone.columns))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_run: int = LEAST_RUN, block: int = BLOCK) -> DataFrame:
    """doc_id, begin (word, from 0), n_words, class_doc_id, class_begin, kept: the paragraphs that are equal or similar, directly or through others, to one of a smaller id or place, and (kept) those first ones.

    Repeated paragraphs are reported where their run has least_run words. Rows without an id, and null and empty texts, have no
    paragraphs; rows that share id and text have theirs once, those that share an id only are texts of their own. An empty table gives no rows.
    """
    out = _classes(docs, id_col, text_col, similarity, least_run, block)
    return out.select("doc_id", "begin", "n_words", F.col("head.doc_id").alias("class_doc_id"), F.col("head.begin").alias("class_begin"), "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", similarity: float = SIMILARITY, least_run: int = LEAST_RUN, block: int = BLOCK) -> DataFrame:
    """docs without the runs of repeated paragraphs; documents of which nothing is left go. length_col, where there is one, is counted anew for changed texts.

    Rows without an id stay as they are, and so do null and empty texts. A text may lose words that its first similar paragraph does not have: at most a fifth of the shingles.
    """
    out = _classes(docs, id_col, text_col, similarity, least_run, block).filter("NOT kept")
    runs = written(out.groupBy("doc_id", "row", "run").agg(F.struct(F.min("begin").alias("begin"), F.max("run_words").alias("n_words")).alias("x")), "repeated-runs")
    gone = runs.groupBy(F.col("doc_id").alias("__cut_id"), F.col("row").alias("__cut_row")).agg(F.sort_array(F.collect_list("x")).alias("__cut_runs"))  # at most the runs of one text
    if runs.count() <= MOST_SENT:  # so few runs are sent to the texts; more meet them by shuffle
        gone = F.broadcast(gone)
    joined = docs.join(gone, (F.col(id_col) == F.col("__cut_id")) & (F.xxhash64(F.col(text_col)) == F.col("__cut_row")), "left")

    def left(texts: list[str | None], runs: list[list[dict] | None]) -> list[list]:
        return [[t if t is None or not r else without_runs(t, [(x["begin"], x["n_words"]) for x in r]) for t, r in zip(texts, runs, strict=True)]]

    cut_text = map_columns(joined, [*docs.columns, "__cut_id"], [F.col(text_col), F.col("__cut_runs")], [("__cut_text", "string")], left)
    changed = F.col("__cut_id").isNotNull()
    cut_text = cut_text.filter(~changed | (F.trim(F.translate("__cut_text", "\n\t\r\x0b\x0c", "     ")) != ""))
    made = [F.col("__cut_text").alias(c) if c == text_col else F.when(changed, F.length("__cut_text")).otherwise(F.col(c)).cast(dict(docs.dtypes)[c]).alias(c) if c == length_col else F.col(f"`{c}`") for c in docs.columns]
    return cut_text.select(*made)
