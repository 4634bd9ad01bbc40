"""Packing documents into sequences of a fixed number of tokens by a grouping genetic algorithm.

A document longer than a sequence is cut; its full pieces are sequences already. What is left is dealt into cells of a few
thousand pieces, and each cell is packed by populations on several islands. Crossover takes the best-filled bins of one
parent whole, drops the other parent's bins that share a piece with them, and puts the displaced pieces back by best fit.
Between rounds the islands' elites migrate to the next island; the best solution of a cell becomes its sequences.
"""

from __future__ import annotations

import base64
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, spread, written

#: Pieces of a cell on average, islands of a cell, rounds, and what one island does in a round.
CELL, ISLANDS, ROUNDS, POPULATION, CHILDREN, ELITES = 2000, 2, 2, 6, 14, 2


class Encoder:
    """Token ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

    A text is encoded whole, in one call: so many words are new to a task that looking them up one by one costs more.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]) -> None:
        self.ranks_path, self.pattern, self.special, self._bpe = ranks_path, pattern, special, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_bpe": None}

    def ids(self, text: str) -> bytes:
        if self._bpe is None:
            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._bpe = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=self.special)
        return self._bpe.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """Encoder for a public vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def pieces(docs: DataFrame, encoder: Encoder, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut into pieces of `limit`; a longer document's first piece may be shorter. A null text is empty: one piece, the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(texts: list[str | None]) -> list[list]:
        lengths, crcs = [], []
        for t in texts:
            ids = encoder.ids(t or "") + end
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % limit + 1, n + 1, limit)]
            lengths.append([b - a for a, b in zip(cuts, cuts[1:], strict=False)])
            crcs.append([crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        return [lengths, crcs]

    rows = map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), ["doc_id"], [F.col("_text")], [("lengths", "array<long>"), ("crcs", "array<long>")], cut)
    rows = rows.select("doc_id", "lengths", F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "p"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.element_at("lengths", 1) + (F.col("piece") - 1) * limit)
    return rows.select("doc_id", "piece", start.cast("long").alias("start"), F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"))


class _Bins:
    """Bins by the room that is left, with a bit for each room that some bin has."""

    def __init__(self, limit: int) -> None:
        self.limit, self.items, self.room, self.by_room, self.bits = limit, [], [], [[] for _ in range(limit + 1)], 0

    def add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.items))
        self.bits |= 1 << room
        self.items.append(items)
        self.room.append(room)

    def best_fit(self, item: int, size: int) -> None:
        """Puts an item into the fullest bin that has room for it, or a new bin."""
        fitting = self.bits >> size
        if not fitting:
            self.add([item], self.limit - size)
            return
        room = size + (fitting & -fitting).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.bits &= ~(1 << room)
        self.items[at].append(item)
        self.room[at] = room - size
        self.by_room[room - size].append(at)
        self.bits |= 1 << (room - size)

    def worth(self) -> tuple[int, int]:
        """Fewer bins, then more uneven ones, are better."""
        return len(self.items), -sum((self.limit - r) ** 2 for r in self.room)


def _from_assignment(assignment: list[int], sizes: list[int], limit: int) -> _Bins:
    held: dict[int, list[int]] = {}
    for item, b in enumerate(assignment):
        held.setdefault(b, []).append(item)
    bins = _Bins(limit)
    for items in held.values():
        bins.add(items, limit - sum(sizes[i] for i in items))
    return bins


def _assignment(bins: _Bins, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins.items):
        for i in items:
            out[i] = b
    return out


def _crossover(giver: _Bins, taker: _Bins, sizes: list[int], rng: np.random.Generator) -> _Bins:
    """The giver's best-filled bins, the taker's bins that share nothing with them, and the rest by best fit."""
    order = sorted(range(len(giver.items)), key=giver.room.__getitem__)
    share = order[: max(1, int(len(order) * rng.uniform(0.2, 0.8)))]
    child, taken, displaced = _Bins(giver.limit), bytearray(len(sizes)), []
    for b in share:
        child.add(list(giver.items[b]), giver.room[b])
        for i in giver.items[b]:
            taken[i] = 1
    worst = set(sorted(range(len(taker.items)), key=taker.room.__getitem__)[int(len(taker.items) * rng.uniform(0.85, 1)) :])  # mutation: the emptiest bins are dissolved
    for b, items in enumerate(taker.items):
        if b in worst or any(taken[i] for i in items):
            displaced += [i for i in items if not taken[i]]
        else:
            child.add(list(items), taker.room[b])
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        child.best_fit(i, sizes[i])
    return child


def evolve(sizes: list[int], immigrants: list[list[int]], seed: int, limit: int) -> list[list[int]]:
    """The elites of one island after a round, as bins of the items; sizes are in falling order."""
    rng = np.random.default_rng(seed)
    population = [_from_assignment(a, sizes, limit) for a in immigrants]
    while len(population) < POPULATION:
        # best fit in falling order, on all but the first with sizes blurred
        blur = np.array(sizes) * rng.uniform(1 - 0.08 * bool(population), 1, len(sizes))
        bins = _Bins(limit)
        for i in np.argsort(-blur, kind="stable").tolist():
            bins.best_fit(i, sizes[i])
        population.append(bins)
    least = -(-sum(sizes) // limit)
    for _ in range(CHILDREN):
        population.sort(key=_Bins.worth)
        if len(population[0].items) == least:
            break
        a, b = sorted(rng.choice(len(population), 2, replace=False))
        child = _crossover(population[a], population[b], sizes, rng)
        if child.worth() < population[-1].worth():
            population[-1] = child
    return [_assignment(p, len(sizes)) for p in sorted(population, key=_Bins.worth)[:ELITES]]


def pack(rows: DataFrame, limit: int = 1024, seed: int = 23) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Sequences hold at most `limit` tokens and have no gaps."""
    rows = written(rows, "pieces")
    full = rows.filter(F.col("length") >= limit).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.filter(F.col("length") < limit)
    cells = max(1, -(-short.count() // CELL))
    item = F.struct((-F.col("length")).alias("size"), "doc_id", "piece", "start", "length", "ids_crc32")
    # a cell is a bounded group: the hash deals CELL rows to it on average
    held = short.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(cells)).cast("int").alias("cell")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    held = written(held, "cells")
    sizes = F.transform("items", lambda x: x["length"])
    state = held.select("cell", F.lit(None).cast("array<struct<island: int, elites: array<array<int>>>>").alias("elites"))
    for step in range(ROUNDS):

        def island(cell: list, at: list, lengths: list, known: list, step: int = step) -> list[list]:
            out = []
            for c, i, s, e in zip(cell, at, lengths, known, strict=True):
                by = {x["island"]: x["elites"] for x in e or []}
                settlers = [*by.get(i, []), *by.get((i - 1) % ISLANDS, [])[:1]]
                out.append(evolve(s, settlers, hash((seed, c, i, step)) % 2**32, limit))
            return [out]

        joined = held.select("cell", sizes.alias("sizes")).join(state, "cell").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
        # an island is a row of its own work: as many tasks as the cluster runs, several times over
        tasks = min(cells * ISLANDS, 8 * spread(rows.sparkSession))
        grown = map_columns(joined.repartition(tasks, "cell", "island"), ["cell", "island"], [F.col("cell"), F.col("island"), F.col("sizes"), F.col("elites")], [("best", "array<array<int>>")], island, rows=1)
        state = written(grown.groupBy("cell").agg(F.collect_list(F.struct("island", F.col("best").alias("elites"))).alias("elites")), "islands")

    def place(lengths: list, islands: list) -> list[list]:
        bins, offsets = [], []
        for s, e in zip(lengths, islands, strict=True):
            best = min((a for x in sorted(e, key=lambda x: x["island"]) for a in x["elites"]), key=lambda a: max(a, default=-1))
            used: dict[int, int] = {}
            offset = []
            for n, b in zip(s, best, strict=True):
                offset.append(used.get(b, 0))
                used[b] = offset[-1] + n
            bins.append(best)
            offsets.append(offset)
        return [bins, offsets]

    placed = map_columns(held.join(state, "cell"), ["cell", "items"], [sizes, F.col("elites")], [("bins", "array<int>"), ("offsets", "array<long>")], place, rows=8)
    each = placed.select("cell", F.explode(F.arrays_zip("items", "bins", "offsets")).alias("x"))
    packed = each.select(*[F.col(f"x.items.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], (F.col("cell").cast("long") * (1 << 32) + F.col("x.bins")).alias("sequence_id"), F.col("x.offsets").alias("offset"))
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, encoder: Encoder, limit: int = 1024, end_id: int = 2, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of every document. Rows that share an id are documents of their own; null ids are kept; an empty table gives no rows."""
    return pack(pieces(docs, encoder, limit, end_id, **columns), limit)
