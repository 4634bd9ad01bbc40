"""A sequence tagger: a linear-chain conditional random field over hashed features.

Training sums the gradient over the partitions of a table of sequences: tasks send blocks of partial sums, tasks of the next step add
up the blocks as they come in, and the driver gets one vector, whatever the number of tasks. It then takes a limited-memory
quasi-Newton step. Probabilities come from forward-backward sums, exact for a sequence of any length: sequences are cut into blocks, of which
all make their transfer matrices at once; these are joined along each sequence, and the blocks filled in.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stages

#: Positions of a block of the chain, numbers of a block of the gradient, and words that a task tags at once.
CHAIN, SLICE, TOKENS = 64, 1 << 15, 1 << 18

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bucket(feature: str, buckets: int) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % buckets


@dataclass
class Tagger:
    """Weights of each feature bucket for each label, of the moves between labels, and of the first label."""

    labels: tuple[str, ...]
    buckets: int
    weights: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        k = len(self.labels)
        self.weights = np.zeros(self.buckets * k + k * k + k) if self.weights is None else self.weights

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, n = len(self.labels), self.buckets * len(self.labels)
        return self.weights[:n].reshape(self.buckets, k), self.weights[n : n + k * k].reshape(k, k), self.weights[n + k * k :]


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: start, length, number within its sequence, and sequence of each block."""
    n = -(-sizes // CHAIN)
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + k * CHAIN
    return at, np.minimum(CHAIN, np.repeat(sizes, n) - k * CHAIN), k, owner


@dataclass
class Chain:
    """Forward and backward messages of a batch of sequences, each normalised at its position."""

    forward: np.ndarray
    backward: np.ndarray
    emitted: np.ndarray
    move: np.ndarray
    first_at: np.ndarray
    log_z: float

    def marginals(self) -> np.ndarray:
        p = self.forward * self.backward
        return p / (p @ np.ones(p.shape[1]))[:, None]

    def moves(self) -> np.ndarray:
        """Expected number of each move."""
        inner = np.ones(len(self.forward), bool)
        inner[self.first_at] = False
        to = np.flatnonzero(inner)
        a, b = self.forward[to - 1], self.emitted[to] * self.backward[to]
        return self.move * ((a / ((a @ self.move) * b).sum(1, keepdims=True)).T @ b)


def chain(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray) -> Chain:
    """scores: a row of label scores for each position of non-empty sequences that are laid end to end."""
    k = scores.shape[1]
    top = scores.max(1)
    e, m = np.exp(scores - top[:, None]), np.exp(moves)
    first_at = np.cumsum(sizes) - sizes
    at, length, number, owner = _blocks(sizes)
    order = np.argsort(-length, kind="stable")  # at each step the blocks that still go on are a prefix
    at, length, number, owner = at[order], length[order], number[order], owner[order]
    reach = [int(np.searchsorted(-length, -j, side="left")) for j in range(CHAIN + 1)]  # blocks of more than j positions
    steps = int(length[0])
    starts = np.zeros((len(at), k))  # the message that enters each block; of a first block the weights of the first label
    ends = np.ones((len(at), k))
    head = number == 0
    starts[head] = np.exp(first)
    n_blocks = int(number.max()) + 1
    if n_blocks > 1:
        through = np.tile(np.eye(k), (len(at), 1, 1))
        for j in range(steps):
            n = reach[j]
            moved = (through[:n].reshape(-1, k) @ m).reshape(n, k, k)
            if j == 0:
                moved[head[:n]] = through[:n][head[:n]]
            moved *= e[at[:n] + j][:, None, :]
            through[:n] = moved / moved.max((1, 2), keepdims=True)
        place = np.full((n_blocks, len(sizes)), -1)
        place[number, owner] = np.arange(len(at))
        for i in range(1, n_blocks):
            now = place[i][place[i] >= 0]
            before = place[i - 1][owner[now]]
            out = np.einsum("bi,bij->bj", starts[before], through[before])
            starts[now] = out / out.sum(1, keepdims=True)
        for i in range(n_blocks - 1, 0, -1):
            now = place[i][place[i] >= 0]
            out = np.einsum("bij,bj->bi", through[now], ends[now])
            ends[place[i - 1][owner[now]]] = out / out.sum(1, keepdims=True)
    forward, backward, scale = np.empty_like(e), np.empty_like(e), np.empty(len(e))
    message, ones = starts.copy(), np.ones(k)
    for j in range(steps):
        n = reach[j]
        x = message[:n] @ m
        if j == 0:
            x[head[:n]] = message[:n][head[:n]]
        x *= e[at[:n] + j]
        s = x @ ones
        message[:n] = x / s[:, None]
        forward[at[:n] + j], scale[at[:n] + j] = message[:n], s
    message = ends
    for j in range(steps - 1, -1, -1):
        n = reach[j]
        backward[at[:n] + j] = message[:n]
        x = (e[at[:n] + j] * message[:n]) @ m.T
        message[:n] = x / (x @ ones)[:, None]
    return Chain(forward, backward, e, m, first_at, float(np.log(scale).sum() + top.sum()))


def best_path(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of the most probable path of one sequence."""
    return best_paths(scores, np.array([len(scores)]), moves, first)


def best_paths(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of the most probable path of each of some non-empty sequences that are laid end to end; all make their steps together."""
    order = np.argsort(-sizes, kind="stable")  # at each step the sequences that still go on are a prefix
    at, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    reach = np.searchsorted(-size, -np.arange(size[0] + 1), side="left").tolist()  # sequences of more than t positions
    back = np.zeros(scores.shape, np.int64)
    now = first + scores[at]
    for t in range(1, int(size[0])):
        n = reach[t]
        through = now[:n, :, None] + moves
        back[at[:n] + t] = through.argmax(1)
        now[:n] = through.max(1) + scores[at[:n] + t]
    out, label = np.empty(len(scores), np.int64), now.argmax(1)
    for t in range(int(size[0]) - 1, 0, -1):
        n = reach[t]
        out[at[:n] + t] = label[:n]
        label[:n] = back[at[:n] + t, label[:n]]
    out[at] = label
    return out


def summed(weights: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the rows of weights, `counts` of them for each position; none: 0."""
    out = np.zeros((len(counts), weights.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(weights[ids], (np.cumsum(counts) - counts)[some])
    return out


def minimised(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8, close: float = 1e-4) -> np.ndarray:
    """A limited-memory quasi-Newton descent: at most `rounds` steps, fewer where the cost falls by less than the share `close`."""
    value, slope = cost(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, down = 1.0, -(slope @ q)
        while True:
            new_value, new_slope = cost(x - step * q)
            if new_value <= value + 1e-4 * step * down or step < 1e-6:
                break
            step /= 2
        if new_value >= value:
            break
        s, y = -step * q, new_slope - slope
        if s @ y > 1e-10:
            pairs = [*pairs[1 - memory :], (s, y)]
        x, fall, value, slope = x - step * q, value - new_value, new_value, new_slope
        if fall < close * abs(value):
            break
    return x


def encoded(tokens: DataFrame, keys: Sequence[str], buckets: int, features: str = "features", order: str = "i", tag: str | None = None) -> DataFrame:
    """A row for each sequence of tokens (keys, order, array of features, tag): its hashed features and tags in order. Repeated features of a token count once."""
    # the same bucket as bucket(): crc32 of the feature
    ids = F.transform(F.array_distinct(F.coalesce(F.col(features), F.array().cast("array<string>"))), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))
    made = [F.col(order).alias("i"), ids.alias("ids"), *([F.col(tag).alias("tag")] if tag else [])]
    out = tokens.select(*keys, F.struct(*made).alias("_x")).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    return out.select(*keys, F.transform("_x", lambda x: x["i"]).alias("places"), F.transform("_x", lambda x: x["ids"]).alias("ids"), *([F.transform("_x", lambda x: x["tag"]).alias("tags")] if tag else []))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists of lists of numbers: positions of each row, numbers of each position, and all numbers."""
    inner = column.flatten()
    return np.diff(column.offsets.to_numpy()), np.diff(inner.offsets.to_numpy()), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def train(sequences: DataFrame, labels: Sequence[str], buckets: int = 1 << 16, rounds: int = 60, decay: float = 1.0, tasks: int | None = None) -> Tagger:
    """A tagger that maximises the likelihood of the tags of encoded sequences (ids, tags), less decay / 2 times the squared weights.

    Sequences are read from a written table in each round. Empty ones and those with a tag that is none of the labels say nothing. No sequence: all weights are 0.
    """
    spark = sequences.sparkSession
    labels = tuple(labels)
    k, known = len(labels), {x: i for i, x in enumerate(labels)}
    usable = sequences.select("ids", "tags").filter((F.size("ids") > 0) & F.forall("tags", lambda t: F.coalesce(t.isin(list(labels)), F.lit(False))))
    data = stages.staged(usable.repartition(tasks) if tasks else usable, "sequences")
    n_blocks = -(-(buckets * k + k * k + k) // SLICE)

    def gradient(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tagger = Tagger(labels, buckets, shared.value)
            emit, moves, first = tagger.parts
            total, cost = np.zeros_like(tagger.weights), 0.0
            g_emit, g_moves, g_first = Tagger(labels, buckets, total).parts
            for b in batches:
                if not b.num_rows:
                    continue
                sizes, counts, ids = _flat(b.column(0))
                tags = np.array([known[t] for t in b.column(1).flatten().to_pylist()])
                scores = summed(emit, ids, counts)
                c = chain(scores, sizes, moves, first)
                inner = np.ones(len(tags), bool)
                inner[c.first_at] = False
                to = np.flatnonzero(inner)
                cost += c.log_z - scores[np.arange(len(tags)), tags].sum() - moves[tags[to - 1], tags[to]].sum() - first[tags[c.first_at]].sum()
                left = c.marginals()
                g_first += left[c.first_at].sum(0) - np.bincount(tags[c.first_at], minlength=k)
                g_moves += c.moves() - np.bincount(tags[to - 1] * k + tags[to], minlength=k * k).reshape(k, k)
                left[np.arange(len(tags)), tags] -= 1
                spread = np.repeat(np.arange(len(tags)), counts)
                for j in range(k):
                    g_emit[:, j] += np.bincount(ids, left[spread, j], buckets)
            parts = [total[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(n_blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(n_blocks), -1], pa.int32()), pa.array([*parts, np.float64(cost).tobytes()], pa.binary())], ["block", "data"])

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data)
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "data"])

    def cost(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(weights)
        got = {r.block: np.frombuffer(r.data) for r in data.mapInArrow(gradient(shared), "block int, data binary").repartition("block").mapInArrow(add, "block int, data binary").collect()}
        shared.destroy()
        slope = np.concatenate([got[i] for i in range(n_blocks)]) if got else np.zeros_like(weights)
        return (float(got[-1][0]) if got else 0.0) + decay / 2 * float(weights @ weights), slope + decay * weights

    if not k:
        return Tagger(labels, buckets)
    return Tagger(labels, buckets, minimised(cost, np.zeros(buckets * k + k * k + k), rounds))


def tag(sequences: DataFrame, tagger: Tagger, keys: Sequence[str]) -> DataFrame:
    """keys, i, tag, prob: the most probable tags of encoded sequences, and the probability of each tag at its place. An empty sequence has no row."""
    model = sequences.sparkSession.sparkContext.broadcast(tagger)
    kinds = dict(sequences.dtypes)
    names = list(tagger.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, moves, first = model.value.parts
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                sizes, counts, ids = _flat(part.column(part.num_columns - 1))
                rows = np.repeat(np.arange(part.num_rows), sizes)
                scores = summed(emit, ids, counts)
                full = sizes[sizes > 0]
                if not len(full):
                    continue
                p = chain(scores, full, moves, first).marginals()
                path = best_paths(scores, full, moves, first)
                columns = [part.column(c).take(pa.array(rows)) for c in range(part.num_columns - 2)]
                places = part.column(part.num_columns - 2).flatten()
                yield pa.RecordBatch.from_arrays([*columns, places, pa.array([names[x] for x in path]), pa.array(p[np.arange(len(path)), path])], [*keys, "i", "tag", "prob"])

    place = kinds["places"].removeprefix("array<").removesuffix(">")
    return sequences.filter(F.size("ids") > 0).select(*keys, "places", "ids").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", i {place}, tag string, prob double")


def context_ids(values: Sequence[bytes], codes: np.ndarray, sizes: np.ndarray, column: str, buckets: int, reach: int = 1) -> np.ndarray:
    """A row of buckets for each position of sequences that are laid end to end: those of what `candidates.context_features` makes of a column, in its order. codes are places in values."""
    pos, size = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    names, places, at, out = [*values, b"#"], list(range(-reach, reach + 1)), {}, []
    for d in places:
        inside = np.flatnonzero((pos + d >= 0) & (pos + d < size))
        at[d] = np.full(len(codes), len(values))
        at[d][inside] = codes[inside + d]
    for n in (1, 2, 3):
        for g in zip(*[places[j:] for j in range(n)], strict=False):
            code = at[g[0]]
            for d in g[1:]:
                code = code * len(names) + at[d]
            own, where = np.unique(code, return_inverse=True)  # each run of values is hashed once
            start = crc32(f"{column}[{g[0]}]=".encode() if n == 1 else f"{column}[{g[0]}..{g[-1]}]=".encode())
            parts = np.stack([own // len(names) ** (n - 1 - j) % len(names) for j in range(n)], 1).tolist()
            out.append(np.array([crc32(b"|".join([names[x] for x in p]), start) % buckets for p in parts], np.int64)[where])
    return np.stack(out, 1)


def mentions(texts: DataFrame, tagger: Tagger, key: str, sentences: str, featured: Callable[[pa.Array, np.ndarray], np.ndarray]) -> DataFrame:
    """key, sent, begin, end, text, score: what `bio_chunks` makes of the words' most probable tags, in one pass over the texts, of which nothing is shuffled.

    sentences: a column of arrays of sentences, words with one blank between; words hold no point or comma. featured: of words and the numbers of words of each
    sentence, a row of as many feature buckets for each word. Tasks take about TOKENS words at once (more only where one sentence has more).
    """
    field = texts.schema[key]
    labels, buckets = tagger.labels, tagger.buckets
    shared = texts.sparkSession.sparkContext.broadcast(tagger.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, moves, first = Tagger(labels, buckets, shared.value).parts
        for b in batches:
            held = pc.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), held)
            sent = np.arange(len(doc)) - np.repeat(np.cumsum(held) - held, held)
            lines = b.column(1).flatten()
            some = np.flatnonzero(pc.not_equal(lines, "").fill_null(False).to_numpy(zero_copy_only=False))
            if not len(some):
                continue
            doc, sent, lines = doc[some], sent[some], lines.take(pa.array(some))
            part = np.cumsum(pc.count_substring(lines, " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1) // TOKENS
            edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                split = pc.split_pattern(lines.slice(lo, hi - lo), " ")
                sizes, words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), split.flatten()
                ids = featured(words, sizes)
                scores = summed(emit, ids.ravel(), np.full(len(ids), ids.shape[1]))
                path = best_paths(scores, sizes, moves, first)
                own = np.array(labels)[path]
                inside = own != "O"
                if not inside.any():
                    continue
                prob = chain(scores, sizes, moves, first).marginals()[np.arange(len(path)), path]
                heads = np.cumsum(sizes) - sizes
                before = np.concatenate(([False], inside[:-1]))
                before[heads] = False
                start = np.flatnonzero(inside & ((own == "B") | ~before))
                # a run ends before the next one, or where the tag is O or the sentence ends
                ends = np.zeros(len(path), bool)
                ends[start] = True
                ends[heads] = True
                stops = np.append(np.flatnonzero(ends | ~inside), len(path))
                stop = stops[np.searchsorted(stops, start, side="right")]
                line = np.searchsorted(heads, start, side="right") - 1
                text = [" ".join(words.slice(x, y - x).to_pylist()) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                score = [float(prob[x:y].sum() / (y - x)) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                whole = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc[lo + line])), whole(sent[lo + line]), whole(start - heads[line]), whole(stop - 1 - heads[line]), pa.array(text, pa.string()), pa.array(score, pa.float64())],
                    [key, "sent", "begin", "end", "text", "score"],
                )

    out = T.StructType([T.StructField(key, field.dataType), *T.StructType.fromDDL("sent int, begin int, `end` int, text string, score double").fields])
    return texts.select(key, sentences).mapInArrow(run, out)


def gold_tags(tokens: DataFrame, mentions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tokens (keys, i) with the tag that labelled mentions (keys, begin, end: first and last token) give: B, I, or O outside all; where mentions overlap, a B wins."""
    marks = mentions.select(*keys, F.explode(F.sequence("begin", "end")).alias("i"), F.col("begin").alias("_b")).groupBy(*keys, "i").agg(F.max((F.col("i") == F.col("_b")).cast("int")).alias("_first"))
    return tokens.join(marks, [*keys, "i"], "left").withColumn("tag", F.when(F.col("_first") == 1, "B").when(F.col("_first") == 0, "I").otherwise("O")).drop("_first")
