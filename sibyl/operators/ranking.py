"""Searches whose questions go to the tasks: documents are scored where they lie, and only the best of a task, or its sums, are shuffled.

A document is a run of entries (term, impact = tf / sqrt(length)). From texts, these are cut once and written; a kept index gives them by parts of its documents.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stages
from ..functions import text as tx
from .index import PART_DOCS, PostingIndex, by_shard, dealt, opened

#: Words of questions that are sent to the tasks; pairs of an entry and a question, and of a document and a question, that a task works on at once (more only where one document has more).
MOST_ASKED, PAIRS = 200_000, 1 << 21
#: Groups into which an index's part is cut.
GROUPS = 8
#: Scores are rounded to six digits after: what is so near to the last of the best may still be equal to it.
NEAR = 2e-6
#: Places of a document in one order of all places; a document has fewer.
SPACED = 1 << 32

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Asked:
    """Questions' words by term: those of term i are from starts[i] on."""

    def __init__(self, asked: pa.Table, terms: pa.Array, df: np.ndarray, n_docs: int) -> None:
        """asked: qid, term, weight, required (0 or 1)."""
        whose = asked.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
        self.qids, code = whose.dictionary, whose.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(asked.column("term").combine_chunks(), value_set=terms).fill_null(len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)
        required = asked.column("required").fill_null(0).to_numpy().astype(np.int64)
        self.needed = np.bincount(code, required, len(self.qids)).astype(np.int64)
        order = np.argsort(term, kind="stable")
        order = order[: np.searchsorted(term[order], len(terms))]
        self.whose, self.required = code[order], required[order]
        # a term without documents has no entry either
        self.idf = asked.column("weight").fill_null(0.0).to_numpy().astype(float)[order] * np.log1p(n_docs / np.maximum(df, 1))[term[order]]
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables (document, question) of scores and of numbers of words, which are 0 where a required word is missing."""
        nq = len(self.qids)
        m = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(np.arange(len(term)), m)
        at = self.starts[term][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(m) - m, m)
        cell = doc[entry] * nq + self.whose[at]
        score = np.bincount(cell, self.idf[at] * impact[entry], n_docs * nq)
        found = np.bincount(cell, minlength=n_docs * nq)
        if self.needed.any():
            got = np.bincount(cell, self.required[at], n_docs * nq).reshape(n_docs, nq)
            found[(got < self.needed).ravel()] = 0
        return score.reshape(n_docs, nq), found.reshape(n_docs, nq)

    def pieces(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of documents (first, end) and of their entries, which lie in the order of documents, that are worked on at once."""
        pairs = np.bincount(doc, self.starts[term + 1] - self.starts[term], n_docs) + len(self.qids)
        part = np.cumsum(pairs).astype(np.int64) // PAIRS
        edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), n_docs) if n_docs else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield lo, hi, *np.searchsorted(doc, (lo, hi)).tolist()


class _Best:
    """The n best documents of each question so far, by score and key, and those whose scores may come to the same when they are rounded."""

    def __init__(self, n: int, n_questions: int) -> None:
        self.n, self.floor, self.held = n, np.full(n_questions, -np.inf), None

    def add(self, q: np.ndarray, key: pa.Array, score: np.ndarray, found: np.ndarray) -> None:
        able = score >= self.floor[q] - NEAR
        new = [q[able], key.filter(pa.array(able)), score[able], found[able]]
        if self.held is not None:
            new = [pa.concat_arrays([a, b]) if isinstance(b, pa.Array) else np.concatenate([a, b]) for a, b in zip(self.held, new, strict=True)]
        q, key, score, found = new
        if not len(q):
            return
        by_key = pc.rank(key, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((by_key, -score, q))
        q, key, score, found = q[order], key.take(pa.array(order)), score[order], found[order]
        rank = _number(q[1:] != q[:-1])
        last = np.flatnonzero(rank == self.n - 1)
        self.floor[q[last]] = score[last]
        # of documents of one score, as copies of a text are, those of the n first keys can be among the best
        kept = (rank < self.n) | ((score >= self.floor[q] - NEAR) & (_number((q[1:] != q[:-1]) | (score[1:] != score[:-1])) < self.n))
        self.held = [q[kept], key.filter(pa.array(kept)), score[kept], found[kept]]


def _number(new: np.ndarray) -> np.ndarray:
    """Numbers from 0 in each run; new: whether a run begins, of all places but the first."""
    starts = np.flatnonzero(np.concatenate(([True], new)))
    return np.arange(len(new) + 1) - np.repeat(starts, np.diff(np.append(starts, len(new) + 1)))


class Entries:
    """The entries of these terms in documents, and the counts that scores need. None of it is in memory but the terms."""

    def __init__(self, rows: DataFrame, groups: Callable, terms: pa.Array, df: np.ndarray, n_docs: int, key: T.StructField) -> None:
        self.rows, self.groups, self.terms, self.df, self.n_docs, self.key = rows, groups, terms, df, n_docs, key


def from_texts(docs: DataFrame, terms: pa.Array, key: str, text: str | Column) -> Entries | None:
    """Entries of documents, which are cut into words once; None where keys repeat or are null, as documents of one key count together."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = shared.value
        for b in batches:
            texts = pc.split_pattern(pc.if_else(pc.equal(b.column(1), ""), None, b.column(1)), " ")
            sizes = pc.list_value_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = texts.flatten()
            at = pc.index_in(words, value_set=value_set.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.repeat(np.arange(b.num_rows), sizes) * len(value_set) + at
            code, tf = np.unique(code[at >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(code, np.arange(b.num_rows + 1) * len(value_set)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code % max(1, len(value_set)), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), *lists], [key, "len", "terms", "tf"])

    words = docs.select(key, tx.spaced_words(F.lower(F.col(text) if isinstance(text, str) else text)).alias("_t"))
    field = docs.schema[key]
    rows = stages.staged(words.mapInArrow(cut, T.StructType([field, *T.StructType.fromDDL("len int, terms array<int>, tf array<int>").fields])), "entries")
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        return None
    n_terms = len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 1, np.int64)
        for b in batches:
            df[:-1] += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
            df[-1] += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    got = rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            many = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), many)
            term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            yield b.column(0), doc, term.astype(np.int64), tf / np.sqrt(b.column(1).to_numpy(zero_copy_only=False).astype(float))[doc]

    return Entries(rows, groups, terms, df[:-1], int(df[-1]), field)


def from_index(index: PostingIndex, terms: pa.Array) -> Entries:
    """Entries of an index: of its blocks only keys, lengths and numbers of places are shuffled, once, by part."""
    spark = index.spark
    words = spark.createDataFrame(pa.table({"term": terms.cast(pa.string())}))
    got = index.terms().join(words, "term", "left_semi").toArrow()
    df = np.zeros(len(terms), np.int64)
    df[pc.index_in(got.column("term").combine_chunks(), value_set=terms.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)] = got.column("df").to_numpy()
    shared = spark.sparkContext.broadcast(terms)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = b.column(2).flatten()
            term = pc.index_in(b.column(0), value_set=shared.value.cast(b.column(0).type)).to_numpy(zero_copy_only=False).astype(np.int32)
            part = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), many) * GROUPS + _group(keys)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), np.diff(part[order]) != 0)))
            ends = pa.array(np.append(edges, len(part)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(order))) for x in (keys, pa.array(np.repeat(term, many)), b.column(3).flatten(), b.column(4).flatten())]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][edges]), *lists], ["part", "keys", "terms", "lens", "tf"])

    of = lambda f: F.transform("entries", f)
    blocks = index.asked_blocks(words).select("term", "part", of(lambda e: e["key"]).alias("keys"), of(lambda e: e["len"]).alias("lens"), of(lambda e: F.size(e["places"])).alias("tf"))
    packed = blocks.mapInArrow(pack, f"part long, keys array<{index.kind}>, terms array<int>, lens array<int>, tf array<int>")
    tasks = max(1, GROUPS * -(-index.n_docs() // (1 << 16)))
    rows = packed.repartition(tasks, "part").sortWithinPartitions("part")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_: list[pa.RecordBatch] = []
        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)) if len(part) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if open_ and open_[-1].column(0)[0].as_py() != part[lo]:
                    yield _group_entries(open_)
                    open_ = []
                open_.append(b.slice(lo, hi - lo))
        if open_:
            yield _group_entries(open_)

    return Entries(rows, groups, terms, df, index.n_docs(), T.StructType.fromDDL(f"`{index.key}` {index.kind}").fields[0])


def _group(keys: pa.Array, groups: int = GROUPS) -> np.ndarray:
    if pa.types.is_integer(keys.type):
        return keys.to_numpy(zero_copy_only=False).astype(np.int64) % groups
    own = keys.dictionary_encode()
    return np.array([crc32(str(k).encode("utf-8", "surrogatepass")) % groups for k in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy(zero_copy_only=False)]


def _group_entries(rows: list[pa.RecordBatch]) -> tuple:
    """Keys of the documents of a group, and its entries in their order."""
    keys, term, lens, tf = (pa.concat_arrays([b.column(c).flatten() for b in rows]) for c in range(1, 5))
    own = keys.dictionary_encode()
    doc = own.indices.to_numpy(zero_copy_only=False)
    term = term.to_numpy(zero_copy_only=False)
    order = np.lexsort((term, doc))
    impact = tf.to_numpy(zero_copy_only=False) / np.sqrt(lens.to_numpy(zero_copy_only=False).astype(float))
    return own.dictionary, doc[order].astype(np.int64), term[order].astype(np.int64), impact[order]


def phrase_hits(index: PostingIndex, phrases: pa.Array) -> DataFrame:
    """(_phrase, key) of the documents that hold each phrase (words joined by a space): of the index only the entries of their words are shuffled, once, as bytes, by part; there a phrase's words meet."""
    spark, words = index.spark, pc.split_pattern(phrases.cast(pa.string()), " ")
    terms = pc.unique(words.flatten())
    code = pc.index_in(words.flatten(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = index.sizes()
    # parts are those of the largest batch; documents of equal parts of other batches are dealt to more groups
    parts = max(1, -(-max(sizes, default=0) // PART_DOCS))
    groups = GROUPS * max(1, -(-sum(sizes) // (parts * PART_DOCS)))
    shared, key = spark.sparkContext.broadcast((phrases, terms, code, np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))))), index.key

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.index_in(b.column(0), value_set=shared.value[1].cast(b.column(0).type)).to_numpy(zero_copy_only=False).astype(np.int32)
            keys, places = b.column(2).flatten(), b.column(3).flatten()
            part = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) % parts, many) * groups + _group(keys, groups)
            yield dealt(pa.RecordBatch.from_arrays([keys, pa.array(np.repeat(term, many)), places], ["key", "term", "places"]), part)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, terms, code, starts = shared.value
        for _, packets in by_shard(batches):
            keys, at, begin = _places(opened(packets), len(terms))
            n, found, docs = np.diff(begin), [], []
            for i in np.flatnonzero(np.minimum.reduceat(n[code], starts[:-1]) > 0).tolist():
                own = code[starts[i] : starts[i + 1]]
                by = np.argsort(n[own], kind="stable").tolist()  # the word of the fewest places first
                start = at[begin[own[by[0]]] : begin[own[by[0]] + 1]] - by[0]
                for j in by[1:]:
                    other = at[begin[own[j]] : begin[own[j] + 1]]
                    start = start[other[np.minimum(np.searchsorted(other, start + j), len(other) - 1)] == start + j]
                    if not len(start):
                        break
                doc = start // SPACED
                doc = doc[np.concatenate((np.ones(min(1, len(doc)), bool), doc[1:] != doc[:-1]))]
                found.append(np.full(len(doc), i))
                docs.append(doc)
            if found:
                yield pa.RecordBatch.from_arrays([phrases.take(pa.array(np.concatenate(found))), keys.take(pa.array(np.concatenate(docs)))], ["_phrase", key])

    of = lambda name: F.transform("entries", lambda e: e[name]).alias(name)
    asked = index.asked_blocks(spark.createDataFrame(pa.table({"term": terms})))
    sent = asked.select("term", "part", of("key"), of("places")).mapInArrow(pack, "shard int, data binary")
    return sent.repartitionById(parts * groups, "shard").mapInArrow(meet, f"_phrase string, `{key}` {index.kind}")


def _places(entries: pa.RecordBatch, n_terms: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys of the documents, and the places of entries (key, term, places), in order by term; a document's lie SPACED after the last one's. Where each term's begin."""
    own = entries.column(0).dictionary_encode()
    term, tf = entries.column(1).to_numpy(zero_copy_only=False), pc.list_value_length(entries.column(2)).to_numpy(zero_copy_only=False)
    at = np.repeat(own.indices.to_numpy(zero_copy_only=False).astype(np.int64), tf) * SPACED + entries.column(2).flatten().to_numpy(zero_copy_only=False)
    term = np.repeat(term, tf)
    order = np.lexsort((at, term))
    return own.dictionary, at[order], np.searchsorted(term[order], np.arange(n_terms + 1))


def few(rows: DataFrame, most: int) -> pa.Table | None:
    """The rows, if they are `most` or fewer."""
    got = rows.limit(most + 1).toArrow()
    return got if got.num_rows <= most else None


def scored(asked: pa.Table, entries: Entries, qid: T.StructField, n: int | None) -> DataFrame:
    """(qid, key, score, n_terms) of the documents with a question's words; with n, those of each task that can be among the n best."""
    shared, name = entries.rows.sparkSession.sparkContext.broadcast(Asked(asked, entries.terms, entries.df, entries.n_docs)), entries.key.name
    groups = entries.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        best = None if n is None else _Best(n, len(a.qids))
        made = lambda q, key, score, found: pa.RecordBatch.from_arrays([a.qids.take(pa.array(q)), key, pa.array(score), pa.array(found)], ["qid", name, "score", "n_terms"])
        for keys, doc, term, impact in groups(batches):
            for lo, hi, begin, end in a.pieces(doc, term, len(keys)):
                score, found = a.scores(doc[begin:end] - lo, term[begin:end], impact[begin:end], hi - lo)
                able = found > 0 if best is None else (found > 0) & (score >= best.floor - NEAR)
                d, q = np.nonzero(able)
                rows = q, keys.take(pa.array(d + lo)), score[d, q], found[d, q]
                if best is None:
                    yield made(*rows)
                else:
                    best.add(*rows)
        if best is not None and best.held is not None:
            yield made(*best.held)

    out = T.StructType([T.StructField("qid", qid.dataType), T.StructField(name, entries.key.dataType), *T.StructType.fromDDL("score double, n_terms long").fields])
    return entries.rows.mapInArrow(run, out)


def counted(answers: pa.Table, asked: pa.Table, entries: Entries) -> DataFrame:
    """For each answer (its place in answers: qid, term): documents with it (n), those that have the question's words too (n_scored), and the best score of these (best, null if none). A row for each task with one."""
    spark = entries.rows.sparkSession
    model = Asked(asked, entries.terms, entries.df, entries.n_docs)
    term = pc.index_in(answers.column("term").combine_chunks(), value_set=entries.terms).to_numpy(zero_copy_only=False).astype(np.int64)
    whose = pc.index_in(answers.column("qid").combine_chunks(), value_set=model.qids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.argsort(term, kind="stable")
    shared, groups = spark.sparkContext.broadcast((model, by, whose[by], np.searchsorted(term[by], np.arange(len(entries.terms) + 1)))), entries.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, place, whose, starts = shared.value
        n, n_scored, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.full(len(place), -np.inf)
        for keys, doc, term, impact in groups(batches):
            for lo, hi, begin, end in a.pieces(doc, term, len(keys)):
                d, t = doc[begin:end] - lo, term[begin:end]
                score, found = a.scores(d, t, impact[begin:end], hi - lo)
                m = starts[t + 1] - starts[t]
                entry = np.repeat(np.arange(len(t)), m)
                at = starts[t][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(m) - m, m)
                n += np.bincount(at, minlength=len(place))
                at, d = at[whose[at] >= 0], d[entry][whose[at] >= 0]
                full = found[d, whose[at]] > 0
                at, d = at[full], d[full]
                n_scored += np.bincount(at, minlength=len(place))
                np.maximum.at(best, at, score[d, whose[at]])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(n[some]), pa.array(n_scored[some]), pa.array(best[some], mask=n_scored[some] == 0)], ["place", "n", "n_scored", "best"])

    return entries.rows.mapInArrow(run, "place long, n long, n_scored long, best double")
