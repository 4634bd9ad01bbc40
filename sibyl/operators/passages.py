"""Passages: sentences that clues match, their scores, and the best of each document."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: Clues that are sent to the tasks; and pairs of a sentence's word and a clue that a task works on at once (more only where one document has more).
MOST_CLUES, PAIRS = 200_000, 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent, sentence) of each sentence with a character in it; sent counts empty ones too."""
    return docs.select(key, F.posexplode(tx.sentences(F.col(text))).alias("sent", "sentence")).filter(F.col("sentence") != "")


def word_matches(passages: DataFrame, clues: DataFrame, text: str = "sentence") -> DataFrame:
    """Passages joined with the clues (qid, label, weight) whose single-word label they hold: an equi-join on the word, so that no passage meets a clue it can't match."""
    words = passages.withColumn("label", F.explode(F.array_distinct(tx.tokens(F.col(text)))))
    return words.join(clues, "label")


def pattern_matches(passages: DataFrame, clues: DataFrame, text: str = "sentence") -> DataFrame:
    """Passages of a question (column qid) joined with its clues whose pattern they match: word suffixes are allowed, phrases too."""
    joined = passages.join(clues.withColumn("_pattern", tx.clue_pattern(F.col("label"))), "qid")
    return joined.filter(F.regexp_like(F.col(text), F.col("_pattern"))).drop("_pattern")


def clue_matches(passages: DataFrame, clues: DataFrame, text: str = "sentence") -> DataFrame:
    """Every place (begin, end, in characters) at which a passage of a question matches the pattern of one of its clues, with the clue's label and weight."""
    joined = passages.join(clues.select("qid", "label", "weight", tx.clue_pattern(F.col("label"), anywhere=False).alias("_pattern")), "qid")
    hits = joined.withColumn("_hit", F.regexp_extract_all(F.col(text), F.col("_pattern"), F.lit(0))).filter(F.size("_hit") > 0)
    # between two matches lies a part of the text: a match begins after the parts and matches before it
    between = hits.withColumn("_part", F.split(F.col(text), F.col("_pattern"), -1))
    before = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda a, j: a + F.length(F.get("_part", j)) + F.when(j < i, F.length(F.get("_hit", j))).otherwise(0))
    places = F.transform("_hit", lambda h, i: F.struct(before(i).alias("begin"), (before(i) + F.length(h)).alias("end")))
    return between.select(*passages.columns, "label", "weight", F.explode(places).alias("_at")).select(*passages.columns, "label", "weight", "_at.begin", "_at.end")


def type_matches(tokens: DataFrame, lats: DataFrame, keys: list[str]) -> DataFrame:
    """The token of each passage that names the question's answer type most specifically (i, lat_text, specificity); ties: the first. tokens: keys with qid, i, lemma."""
    hits = tokens.join(lats.select("qid", F.col("text").alias("lemma"), "specificity"), ["qid", "lemma"])
    return hits.groupBy(*keys).agg(F.max(F.struct("specificity", (-F.col("i")).alias("_i"), "lemma")).alias("x")).select(*keys, (-F.col("x._i")).alias("i"), F.col("x.lemma").alias("lat_text"), "x.specificity")


def title_passages(clues: DataFrame, docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """First sentences of the n documents whose titles clues match best; no clue is required."""
    from .retrieval import QuerySettings, search

    asked = clues.select("qid", F.col("label").alias("term"), "weight", F.lit(False).alias("required"))
    found = search(asked, docs, QuerySettings(fields=("title",), all_required=False), n, key)
    return first_sentences(found, docs, clues, key)


def about_clues(titles: DataFrame, clues: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key, label) of clues that match a document's title: the document is about them."""
    words = titles.select(key, F.explode(F.array_distinct(tx.tokens(F.col("title")))).alias("label"))
    return words.join(clues, "label").select("qid", key, "label").distinct()


def vectors(matches: DataFrame, about: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each question and passage: sums of matches and weights, apart for clues that the document is about."""
    marked = matches.join(about.withColumn("_about", F.lit(1)), ["qid", key, "label"], "left").withColumn("_about", F.coalesce("_about", F.lit(0)))
    own, of = F.col("_about") == 0, F.col("_about") == 1
    return marked.groupBy("qid", key, "sent").agg(*_sums(own, of))


def dealt(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs dealt to tasks by their key, so that groups and windows of a document, and joins on its key, need no other shuffle, whatever the number of questions.

    A document gives many rows for each question, so there are more tasks than shuffles of small rows have.
    """
    return docs.repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def dealt_vectors(docs: DataFrame, clues: DataFrame, key: str = "doc_id") -> DataFrame:
    """What `vectors` says of every sentence of documents (key, title, text; keys are unique), of which only the texts are shuffled, once."""
    cut = dealt(docs.select(key, "title", "text"), key).select(key, tx.tokens(F.col("title")).alias("_t"), F.posexplode(tx.sentences(F.col("text"))).alias("sent", "sentence"))
    words = cut.select(key, "sent", "_t", F.explode(F.array_distinct(tx.tokens(F.col("sentence")))).alias("label"))
    marked = words.select(key, "sent", "label", (F.array_contains("_t", F.col("label")) & F.col(key).isNotNull()).alias("_about"))
    own, of = ~F.col("_about"), F.col("_about")
    return marked.join(clues.select("qid", "label", "weight"), "label").groupBy("qid", key, "sent").agg(*_sums(own, of))


def _sums(own: Column, of: Column) -> list[Column]:
    return [
        F.count_if(own).cast("double").alias("clueMatch"), F.sum(F.when(own, F.col("weight")).otherwise(0.0)).alias("clueWeight"),
        F.count_if(of).cast("double").alias("aboutClueMatch"), F.sum(F.when(of, F.col("weight")).otherwise(0.0)).alias("aboutClueWeight"),
    ]


def scored(docs: DataFrame, clues: DataFrame, k: int | None = None, each: Callable[[Column], Column] | None = None, key: str = "doc_id", most: int = MOST_CLUES) -> DataFrame:
    """The k best sentences (all, if None) of each document (key, title, text; keys are unique) for each question, with what `vectors` says of them, score and rank.

    each: a function of a sentence whose value is wanted too, as column `each`. Up to `most` clues go to the tasks, which take documents as they come, so that nothing
    is shuffled; more are joined by word. Both ways give the same rows.
    """
    own = clues.select("qid", "label", F.col("weight").cast("double").alias("weight")).filter("label IS NOT NULL")
    few = own.limit(most + 1).toArrow()
    if few.num_rows > most:
        out = best(dealt_vectors(docs, clues, key).withColumn("score", score()), k, key)
        return out if each is None else with_sentences(out, docs, each, "each", key)
    shared = docs.sparkSession.sparkContext.broadcast(few)
    cut = [F.col(key), tx.tokens(F.col("title")).alias("_t"), F.transform(tx.sentences(F.col("text")), tx.tokens).alias("_s")]
    rows = docs.select(*cut, *([] if each is None else [F.transform(tx.sentences(F.col("text")), each).alias("_each")]))
    fields = [clues.schema["qid"], docs.schema[key], T.StructField("sent", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in (*_SUMS, "score")], T.StructField("rank", T.IntegerType())]
    if each is not None:
        fields.append(T.StructField("each", rows.schema["_each"].dataType.elementType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(shared.value)
        for b in batches:
            yield from _scored_batch(b, asked, k)

    return rows.mapInArrow(run, T.StructType(fields))


_SUMS = ("clueMatch", "clueWeight", "aboutClueMatch", "aboutClueWeight")


class _Asked:
    """Clues by label: those of label i are from starts[i] on."""

    def __init__(self, clues: pa.Table) -> None:
        label = clues.column("label").combine_chunks().dictionary_encode()
        whose = clues.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
        codes = label.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.labels, self.qids = label.dictionary, whose.dictionary
        self.starts = np.searchsorted(codes[order], np.arange(len(self.labels) + 1))
        self.whose = whose.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.weight = clues.column("weight").fill_null(0.0).to_numpy()[order]

    def places(self, words: pa.Array) -> np.ndarray:
        """The number of each word's label, -1 where there is none."""
        return pc.index_in(words, value_set=self.labels.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)


def _scored_batch(b: pa.RecordBatch, asked: _Asked, k: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch of documents: key, words of the title, words of each sentence, and a value for each sentence if there is a fourth column."""
    n, nq = max(1, len(asked.labels)), max(1, len(asked.qids))
    sents = b.column(2).flatten()
    doc_of = np.repeat(np.arange(b.num_rows), _sizes(b.column(2)))
    first_of = np.searchsorted(doc_of, np.arange(b.num_rows))

    def held(lists: pa.Array) -> np.ndarray:  # pairs of a list and a label in it, each once
        at = asked.places(lists.flatten())
        return np.unique((np.repeat(np.arange(len(lists)), _sizes(lists)) * n + at)[at >= 0])

    titles, pairs = held(b.column(1)), held(sents)
    sent, label = pairs // n, pairs % n
    if b.column(0).null_count:  # a document without a key is about nothing
        titles = titles[~b.column(0).is_null().to_numpy(zero_copy_only=False)[titles // n]]
    about = np.isin(doc_of[sent] * n + label, titles)
    many = asked.starts[label + 1] - asked.starts[label]
    part = np.cumsum(np.bincount(doc_of[sent], many, b.num_rows)).astype(np.int64) // PAIRS
    edges = np.append(_runs(part[doc_of[sent]]), len(sent))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        m = many[lo:hi]
        pair = np.repeat(np.arange(lo, hi), m)
        clue = asked.starts[label[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
        code = sent[pair] * nq + asked.whose[clue]
        order = np.argsort(code, kind="stable")
        code, of, weight = code[order], about[pair[order]], asked.weight[clue[order]]
        start = _runs(code)
        sums = [np.add.reduceat(x, start) for x in ((~of).astype(float), np.where(of, 0.0, weight), of.astype(float), np.where(of, weight, 0.0))]
        s, q, points = code[start] // nq, code[start] % nq, sums[1] + 0.25 * sums[3]
        order = np.lexsort((s, -points, doc_of[s] * nq + q))
        own = (doc_of[s] * nq + q)[order]
        start = _runs(own)
        rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own)))) + 1
        kept = rank <= (k or len(own))
        order, rank = order[kept], rank[kept]
        s = s[order]
        made = [asked.qids.take(pa.array(q[order])), b.column(0).take(pa.array(doc_of[s])), pa.array((s - first_of[doc_of[s]]).astype(np.int32)), *[pa.array(x[order]) for x in (*sums, points)], pa.array(rank.astype(np.int32))]
        made += [c.flatten().take(pa.array(s)) for c in b.columns[3:]]
        yield pa.RecordBatch.from_arrays(made, ["qid", b.schema.names[0], "sent", *_SUMS, "score", "rank", *["each"] * (b.num_columns - 3)])


def with_sentences(scored: DataFrame, docs: DataFrame, each: Callable[[Column], Column], name: str, key: str = "doc_id") -> DataFrame:
    """scored (with key, sent) and a column of each's value for the sentence, worked out once a document; nothing more is shuffled of rows of `dealt_vectors`."""
    held = dealt(docs.select(key, "text"), key).select(key, F.transform(tx.sentences(F.col("text")), each).alias("_each"))
    return scored.join(held.hint("merge"), key).withColumn(name, F.get("_each", F.col("sent"))).drop("_each")


def score() -> Column:
    """Weights of matched clues, those of the document's own topic at a quarter."""
    return F.col("clueWeight") + 0.25 * F.col("aboutClueWeight")


def best(scored: DataFrame, k: int | None = 3, key: str = "doc_id") -> DataFrame:
    """The k best passages (all, if None) of each question and document; ties: the earlier sentence."""
    w = Window.partitionBy("qid", key).orderBy(F.desc("score"), "sent")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def first_sentences(results: DataFrame, docs: DataFrame, clues: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first sentence of each result, scored by the square root of the question's number of clues."""
    n = clues.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    first = docs.select(key, F.element_at(tx.sentences(F.col(text)), 1).alias("sentence"))
    return results.select("qid", key).distinct().join(first, key).join(n, "qid").select("qid", key, F.lit(0).alias("sent"), "sentence", F.sqrt("_n").alias("score"))


def origin_features(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flags by clue type of what brought a passage in."""
    types = ("Token", "Phrase", "SV", "NE", "LAT", "Subject", "SubjectNE", "SubjectToken", "SubjectPhrase", "Ngram", "Concept")
    return matches.groupBy("qid", key, "sent").agg(*[F.max(F.when(F.col("clue_type") == t, 1.0)).alias(f"originPsgByClue{t}") for t in types])


def gold_statistics(ranked: DataFrame, k: int, gold: DataFrame) -> DataFrame:
    """By question: scored passages (with sentence, rank), those that the gold pattern matches, the k best of each document, and those of them that it matches."""
    hits = ranked.join(gold, "qid").select("qid", (F.col("rank") <= k).alias("_best"), tx.gold_match(F.col("sentence"), F.col("answer_pattern")).alias("_hit"))
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_scored"), F.count_if("_hit").alias("n_gs_scored"), F.count_if("_best").alias("n_picked"), F.count_if(F.col("_hit") & F.col("_best")).alias("n_gs_picked"))
    return gold.select("qid").join(counts, "qid", "left").na.fill(0)
