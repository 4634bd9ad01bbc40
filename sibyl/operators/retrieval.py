"""Full-text retrieval over positional postings: terms, boolean phrase queries, proximity, ranked top-n, evidence counts.

Postings are (doc_id, term, pos), so that a query is a join on the term and a sum per document. The score of a term is
tf x ln(1 + N / df) / sqrt(document length), weighted. Searches take documents, whose words are cut anew, or a kept index of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from . import ranking
from .index import PostingIndex


@dataclass(frozen=True)
class QuerySettings:
    """Proximity degrees, base distance and factor; fields; whether all clues are required; proximity alone."""

    degrees: int = 3
    distance: int = 2
    factor: int = 3
    fields: tuple[str, ...] = ("title", "text")
    all_required: bool = True
    proximity_only: bool = False


def terms(clues: DataFrame) -> DataFrame:
    """Search terms (qid, term, weight, required) of clues; phrase clues are none, and reliable ones are required."""
    return clues.filter(F.col("clue_type") != "Phrase").select("qid", tx.escaped_query(F.col("label")).alias("term"), "weight", F.col("reliable").alias("required"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term) of every word of every document."""
    return docs.select(key, F.posexplode(tx.tokens(F.col(text))).alias("pos", "term"))


def field_text(settings: QuerySettings, docs: DataFrame) -> Column:
    """The text of the settings' fields that docs have, one after the other: a word counts in any of them, and places go on from field to field."""
    return F.concat_ws("\n", *[F.col(f) for f in settings.fields if f in docs.columns])


def _word_hits(docs: DataFrame | PostingIndex, words: DataFrame, key: str, text: str | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents or an index: (term, key, _len, tf) of these words, their (term, df), and one row with the number of documents."""
    if isinstance(docs, PostingIndex):
        return docs.hits(words), docs.terms().join(words, "term", "left_semi"), docs.spark.range(1).select(F.lit(docs.n_docs()).cast("long").alias("_docs"))
    sized = docs.select(key, tx.tokens(F.col(text) if isinstance(text, str) else text).alias("_t")).select(key, F.size("_t").alias("_len"), F.explode("_t").alias("term"))
    hits = sized.join(words, "term", "left_semi").groupBy("term", key, "_len").agg(F.count(F.lit(1)).alias("tf"))
    return hits, hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), docs.agg(F.count(F.lit(1)).alias("_docs"))


def ranked_search(queries: DataFrame, docs: DataFrame | PostingIndex, n: int | None, key: str = "doc_id", text: str | Column = "text", only: DataFrame | None = None, most: int = ranking.MOST_ASKED) -> DataFrame:
    """The n best documents (all, if None) for queries of single words (qid, term, weight, required).

    Only postings of asked words are counted. Documents lacking a required word are out. only: (qid, key) of the documents that are wanted; scores
    are the same as without. Up to `most` words of questions go to the tasks, which score documents where they lie; more, and documents whose keys repeat, meet them by joins,
    where an index leaves out blocks that can't bring a document among the n best. Columns: qid, key, score, n_terms, rank.
    """
    asked = _asked(queries)
    rows = ranking.few(asked, most)
    entries = None if rows is None else _entries(docs, rows.column("term"), key, text)
    if entries is not None:
        found = ranking.scored(rows, entries, queries.schema["qid"], n if only is None else None)
        if only is not None:
            found = found.join(only.select("qid", key).distinct(), ["qid", key], "left_semi")
        return _ranked(found, n, key)
    needed = asked.groupBy("qid").agg(F.sum("required").alias("n_required"))
    hits, df, n_docs = _word_hits(docs, asked.select("term").distinct(), key, text)
    weighted = asked.join(df, "term").crossJoin(F.broadcast(n_docs)).select("qid", "term", "required", (F.col("weight") * F.log1p(F.col("_docs") / F.col("df"))).alias("idf"))
    if only is None and n is not None and isinstance(docs, PostingIndex):
        only = docs.candidates(weighted, needed, n)
    if only is None:
        pairs = weighted.join(hits, "term")
    else:
        pairs = weighted.join(hits.join(only.select(key).distinct(), key, "left_semi"), "term").join(only.select("qid", key).distinct(), ["qid", key], "left_semi")
    found = pairs.groupBy("qid", key).agg(F.sum(F.col("idf") * F.col("tf") / F.sqrt("_len")).alias("score"), F.count(F.lit(1)).alias("n_terms"), F.sum("required").alias("_got"))
    return _ranked(found.join(needed, "qid").filter(F.col("_got") == F.col("n_required")).drop("_got", "n_required"), n, key)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter("qid IS NOT NULL").groupBy("qid", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"), F.max(F.col("required").cast("int")).alias("required"))


def _entries(docs: DataFrame | PostingIndex, terms: pa.ChunkedArray, key: str, text: str | Column) -> ranking.Entries | None:
    known = pc.unique(terms.combine_chunks().drop_null())
    return ranking.from_index(docs, known) if isinstance(docs, PostingIndex) else ranking.from_texts(docs, known, key, text)


def _ranked(found: DataFrame, n: int | None, key: str) -> DataFrame:
    rounded = found.withColumn("score", F.round("score", 6))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def phrase_search(queries: DataFrame, docs: DataFrame | PostingIndex, key: str = "doc_id", text: str | Column = "text", most: int = ranking.MOST_ASKED) -> DataFrame:
    """Boolean phrase queries (qid, term, weight, required), a term being one or more words in a row: qid, key, score (sum of the weights that hit).

    Documents give their runs of words of the lengths that are asked for; a run is looked up as a whole, so a frequent word in a phrase
    meets nothing. Runs that no phrase equals go before anything is shuffled, where the phrases are few enough for Spark to broadcast.
    Of an index, up to `most` phrases go to the tasks, which look them up part by part; more meet the places of their rarest word first, and those of the other words only in the documents that have it.
    """
    parts = queries.withColumn("_w", tx.tokens(F.col("term"))).withColumn("_n", F.size("_w")).filter("_n > 0").withColumn("_phrase", F.array_join("_w", " "))
    if isinstance(docs, PostingIndex):
        phrases = parts.select("_phrase").distinct()
        known = ranking.few(phrases, most)
        hits = _phrase_hits(phrases, docs) if known is None else ranking.phrase_hits(docs, known.column("_phrase").combine_chunks())
        return _phrase_scores(parts, hits, docs.key)
    lengths = F.broadcast(parts.agg(F.sort_array(F.collect_set("_n")).alias("_lengths")))  # one row
    phrases = parts.select("_phrase").distinct()
    words = docs.select(key, tx.tokens(F.col(text) if isinstance(text, str) else text).alias("_t")).crossJoin(lengths)
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: F.array_join(F.slice("_t", i, n), " "))
    runs = F.array_distinct(F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.size("_t")), of_length)))
    at = words.select(key, F.explode(runs).alias("_phrase")).join(phrases, "_phrase", "left_semi")
    return _phrase_scores(parts, at, key)


def _phrase_scores(parts: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """Scores from the documents (key, _phrase) of each phrase; those lacking a required one are out."""
    found = parts.select("qid", "term", "weight", "required", "_phrase").join(at, "_phrase").select("qid", "term", "weight", "required", key).distinct()
    needed = parts.filter("required").groupBy("qid").agg(F.countDistinct("term").alias("_need"))
    scored = found.groupBy("qid", key).agg(F.sum("weight").alias("score"), F.count_if("required").alias("_got"))
    return scored.join(needed, "qid", "left").filter(F.col("_got") == F.coalesce("_need", F.lit(0))).select("qid", key, "score")


def _phrase_hits(phrases: DataFrame, index: PostingIndex) -> DataFrame:
    """(_phrase, key) of the documents that hold each phrase (words joined by a space)."""
    words = phrases.select("_phrase", F.posexplode(F.split("_phrase", " ")).alias("_at", "term"))
    counted = words.join(index.terms(), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = counted.groupBy("_phrase").agg(F.min_by(F.struct("_at", "term"), F.struct("df", "_at")).alias("_r"), F.min("df").alias("_df"), F.count(F.lit(1)).alias("_n")).filter("_df > 0")
    first = rare.select("_phrase", "_n", F.col("_r._at").alias("_at"), F.col("_r.term").alias("term"))
    starts = lambda at: F.transform("places", lambda p: p - at)
    seed = first.join(index.places(first.select("term").distinct()), "term").select("_phrase", "_n", F.col("_at").alias("_seed"), index.key, starts(F.col("_at")).alias("_starts"))
    alone = seed.filter("_n = 1").select("_phrase", index.key)
    rest = counted.join(rare.filter("_n > 1").select("_phrase", F.col("_r._at").alias("_seed")), "_phrase").filter("_at <> _seed").select("_phrase", "_at", "term")
    # places of the other words are met by word and document, so a frequent word's are shuffled once, not once for each phrase with it
    wanted = seed.filter("_n > 1").join(rest, "_phrase").select("_phrase", "_n", "_starts", "_at", "term", index.key)
    # a start stays where the other word stands in its place; most go here, before they are gathered
    agreed = F.array_intersect("_starts", starts(F.col("_at")))
    met = wanted.join(index.places(rest.select("term").distinct()), ["term", index.key]).select("_phrase", index.key, "_n", agreed.alias("_kept")).filter(F.size("_kept") > 0)
    held = met.groupBy("_phrase", index.key).agg(F.first("_n").alias("_n"), F.collect_list("_kept").alias("_kept"))  # a row for each other word of a phrase
    # a start counts if all the other words agree on it
    whole = held.filter(F.size("_kept") == F.col("_n") - 1).filter(F.exists(F.get("_kept", F.lit(0)), lambda s: F.forall("_kept", lambda o: F.array_contains(o, s))))
    return alone.unionByName(whole.select("_phrase", index.key))


def proximity_search(queries: DataFrame, docs: DataFrame | PostingIndex, settings: QuerySettings = QuerySettings(), key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """Documents in which all required words of a question stand within the slop: qid, key, span, degree, boost.

    Degree i allows distance x factor^i x number of words between the first and the last, and adds (sum of weights) / 2^i; all degrees
    that hold add up. Only documents with all the words are looked into: there, going over the places in order, the last place of
    each word so far gives the smallest span.
    """
    asked = queries.filter("required").groupBy("qid", "term").agg(F.sum("weight").alias("weight"))
    sums = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))
    numbered = asked.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy("term"))).select("qid", "term", "_i")
    words = asked.select("term").distinct()
    if isinstance(docs, PostingIndex):
        df = docs.terms().join(words, "term", "left_semi")
    else:
        cut = docs.filter(F.col(key).isNotNull()).select(key, tx.tokens(F.col(text) if isinstance(text, str) else text).alias("_t"))
        df = cut.select(F.explode(F.array_distinct("_t")).alias("term")).join(words, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a document with all words has the question's rarest, so only its documents are looked into; a question of which a word stands nowhere has none
    counted = numbered.join(df, "term", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("_r")).filter("_r.df > 0")
    rare = counted.select("qid", F.col("_r.term").alias("term"))
    if isinstance(docs, PostingIndex):
        seeds = stages.staged(rare.join(docs.hits(rare.select("term").distinct()).select("term", key), "term").select("qid", key), "seeds")
        places = docs.places(words).join(seeds.select(key).distinct(), key, "left_semi").select("term", key, F.col("places").alias("_at"))
    else:
        seeds = stages.staged(rare.join(cut.select(key, F.explode(F.array_distinct("_t")).alias("term")), "term").select("qid", key), "seeds")
        held = docs.join(seeds.select(key).distinct(), key, "left_semi")
        at = held.select(key, F.posexplode(tx.tokens(F.col(text) if isinstance(text, str) else text)).alias("pos", "term")).join(words, "term", "left_semi")
        places = at.groupBy("term", key).agg(F.collect_list("pos").alias("_at"))  # places of one word in one document
    full = seeds.distinct().join(numbered, "qid").join(places, ["term", key]).groupBy("qid", key).agg(F.count(F.lit(1)).alias("_got"), F.collect_list(F.transform("_at", lambda p: F.struct(p.alias("pos"), F.col("_i").alias("i")))).alias("_hits"))
    full = full.join(sums, "qid").filter(F.col("_got") == F.col("n"))
    start = F.struct(F.array_repeat(F.lit(-1), F.col("n").cast("int")).alias("last"), F.lit(2**31 - 1).alias("span"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda p, j: F.when(j + 1 == hit["i"], hit["pos"]).otherwise(p))
        return F.struct(last.alias("last"), F.when(F.array_min(last) >= 0, F.least(state["span"], hit["pos"] - F.array_min(last))).otherwise(state["span"]).alias("span"))

    spans = full.withColumn("span", F.aggregate(F.sort_array(F.flatten("_hits")), start, step, lambda s: s["span"])).select("qid", key, "n", "total", "span")
    made = []
    for i in range(settings.degrees):
        slop = F.lit(settings.distance * settings.factor**i) * F.col("n")
        made.append(F.when(F.col("span") <= slop, F.col("total") / float(2**i)).otherwise(0.0))
    degree = F.expr(" + ".join(f"int(span > {settings.distance * settings.factor**i} * n)" for i in range(settings.degrees)))
    return spans.withColumn("degree", degree).withColumn("boost", sum(made[1:], made[0])).filter("boost > 0").select("qid", key, "span", "degree", "boost")


def search(queries: DataFrame, docs: DataFrame, settings: QuerySettings, n: int | None, key: str = "doc_id") -> DataFrame:
    """A search by all the settings: words in any of the fields, their required ones only where `all_required`, raised by nearness; by nearness alone where `proximity_only`.

    Columns: qid, key, score, rank.
    """
    text = field_text(settings, docs)
    near = proximity_search(queries, docs, settings, key, text).select("qid", key, "boost")
    if settings.proximity_only:
        both = near.withColumn("score", F.round("boost", 6))
    else:
        wanted = queries if settings.all_required else queries.withColumn("required", F.lit(False))
        both = ranked_search(wanted, docs, None, key, text).join(near, ["qid", key], "left").withColumn("score", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6))
    ranked = both.select("qid", key, "score").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def by_id(hits: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents' texts by id, empty where there is none."""
    return hits.join(docs.select(key, F.col(text).alias("doc_text")), key, "left").withColumn("doc_text", F.coalesce("doc_text", F.lit("")))


def primary_search(concept_pages: DataFrame, found: DataFrame, k: int = 6, key: str = "doc_id") -> DataFrame:
    """Concept pages first, at rank 1, then up to k hits that are not among them; resultRR and resultLogScore are set."""
    pages = concept_pages.select("qid", key).distinct().withColumn("rank", F.lit(1)).withColumn("score", F.lit(0.0)).withColumn("origin_concept", F.lit(1))
    other = found.join(pages.select("qid", key), ["qid", key], "left_anti")
    other = other.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).filter(F.col("rank") <= k).withColumn("origin_concept", F.lit(0))
    both = pages.unionByName(other.select("qid", key, "rank", F.col("score").cast("double"), "origin_concept"))
    return both.select("qid", key, "rank", "origin_concept", (1 / F.col("rank")).alias("resultRR"), F.log1p("score").alias("resultLogScore"))


def title_answers(found: DataFrame, docs: DataFrame, k: int = 20, key: str = "doc_id", title: str = "title") -> DataFrame:
    """Titles of the best k documents as answers."""
    top = found.filter(F.col("rank") <= k).join(docs.select(key, title), key)
    return top.select("qid", key, "rank", tx.document_title(F.col(title)).alias("text"), F.lit(1.0).alias("originDocTitle"), (1 / F.col("rank")).alias("resultRR"), F.log1p("score").alias("resultLogScore"))


def evidence(answers: DataFrame, docs: DataFrame | PostingIndex, clue_terms: DataFrame, key: str = "doc_id", text: str = "text", most: int = ranking.MOST_ASKED) -> DataFrame:
    """Of answers (qid, text of one word): documents with the answer, with the answer and all required clues, their ratio, and the best clue score among these.

    Up to `most` answers and as many clues go to the tasks, which count where the documents lie; more are joined, and then only documents with an answer are scored by the clues.
    """
    words = answers.select("qid", "text", F.lower("text").alias("term"))
    sent, asked = ranking.few(words, most), ranking.few(_asked(clue_terms), most)
    known = sent is not None and asked is not None
    entries = _entries(docs, pa.chunked_array([c.cast(pa.string()) for t in (sent, asked) for c in t.column("term").chunks], pa.string()), key, text) if known else None
    if entries is not None:
        sums = ranking.counted(sent, asked, entries).groupBy("place").agg(F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.max("best").alias("best"))
        named = answers.sparkSession.createDataFrame(sent.select(["qid", "text"]).append_column("place", pa.array(range(sent.num_rows), pa.int64())))
        hits = named.join(sums, "place").groupBy("qid", "text").agg(F.sum("n").alias("solrAHitsEv"), F.sum("n_scored").alias("solrHitsEv"), F.round(F.max("best"), 6).alias("solrMaxScoreEv"))
        return _ratios(answers.select("qid", "text").join(hits, ["qid", "text"], "left").na.fill(0))
    distinct = words.select("term").distinct()
    if isinstance(docs, PostingIndex):
        at = docs.hits(distinct).select(key, "term")
    else:  # of the corpus only the answers' words are shuffled
        at = docs.select(key, F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("term")).join(distinct, "term", "left_semi")
    with_answer = words.join(at, "term").select("qid", "text", key)
    a_hits = with_answer.groupBy("qid", "text").agg(F.count(F.lit(1)).alias("solrAHitsEv"))
    clued = ranked_search(clue_terms, docs, None, key, text, only=with_answer.select("qid", key).distinct())
    both = with_answer.join(clued, ["qid", key]).groupBy("qid", "text").agg(F.count(F.lit(1)).alias("solrHitsEv"), F.max("score").alias("solrMaxScoreEv"))
    return _ratios(answers.select("qid", "text").join(a_hits, ["qid", "text"], "left").join(both, ["qid", "text"], "left").na.fill(0))


def _ratios(out: DataFrame) -> DataFrame:
    return out.withColumn("solrHitsANormEv", F.when(F.col("solrAHitsEv") > 0, F.col("solrHitsEv") / F.col("solrAHitsEv")).otherwise(0.0)).withColumn("solrHitsMaxScoreEv", F.col("solrHitsEv") * F.col("solrMaxScoreEv"))


def repeat_search(found: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits without those that were visited before."""
    return found.join(seen, list(keys), "left_anti")
