"""Queries of whole plans and of their stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from ..operators import alignment as al
from ..plans import answering
from .base import Query, questions, table
from .retrieval import FOUND, STOPS, VEC


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def answer_passages(s: SparkSession, d: str) -> DataFrame:
    """The best sentences of the documents that each question finds."""
    clues = answering.question_clues(questions(s, d))
    best = answering.best_passages(answering.found_documents(clues, _docs(s, d)), _docs(s, d), clues)
    return best.select("qid", "doc_id", "doc_rank", "sent", "score", "rank")


def answer_candidates(s: SparkSession, d: str) -> DataFrame:
    """Names in the best passages and titles of the documents found, as one hitlist."""
    clues, docs = answering.question_clues(questions(s, d)), _docs(s, d)
    found = stages.staged(answering.found_documents(clues, docs), "found")  # read by both producers
    out = answering.hitlist([answering.passage_answers(answering.best_passages(found, docs, clues), clues), answering.title_answers(found, docs)])
    kept = ["originPsg", "originPsgSurprise", "originDocTitle", "originMultiple"]
    return out.select("qid", "text", "occurences", *[F.round(c, 4).alias(c) for c in ("passageLogScore", "resultRR", "resultLogScore")], *kept)


def passage_edit_features(s: SparkSession, d: str) -> DataFrame:
    """Every word of the best passages of every question, with what happens to it on the cheapest way from the passage's tree to the question's."""
    clues, docs = answering.question_clues(questions(s, d)), _docs(s, d)
    tree = lambda text: al.chunk_tree(F.regexp_extract_all(F.col(text), F.lit(tx.TOKEN), F.lit(0)))
    best = answering.best_passages(answering.found_documents(clues, docs), docs, clues)
    pairs = best.withColumn("tree", tree("sentence")).join(questions(s, d).select("qid", tree("text").alias("other")), "qid")
    pairs = pairs.repartition(s.sparkContext.defaultParallelism, "qid", "doc_id", "sent")  # few rows that cost much: dealt to all cores, not to as few tasks as their bytes ask for
    return al.edit_features(pairs, ["qid", "doc_id", "sent"]).withColumn("features", F.array_join("features", " "))


def answer_questions(s: SparkSession, d: str) -> DataFrame:
    """The flagship plan: the five best answers of every benchmark question."""
    return answering.answer(questions(s, d), _docs(s, d))


_TOP = f"WITH {VEC}, asked AS (SELECT qid, label AS term, weight FROM clues), {FOUND}, top AS (SELECT qid, doc_id, score, rank AS doc_rank FROM found WHERE rank <= {answering.DOCUMENTS})"
_CANDIDATES = f"""{_TOP}, t AS (SELECT b.qid, b.doc_id, b.sent, b.score, doc_rank, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}]+') AS w FROM best b JOIN top ON b.qid = top.qid AND b.doc_id = top.doc_id JOIN sents s ON b.doc_id = s.doc_id AND b.sent = s.sent WHERE b.rank <= {answering.PASSAGES}),
  u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t), c AS (SELECT qid, doc_id, sent, score, doc_rank, i - 1 AS i, w[i] AS word, i - row_number() OVER (PARTITION BY qid, doc_id, sent ORDER BY i) AS run FROM u WHERE regexp_matches(w[i], '^\\p{{Lu}}')),
  r AS (SELECT qid, score, doc_rank, string_agg(word, ' ' ORDER BY i) AS text FROM c GROUP BY qid, doc_id, sent, score, doc_rank, run),
  p AS (SELECT qid, text, ln(1 + score) AS pls, 1 / doc_rank AS rr, NULL AS rls, 1.0::DOUBLE AS psg, CASE WHEN NOT EXISTS (SELECT 1 FROM clues k WHERE k.qid = r.qid AND ends_with(lower(r.text), k.label)) THEN 1.0::DOUBLE END AS new, NULL AS doc FROM r WHERE length(text) > 1 AND lower(text) NOT IN ({STOPS})
    UNION ALL SELECT qid, regexp_replace(title, '\\s+\\([^)]*\\)\\s*$', ''), NULL, 1 / doc_rank, ln(1 + score), NULL, NULL, 1.0::DOUBLE FROM top JOIN titled USING (doc_id) WHERE regexp_replace(title, '\\s+\\([^)]*\\)\\s*$', '') <> '')
SELECT qid, text, count(*) AS occurences, round(max(pls), 4) AS passageLogScore, round(max(rr), 4) AS resultRR, round(max(rls), 4) AS resultLogScore, max(psg) AS originPsg, max(new) AS originPsgSurprise, max(doc) AS originDocTitle, CASE WHEN max(psg) + max(doc) > 1 THEN 1.0::DOUBLE END AS originMultiple FROM p GROUP BY qid, text"""

QUERIES = {
    "answer_passages": Query(answer_passages, f"{_TOP} SELECT b.qid, b.doc_id, doc_rank, sent, b.score, rank FROM best b JOIN top ON b.qid = top.qid AND b.doc_id = top.doc_id WHERE rank <= {answering.PASSAGES}"),
    "answer_candidates": Query(answer_candidates, _CANDIDATES),
    "answer_questions": Query(answer_questions),
}
