"""Queries of text functions, retrieval, passages and candidates, over documents and benchmark texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import index as ix
from ..operators import names as nm
from ..operators import passages as ps
from ..operators import questions as qs
from ..operators import retrieval as rt
from ..sources import readers, sinks
from ..sources.cache import ResultCache
from .base import CLUES_SQL, SENTENCES_SQL, TOKENS, Query, clues, questions, table, titled

STOPS = CLUES_SQL.split("NOT IN (")[1].split(")")[0]


def scan_questions(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("qid", F.lit("factoid").alias("type"), "text")


def scan_json_props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def corpus_skip_disambiguation(s: SparkSession, d: str) -> DataFrame:
    return readers.without_disambiguation(table(s, d, "documents"), "the of").select("doc_id", "lang")


def doc_fetch_by_id(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels").filter("quality = 0").select("doc_id")
    return rt.by_id(labels, table(s, d, "documents").filter("lang = 'en'")).select("doc_id", F.length("doc_text").alias("n_chars"))


def id_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").join(table(s, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return ps.sentences(table(s, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max("sentence").alias("last"))


def token_split(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("qid", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


def ngram_clues(s: SparkSession, d: str) -> DataFrame:
    rows = questions(s, d).select("qid", tx.tokens(F.col("text")).alias("words"))
    return qs.ngram_clues(rows).groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


def stopword_filter(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("qid", F.explode(tx.tokens(F.col("text"))).alias("w")).filter(~tx.is_stop_word(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def canon_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", tx.canonical(F.concat(F.lit(' "The '), "p_name", F.lit("'s,"))).alias("canon"))


def title_capitalize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", tx.capitalized_title(F.concat("p_name", F.lit(" of the "), F.lower("p_type"))).alias("title"))


def span_containment_join(s: SparkSession, d: str) -> DataFrame:
    """Words of questions inside documents' sentences, as a range join on positions within a document."""
    q = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = q.withColumn("end", F.sum(F.length("t") + 1).over(Window.partitionBy("doc_id").orderBy("line"))).withColumn("begin", F.col("end") - F.length("t") - 1)
    marks = table(s, d, "documents").select("doc_id", F.instr("text", "###").alias("at")).filter("at > 0")
    inside = lines.join(marks, "doc_id").filter("begin < at AND at <= end")
    return inside.select("doc_id", "line", "at", "begin", "end")


def gazetteer_entities(s: SparkSession, d: str) -> DataFrame:
    """Names of a list that stand in texts as words: the list is joined by word, not matched one by one."""
    names = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    words = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(tx.tokens(F.col("text"))).alias("token")).unionAll(table(s, d, "part").select(F.col("p_partkey"), F.explode(tx.tokens(F.col("p_type")))))
    return words.join(names, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def regex_entities(s: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[0-9]{3}[-.) ]+[0-9]{3}[-. ]+[0-9]{4}"), F.lit(0))
    return table(s, d, "documents").select("doc_id", F.explode(found).alias("entity")).groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


def clue_union_weights(s: SparkSession, d: str) -> DataFrame:
    words = questions(s, d).select("qid", F.posexplode(tx.tokens(F.col("text"))).alias("i", "w"))
    spans = words.filter(~tx.is_stop_word(F.col("w"))).select("qid", F.when(F.col("i") == 0, "SV").when(F.length("w") > 8, "NE").otherwise("Token").alias("clue_type"), F.col("w").alias("text"))
    return qs.clues(spans).groupBy("qid", "label", "clue_type").agg(F.max("weight").alias("weight"), F.bool_or("reliable").alias("reliable"))


def clue_merge_by_text(s: SparkSession, d: str) -> DataFrame:
    a = clues(s, d).withColumn("seq", F.length("label"))
    b = a.withColumn("weight", F.when(F.length("label") % 2 == 0, 9.0).otherwise(1.0)).withColumn("clue_type", F.lit("NE")).withColumn("reliable", F.lit(False)).withColumn("seq", F.lit(100))
    return qs.merge_clues(a.unionByName(b))


def clue_subsumption(s: SparkSession, d: str) -> DataFrame:
    words = questions(s, d).select("qid", F.posexplode(tx.tokens(F.col("text"))).alias("i", "w"))
    n = F.pmod(F.length("w"), F.lit(4))
    rows = words.select("qid", F.col("i").alias("begin"), (F.col("i") + n).alias("end"), F.pmod(F.col("i"), F.lit(3)).cast("double").alias("dist"))
    return qs.subsume_once(rows)


def solr_terms(s: SparkSession, d: str) -> DataFrame:
    return rt.terms(clues(s, d))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return clues(s, d).select("qid", F.col("label").alias("term"), "weight", F.lit(False).alias("required"))


def tfidf_topn(s: SparkSession, d: str) -> DataFrame:
    return rt.ranked_search(_asked(s, d), table(s, d, "documents"), 6)


def _phrases(s: SparkSession, d: str) -> DataFrame:
    """All words of each question, as phrases of three in a row, the last of what is left."""
    rows = questions(s, d).select("qid", tx.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 3).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * 3 + 1, 3), " "))
    return rows.select("qid", F.explode(F.array_distinct(runs)).alias("term")).select("qid", "term", F.length("term").cast("double").alias("weight"), F.lit(False).alias("required"))


def phrase_boolean(s: SparkSession, d: str) -> DataFrame:
    return rt.phrase_search(_phrases(s, d), table(s, d, "documents"))


def proximity_slop(s: SparkSession, d: str) -> DataFrame:
    return rt.proximity_search(_asked(s, d).withColumn("required", F.lit(True)), table(s, d, "documents"))


def indexed(s: SparkSession, d: str) -> ix.PostingIndex:
    """All documents in an index of two batches, by language."""
    docs = table(s, d, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return ix.build(docs.filter(english), stages.new_folder(s, "index")).append(docs.filter(~english))


def index_topn(s: SparkSession, d: str) -> DataFrame:
    return rt.ranked_search(_asked(s, d), indexed(s, d), 6)


def index_phrase(s: SparkSession, d: str) -> DataFrame:
    return rt.phrase_search(_phrases(s, d), indexed(s, d))


def index_proximity(s: SparkSession, d: str) -> DataFrame:
    return rt.proximity_search(_asked(s, d).withColumn("required", F.lit(True)), indexed(s, d))


def index_evidence(s: SparkSession, d: str) -> DataFrame:
    return _evidence(s, d, indexed(s, d))


def index_statistics(s: SparkSession, d: str) -> DataFrame:
    """What the index holds of each word: documents, occurrences and the longest document."""
    return indexed(s, d).blocks().select("term", F.inline("entries")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places")).alias("n"), F.max("len").alias("longest"))


def search_fields(s: SparkSession, d: str) -> DataFrame:
    """Words in title or body, the longest clues of a question required, raised by their nearness."""
    longest = F.max("weight").over(Window.partitionBy("qid"))
    asked = _asked(s, d).withColumn("required", F.col("weight") == longest)
    docs = titled(s, d).select("doc_id", "title", F.substring("text", F.length("title") + 1, F.length("text")).alias("text"))
    return rt.search(asked, docs, rt.QuerySettings(), 10)


def fulltext_dedup_union(s: SparkSession, d: str) -> DataFrame:
    found = rt.ranked_search(_asked(s, d), table(s, d, "documents"), None)
    pages = found.filter("rank = 2").select("qid", "doc_id")
    return rt.primary_search(pages, found).select("qid", "doc_id", "rank", "origin_concept", *[F.round(c, 4).alias(c) for c in ("resultRR", "resultLogScore")])


def title_in_clue(s: SparkSession, d: str) -> DataFrame:
    return ps.about_clues(titled(s, d), clues(s, d))


def doc_title_answers(s: SparkSession, d: str) -> DataFrame:
    found = rt.ranked_search(_asked(s, d), table(s, d, "documents"), 20)
    return rt.title_answers(found, titled(s, d)).select("qid", "doc_id", "rank", "text", F.round("resultRR", 6).alias("resultRR"))


def web_snippets(s: SparkSession, d: str) -> DataFrame:
    return readers.page_text(table(s, d, "pages")).select("page_id", "title", F.length("text").alias("n"))


def evidence_hits(s: SparkSession, d: str) -> DataFrame:
    return _evidence(s, d, table(s, d, "documents"))


def _evidence(s: SparkSession, d: str, docs: DataFrame | ix.PostingIndex) -> DataFrame:
    out = rt.evidence(clues(s, d).select("qid", F.col("label").alias("text")), docs, _asked(s, d))
    return out.select("qid", "text", "solrAHitsEv", "solrHitsEv", *[F.round(c, 6).alias(c) for c in ("solrMaxScoreEv", "solrHitsANormEv", "solrHitsMaxScoreEv")])


def about_clues(s: SparkSession, d: str) -> DataFrame:
    return ps.about_clues(titled(s, d), clues(s, d)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _scored(s: SparkSession, d: str, k: int | None = None, each: Callable[[Column], Column] | None = None) -> DataFrame:
    return ps.scored(titled(s, d), clues(s, d), k, each)


def passage_by_clue(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).drop("rank")


def passage_score_top3(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d, 3).select("qid", "doc_id", "sent", "score", "rank")


def passage_first(s: SparkSession, d: str) -> DataFrame:
    found = ps.about_clues(titled(s, d), clues(s, d)).select("qid", "doc_id").distinct()
    return ps.first_sentences(found, table(s, d, "documents"), clues(s, d)).withColumn("score", F.round("score", 4))


def passage_gold_stats(s: SparkSession, d: str) -> DataFrame:
    gold = clues(s, d).groupBy("qid").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("answer_pattern"))
    return ps.gold_statistics(_scored(s, d, None, lambda sentence: sentence).withColumnRenamed("each", "sentence"), 3, gold)


def candidates_ngram_surprise(s: SparkSession, d: str) -> DataFrame:
    top = _scored(s, d, 1, cd.capitalised_spans)
    return cd.with_surprise(top.select("qid", "doc_id", "sent", F.inline("each")), clues(s, d))


def candidates_noun_phrases(s: SparkSession, d: str) -> DataFrame:
    """Every noun phrase of every sentence of every document."""
    return cd.noun_phrases(ps.sentences(table(s, d, "documents")), ["doc_id", "sent"])


def listed_names(s: SparkSession, d: str) -> DataFrame:
    """Pieces of the benchmark's texts as names, which overlap, in all documents."""
    t = tx.tokens(F.col("text"))
    piece = lambda a, n: F.struct(F.array_join(F.slice(t, a, n), " ").alias("name"), F.lit(f"{a}+{n}").alias("kind"))
    names = questions(s, d).select(F.explode(F.array(*[piece(a, n) for a, n in ((1, 1), (1, 2), (2, 3), (4, 2))])).alias("x")).select("x.*")
    return nm.longest_names(table(s, d, "documents"), names, ["doc_id"], "text")


def cached_results(s: SparkSession, d: str) -> DataFrame:
    """Pages as results of their queries, saved twice: the second save holds other titles for a third of them."""
    p = table(s, d, "pages")
    rows = p.select(F.concat(F.lit("q"), (F.col("page_id") % 50).cast("string")).alias("query"), F.floor(F.col("page_id") / 50).cast("int").alias("rank"), F.lit("old").alias("title"), "url", F.lit(None).cast("string").alias("description"), "page_id")
    store = ResultCache(s, stages.new_folder(s, "results"))
    store.save(rows.filter("rank > 0"))
    store.save(rows.filter("rank > 0 AND page_id % 3 = 0").withColumn("title", F.lit("new")))
    return store.load(k=6).select("query", "rank", "title", "url", F.round("resultRR", 6).alias("resultRR"))


def candidate_blacklist(s: SparkSession, d: str) -> DataFrame:
    words = questions(s, d).select("qid", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("text"))
    return words.filter(~cd.blacklisted(F.col("text")))


def candidate_distance(s: SparkSession, d: str) -> DataFrame:
    words = questions(s, d).select("qid", F.posexplode(tx.tokens(F.col("text"))).alias("i", "text"))
    cand = words.select("qid", F.col("i").alias("begin"), F.col("i").alias("end"), "text", F.lit(2.0).alias("score"))
    hits = words.filter(F.length("text") >= 9).select("qid", F.col("i").alias("clue_begin"), F.col("i").alias("clue_end"), F.col("text").alias("label"))
    return cd.base_features(cand, hits, ["qid"]).select("qid", "begin", "text", *[F.round(c, 4).alias(c) for c in ("passageLogScore", "psgDistClue")])


def candidate_merge(s: SparkSession, d: str) -> DataFrame:
    words = questions(s, d).select("qid", F.posexplode(tx.tokens(F.col("text"))).alias("i", "text"))
    rows = words.select("qid", "text", F.lit(1).alias("occurences"), F.when(F.col("i") % 3 > 0, F.col("i").cast("double") - 5).alias("f"), F.col("i").alias("snippet_id"))
    return cd.merge_by_text(rows, ["qid"], ["f"]).withColumn("snippet_ids", F.array_join(F.transform("snippet_ids", lambda x: x.cast("string")), ","))


def _tags(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(F.regexp_extract_all("text", F.lit(tx.TOKEN), F.lit(0))).alias("i", "token"))
    n = F.length("token")
    return words.select("qid", "i", "token", F.when(n >= 8, "B").when(n >= 5, "I").otherwise("O").alias("tag"), (n / 20).alias("prob"))


def bio_chunks(s: SparkSession, d: str) -> DataFrame:
    return cd.bio_chunks(_tags(s, d), ["qid"]).withColumn("score", F.round("score", 4))


def token_context_features(s: SparkSession, d: str) -> DataFrame:
    return cd.context_features(_tags(s, d), ["qid"], "tag").select("qid", "i", F.array_join("features", " ").alias("features"))


def gold_tsv_rows(s: SparkSession, d: str) -> DataFrame:
    return sinks.machine_lines(clues(s, d).select("qid", F.col("label").alias("text"), (F.col("weight") / 10).alias("confidence")))


def question_json(s: SparkSession, d: str) -> DataFrame:
    return sinks.question_json(questions(s, d).select("qid"), clues=clues(s, d).select("qid", "label", F.length("label").alias("weight")))


_Q = "SELECT item_id AS qid, text FROM benchmark"
_W = f"words AS (SELECT qid, CAST(i - 1 AS INTEGER) AS i, w[i] AS w FROM (SELECT qid, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id AS qid, {TOKENS} AS w FROM benchmark)))"


ASKED = f"{CLUES_SQL}, asked AS (SELECT qid, label AS term, weight FROM clues)"


FOUND = f"""dt AS (SELECT doc_id, {TOKENS} AS t FROM documents), du AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM dt),
hit AS (SELECT term, doc_id, n, count(*) AS tf FROM du WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
idf AS (SELECT qid, term, weight * ln(1 + (SELECT count(*) FROM documents) / df) AS idf FROM asked JOIN df USING (term)),
sc AS (SELECT qid, doc_id, round(sum(idf * tf / sqrt(n)), 6) AS score, count(*) AS n_terms FROM idf JOIN hit USING (term) GROUP BY qid, doc_id),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"""
#: Smallest span of all the words that a question needs, in documents that have them all: for each place, the last place of every word up to it.
_SPANS = f"""n AS (SELECT qid, count(*) AS n, sum(weight) AS total FROM {{need}} GROUP BY qid), p AS (SELECT doc_id, i AS pos, t[i] AS label FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {TOKENS.replace('{', '{{').replace('}', '}}')} AS t FROM documents))),
  h AS (SELECT k.qid, doc_id, pos, label FROM {{need}} k JOIN p USING (label)), full_ AS (SELECT qid, doc_id FROM h GROUP BY qid, doc_id HAVING count(DISTINCT label) = (SELECT n FROM n WHERE n.qid = h.qid)), hf AS (SELECT h.* FROM h JOIN full_ USING (qid, doc_id)),
  la AS (SELECT a.qid, a.doc_id, a.pos, b.label, max(b.pos) AS at_ FROM (SELECT DISTINCT qid, doc_id, pos FROM hf) a JOIN hf b ON a.qid = b.qid AND a.doc_id = b.doc_id AND b.pos <= a.pos GROUP BY ALL),
  spans AS (SELECT qid, doc_id, CAST(min(w) AS INTEGER) AS span FROM (SELECT qid, doc_id, pos - min(at_) AS w FROM la GROUP BY qid, doc_id, pos HAVING count(*) = (SELECT n FROM n WHERE n.qid = la.qid)) GROUP BY qid, doc_id)"""
_DEGREE = "CAST((span > 2 * n)::INT + (span > 6 * n)::INT + (span > 18 * n)::INT AS INTEGER)"
_BOOST = "CASE WHEN span <= 2 * n THEN total ELSE 0 END + CASE WHEN span <= 6 * n THEN total / 2 ELSE 0 END + CASE WHEN span <= 18 * n THEN total / 4 ELSE 0 END"
TITLE = "titled AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS title FROM documents)"
_ABOUT = f"{CLUES_SQL}, {TITLE}, about AS (SELECT DISTINCT qid, doc_id, label FROM (SELECT doc_id, unnest({TOKENS.replace('text', 'title')}) AS label FROM titled) JOIN clues USING (label))"
VEC = f"""{_ABOUT}, {SENTENCES_SQL}, m AS (SELECT s.doc_id, sent, c.qid, c.label, weight FROM (SELECT DISTINCT doc_id, sent, unnest({TOKENS.replace('text', 'sentence')}) AS label FROM sents) s JOIN clues c USING (label)),
vec AS (SELECT m.qid, m.doc_id, sent, CAST(count(*) FILTER (a.label IS NULL) AS DOUBLE) AS clueMatch, sum(CASE WHEN a.label IS NULL THEN weight ELSE 0.0 END) AS clueWeight, CAST(count(a.label) AS DOUBLE) AS aboutClueMatch,
  sum(CASE WHEN a.label IS NOT NULL THEN weight ELSE 0.0 END) AS aboutClueWeight FROM m LEFT JOIN about a ON m.qid = a.qid AND m.doc_id = a.doc_id AND m.label = a.label GROUP BY m.qid, m.doc_id, sent),
scored AS (SELECT *, clueWeight + 0.25 * aboutClueWeight AS score FROM vec), best AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, sent) AS INTEGER) AS rank FROM scored)"""
_TAGS = "tags AS (SELECT qid, CAST(i - 1 AS INTEGER) AS i, w[i] AS token, CASE WHEN length(w[i]) >= 8 THEN 'B' WHEN length(w[i]) >= 5 THEN 'I' ELSE 'O' END AS tag, length(w[i]) / 20 AS prob FROM (SELECT qid, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id AS qid, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM benchmark)))"
_ENTITIES = "&nbsp;", " ", "&lt;", "<", "&gt;", ">", "&quot;", '"', "&#39;", "''", "&amp;", "&"


def _page_sql() -> str:
    text = "regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for a, b in zip(_ENTITIES[::2], _ENTITIES[1::2], strict=True):
        text = f"replace({text}, '{a}', '{b}')"
    return f"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(length(trim(regexp_replace({text}, '[ \\t\\n\\r]+', ' ', 'g'))) AS INTEGER) AS n FROM pages"


PHRASES = f"""WITH q AS (SELECT item_id AS qid, {TOKENS} AS w FROM benchmark), t AS (SELECT DISTINCT qid, array_to_string(w[3 * i + 1:3 * i + 3], ' ') AS term FROM (SELECT qid, w, unnest(range(0, CAST(ceil(len(w) / 3) AS BIGINT))) AS i FROM q)),
  d AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents), f AS (SELECT qid, doc_id, CAST(length(term) AS DOUBLE) AS w FROM t JOIN d ON contains(d.t, ' ' || term || ' ') WHERE term <> '')
  SELECT qid, doc_id, sum(w) AS score FROM f GROUP BY qid, doc_id"""
EVIDENCE = f"""WITH {ASKED}, {FOUND}, a AS (SELECT qid, label AS text FROM clues), w AS (SELECT DISTINCT qid, text, doc_id FROM a JOIN du ON du.term = a.text),
      x AS (SELECT qid, text, count(*) AS n FROM w GROUP BY ALL), y AS (SELECT w.qid, text, count(*) AS n, max(score) AS s FROM w JOIN found f ON w.qid = f.qid AND w.doc_id = f.doc_id GROUP BY ALL)
      SELECT a.qid, a.text, coalesce(x.n, 0) AS solrAHitsEv, coalesce(y.n, 0) AS solrHitsEv, round(coalesce(s, 0), 6) AS solrMaxScoreEv, round(CASE WHEN coalesce(x.n, 0) > 0 THEN coalesce(y.n, 0) / x.n ELSE 0 END, 6) AS solrHitsANormEv, round(coalesce(y.n * s, 0), 6) AS solrHitsMaxScoreEv
      FROM a LEFT JOIN x ON a.qid = x.qid AND a.text = x.text LEFT JOIN y ON a.qid = y.qid AND a.text = y.text"""

_NAMES_SQL = f"""WITH RECURSIVE q AS (SELECT {TOKENS} AS t FROM benchmark), k(a, n) AS (VALUES (1, 1), (1, 2), (2, 3), (4, 2)), l AS (SELECT DISTINCT array_to_string(list_slice(t, a, a + n - 1), ' ') AS text, a || '+' || n AS kind FROM q, k WHERE len(t) >= a),
  d AS (SELECT doc_id, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), u AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i + 1, i + m), ' ') AS text FROM p, (VALUES (1), (2), (3)) v(m) WHERE i + m <= len(w)),
  h AS (SELECT doc_id, i AS b, max(i + m - 1) AS e FROM u WHERE text IN (SELECT text FROM l) GROUP BY doc_id, i),
  x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS r, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3 FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY b)),
  y AS (SELECT doc_id, b, e, r, CASE WHEN b1 > e THEN b1 WHEN b2 > e THEN b2 ELSE b3 END AS nb FROM x), z AS (SELECT doc_id, b, e, nb FROM y WHERE r = 1 UNION ALL SELECT y.doc_id, y.b, y.e, y.nb FROM z JOIN y ON y.doc_id = z.doc_id AND y.b = z.nb)
  SELECT z.doc_id, CAST(z.b AS INTEGER) AS begin, CAST(z.e AS INTEGER) AS "end", l.text, kind FROM z JOIN u ON u.doc_id = z.doc_id AND u.i = z.b AND u.m = z.e - z.b + 1 JOIN l ON l.text = u.text"""
_NP_CASES = " ".join(f"WHEN lower(w) IN ({', '.join(repr(x) for x in listed)}) THEN '{code}'" for code, listed in cd.LETTERS.items())
_NP_SQL = f"""WITH {SENTENCES_SQL}, a AS (SELECT doc_id, sent, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]') AS ws FROM sents), e AS (SELECT doc_id, sent, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM a),
  c AS (SELECT doc_id, sent, string_agg(CASE WHEN NOT regexp_matches(w, '^[\\p{{L}}\\p{{N}}]') THEN '.' WHEN regexp_matches(w, '^\\p{{N}}') THEN 'C' {_NP_CASES} WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 'P' WHEN regexp_matches(lower(w), '..ly$') THEN 'R'
    WHEN regexp_matches(lower(w), '..(ing|ed)$') THEN 'V' WHEN regexp_matches(lower(w), '..(ful|ous|ive|ic|ical|able|ible|less|ish|est)$') THEN 'J' ELSE 'N' END, '' ORDER BY i) AS tags FROM e GROUP BY doc_id, sent),
  g(level, pattern) AS (VALUES (1, 'D?[JC]*[NP]+'), (2, 'D?[JC]*[NP]+(OD?[JC]*[NP]+)+')), m AS (SELECT doc_id, sent, level, string_split(CASE level WHEN 1 THEN regexp_replace(tags, 'D?[JC]*[NP]+', '<\\0>', 'g') ELSE regexp_replace(tags, 'D?[JC]*[NP]+(OD?[JC]*[NP]+)+', '<\\0>', 'g') END, '<') AS ps FROM c, g),
  u AS (SELECT doc_id, sent, level, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM m), z AS (SELECT *, sum(length(replace(p, '>', ''))) OVER (PARTITION BY doc_id, sent, level ORDER BY i) AS after FROM u)
  SELECT z.doc_id, z.sent, CAST(after - length(replace(p, '>', '')) AS INTEGER) AS begin, CAST(after - length(replace(p, '>', '')) + instr(p, '>') - 2 AS INTEGER) AS "end", CAST(level AS INTEGER) AS level,
    array_to_string(list_slice(ws, CAST(after - length(replace(p, '>', '')) + 1 AS BIGINT), CAST(after - length(replace(p, '>', '')) + instr(p, '>') - 1 AS BIGINT)), ' ') AS text FROM z JOIN a ON z.doc_id = a.doc_id AND z.sent = a.sent WHERE i > 0"""

QUERIES = {
    "scan_questions": Query(scan_questions, "SELECT item_id AS qid, 'factoid' AS type, text FROM benchmark"),
    "scan_json_props": Query(scan_json_props, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "corpus_skip_disambiguation": Query(corpus_skip_disambiguation, "SELECT doc_id, lang FROM documents WHERE NOT contains(text, 'the of')"),
    "doc_fetch_by_id": Query(doc_fetch_by_id, "SELECT l.doc_id, CAST(length(coalesce(d.text, '')) AS INTEGER) AS n_chars FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id WHERE quality = 0"),
    "id_query": Query(id_query, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "sentence_split": Query(sentence_split, f"WITH {SENTENCES_SQL} SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars, max(sentence) AS last FROM sents GROUP BY doc_id"),
    "token_split": Query(token_split, f"WITH {_W} SELECT qid, i AS pos, w AS token FROM words"),
    "ngram_clues": Query(ngram_clues, f"WITH {_W}, g AS (SELECT a.qid, string_agg(b.w, ' ' ORDER BY b.i) AS label FROM words a, (SELECT unnest([2, 3, 4]) AS n) k, words b WHERE a.qid = b.qid AND b.i >= a.i AND b.i < a.i + n GROUP BY a.qid, a.i, n HAVING count(*) = n) SELECT qid, label, count(*) AS n, 1.01::DOUBLE AS weight FROM g GROUP BY qid, label"),
    "stopword_filter": Query(stopword_filter, f"WITH {_W} SELECT w, count(*) AS n FROM words WHERE w NOT IN ({STOPS}) GROUP BY w"),
    "canon_text": Query(canon_text, "SELECT p_partkey, p_name AS canon FROM part"),
    "title_capitalize": Query(title_capitalize, "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' of the ' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part"),
    "span_containment_join": Query(span_containment_join, """WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, t[i] AS t FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))),
      e AS (SELECT doc_id, line, CAST(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS "end", length(t) AS n FROM l), m AS (SELECT doc_id, CAST(instr(text, '###') AS INTEGER) AS at_ FROM documents WHERE contains(text, '###'))
      SELECT e.doc_id, line, at_ AS "at", "end" - n - 1 AS "begin", "end" FROM e JOIN m ON e.doc_id = m.doc_id AND "end" - n - 1 < at_ AND at_ <= "end" """),
    "gazetteer_entities": Query(gazetteer_entities, f"WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), w AS (SELECT unnest({TOKENS}) AS token FROM benchmark UNION ALL SELECT unnest({TOKENS.replace('text', 'p_type')}) FROM part) SELECT token, count(*) AS n FROM w WHERE token IN (SELECT token FROM n) GROUP BY token"),
    "regex_entities": Query(regex_entities, "SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3}[-.) ]+[0-9]{3}[-. ]+[0-9]{4}')) AS entity FROM documents) GROUP BY ALL"),
    "clue_union_weights": Query(clue_union_weights, f"WITH {_W}, c AS (SELECT qid, CASE WHEN regexp_matches(w, '^\\W*$') THEN w ELSE regexp_replace(regexp_replace(w, '\\W+$', ''), '^\\W+', '') END AS label, CASE WHEN i = 0 THEN 'SV' WHEN length(w) > 8 THEN 'NE' ELSE 'Token' END AS clue_type FROM words WHERE w NOT IN ({STOPS})) SELECT DISTINCT qid, label, clue_type, CASE clue_type WHEN 'NE' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, true AS reliable FROM c"),
    "clue_merge_by_text": Query(clue_merge_by_text, f"WITH {CLUES_SQL} SELECT qid, CASE WHEN length(label) % 2 = 0 AND weight <= 9 OR length(label) = 1 THEN 'NE' ELSE 'Token' END AS clue_type, label, CASE WHEN length(label) % 2 = 0 AND weight <= 9 THEN 9.0::DOUBLE ELSE weight END AS weight, true AS reliable FROM clues"),
    "clue_subsumption": Query(clue_subsumption, f"""WITH {_W}, r AS (SELECT qid, i AS "begin", CAST(i + length(w) % 4 AS INTEGER) AS "end", CAST(i % 3 AS DOUBLE) AS dist FROM words)
      SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.qid = r.qid AND b."begin" <= r."begin" AND b."end" >= r."end" AND b."end" - b."begin" > r."end" - r."begin" AND NOT r.dist + 1 < b.dist)"""),
    "solr_terms": Query(solr_terms, f"WITH {CLUES_SQL} SELECT qid, label AS term, weight, true AS required FROM clues"),
    "tfidf_topn": Query(tfidf_topn, f"WITH {ASKED}, {FOUND} SELECT * FROM found WHERE rank <= 6"),
    "phrase_boolean": Query(phrase_boolean, PHRASES),
    "index_phrase": Query(index_phrase, PHRASES),
    "index_topn": Query(index_topn, f"WITH {ASKED}, {FOUND} SELECT * FROM found WHERE rank <= 6"),
    "index_statistics": Query(index_statistics, f"SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS n, CAST(max(longest) AS INTEGER) AS longest FROM (SELECT doc_id, term, count(*) AS n, any_value(l) AS longest FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY doc_id, term) GROUP BY term"),
    "index_proximity": Query(index_proximity, f"""WITH {CLUES_SQL}, {_SPANS.format(need="clues")} SELECT qid, doc_id, span, {_DEGREE} AS degree, {_BOOST} AS boost FROM spans JOIN n USING (qid) WHERE span <= 18 * n"""),
    "index_evidence": Query(index_evidence, EVIDENCE),
    "proximity_slop": Query(proximity_slop, f"""WITH {CLUES_SQL}, {_SPANS.format(need="clues")} SELECT qid, doc_id, span, {_DEGREE} AS degree, {_BOOST} AS boost FROM spans JOIN n USING (qid) WHERE span <= 18 * n"""),
    "search_fields": Query(search_fields, f"""WITH {ASKED}, need AS (SELECT qid, label, weight FROM (SELECT *, max(weight) OVER (PARTITION BY qid) AS most FROM clues) WHERE weight = most), {_SPANS.format(need="need")}, {FOUND},
      got AS (SELECT f.qid, f.doc_id FROM found f JOIN need ON f.qid = need.qid JOIN hit h ON h.doc_id = f.doc_id AND h.term = need.label GROUP BY f.qid, f.doc_id HAVING count(*) = (SELECT n FROM n WHERE n.qid = f.qid)),
      near AS (SELECT qid, doc_id, {_BOOST} AS boost FROM spans JOIN n USING (qid) WHERE span <= 18 * n), every AS (SELECT f.qid, f.doc_id, round(f.score + coalesce(boost, 0), 6) AS score FROM found f JOIN got USING (qid, doc_id) LEFT JOIN near USING (qid, doc_id))
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM every) WHERE rank <= 10"""),
    "fulltext_dedup_union": Query(fulltext_dedup_union, f"""WITH {ASKED}, {FOUND}, pages AS (SELECT qid, doc_id FROM found WHERE rank = 2), o AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM found WHERE rank <> 2)
      SELECT qid, doc_id, 1 AS rank, 1 AS origin_concept, 1.0::DOUBLE AS resultRR, 0.0::DOUBLE AS resultLogScore FROM pages UNION ALL SELECT qid, doc_id, rank, 0, round(1 / rank, 4), round(ln(1 + score), 4) FROM o WHERE rank <= 6"""),
    "title_in_clue": Query(title_in_clue, f"WITH {_ABOUT} SELECT * FROM about"),
    "doc_title_answers": Query(doc_title_answers, f"WITH {ASKED}, {FOUND}, {TITLE} SELECT qid, doc_id, rank, regexp_replace(title, '\\s+\\([^)]*\\)\\s*$', '') AS text, round(1 / rank, 6) AS resultRR FROM found JOIN titled USING (doc_id) WHERE rank <= 20"),
    "web_snippets": Query(web_snippets, _page_sql()),
    "evidence_hits": Query(evidence_hits, EVIDENCE),
    "about_clues": Query(about_clues, f"WITH {_ABOUT} SELECT qid, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM about GROUP BY qid"),
    "passage_by_clue": Query(passage_by_clue, f"WITH {VEC} SELECT * FROM scored"),
    "passage_score_top3": Query(passage_score_top3, f"WITH {VEC} SELECT qid, doc_id, sent, score, rank FROM best WHERE rank <= 3"),
    "passage_first": Query(passage_first, f"WITH {_ABOUT}, n AS (SELECT qid, count(*) AS n FROM clues GROUP BY qid) SELECT r.qid, r.doc_id, 0 AS sent, regexp_split_to_array(text, '[.!?]+[ \\t\\n\\r]+')[1] AS sentence, round(sqrt(n), 4) AS score FROM (SELECT DISTINCT qid, doc_id FROM about) r JOIN documents d ON r.doc_id = d.doc_id JOIN n ON r.qid = n.qid"),
    "passage_gold_stats": Query(passage_gold_stats, f"""WITH {VEC}, g AS (SELECT qid, first(label ORDER BY length(label) DESC, label DESC) AS a FROM clues GROUP BY qid), x AS (SELECT b.qid, rank, contains(lower(sentence), a) AS hit FROM best b JOIN sents s ON b.doc_id = s.doc_id AND b.sent = s.sent JOIN g ON b.qid = g.qid)
      SELECT g.qid, count(rank) AS n_scored, count(*) FILTER (hit) AS n_gs_scored, count(*) FILTER (rank <= 3) AS n_picked, count(*) FILTER (hit AND rank <= 3) AS n_gs_picked FROM g LEFT JOIN x ON g.qid = x.qid GROUP BY g.qid"""),
    "candidates_noun_phrases": Query(candidates_noun_phrases, _NP_SQL),
    "listed_names": Query(listed_names, _NAMES_SQL),
    "cached_results": Query(cached_results, "SELECT 'q' || (page_id % 50) AS query, CAST(page_id // 50 AS INTEGER) AS rank, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS title, url, round(1.0::DOUBLE / (page_id // 50), 6) AS resultRR FROM pages WHERE page_id >= 50 AND page_id // 50 <= 6"),
    "candidates_ngram_surprise": Query(candidates_ngram_surprise, f"""WITH {VEC}, t AS (SELECT b.qid, b.doc_id, b.sent, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}]+') AS w FROM best b JOIN sents s ON b.doc_id = s.doc_id AND b.sent = s.sent WHERE rank = 1),
      u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t), c AS (SELECT qid, doc_id, sent, i - 1 AS i, w[i] AS word, i - row_number() OVER (PARTITION BY qid, doc_id, sent ORDER BY i) AS run FROM u WHERE regexp_matches(w[i], '^\\p{{Lu}}')),
      r AS (SELECT qid, doc_id, sent, CAST(min(i) AS INTEGER) AS "begin", CAST(max(i) AS INTEGER) AS "end", string_agg(word, ' ' ORDER BY i) AS text FROM c GROUP BY qid, doc_id, sent, run)
      SELECT r.*, NOT EXISTS (SELECT 1 FROM clues k WHERE k.qid = r.qid AND ends_with(lower(r.text), k.label)) AS surprise FROM r"""),
    "candidate_blacklist": Query(candidate_blacklist, f"WITH {_W} SELECT DISTINCT qid, w AS text FROM words WHERE length(w) > 1 AND w NOT IN ({STOPS})"),
    "candidate_distance": Query(candidate_distance, f"""WITH {_W}, f AS (SELECT qid, min(i) AS k FROM words WHERE length(w) >= 9 GROUP BY qid)
      SELECT words.qid, i AS "begin", w AS text, round(ln(3), 4) AS passageLogScore, round(exp(-CASE WHEN k = i THEN -1 ELSE abs(k - i) - 1 END) + CASE WHEN k IS NULL THEN NULL ELSE 0 END, 4) AS psgDistClue FROM words LEFT JOIN f USING (qid)"""),
    "candidate_merge": Query(candidate_merge, f"""WITH {_W}, r AS (SELECT *, CASE WHEN i % 3 > 0 THEN CAST(i AS DOUBLE) - 5 END AS f FROM words)
      SELECT qid, w AS text, count(*) AS occurences, CASE WHEN max(f) >= 0 OR count(f) = count(*) THEN max(f) END AS f, string_agg(DISTINCT CAST(i AS VARCHAR), ',' ORDER BY i) AS snippet_ids FROM r GROUP BY qid, w""".replace("string_agg(DISTINCT CAST(i AS VARCHAR), ',' ORDER BY i)", "string_agg(CAST(i AS VARCHAR), ',' ORDER BY i)")),
    "bio_chunks": Query(bio_chunks, f"""WITH {_TAGS}, b AS (SELECT *, lag(tag, 1, 'O') OVER (PARTITION BY qid ORDER BY i) AS p FROM tags), r AS (SELECT *, sum(CASE WHEN tag = 'B' OR tag = 'I' AND p = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY i) AS run FROM b)
      SELECT qid, min(i) AS "begin", max(i) AS "end", string_agg(token, ' ' ORDER BY i) AS text, round(avg(prob), 4) AS score FROM r WHERE tag <> 'O' GROUP BY qid, run"""),
    "token_context_features": Query(token_context_features, f"""WITH {_TAGS}, l AS (SELECT *, lag(tag, 1, '#') OVER w AS p, lead(tag, 1, '#') OVER w AS n FROM tags WINDOW w AS (PARTITION BY qid ORDER BY i))
      SELECT qid, i, 'tag[-1]=' || p || ' tag[0]=' || tag || ' tag[1]=' || n || ' tag[-1..0]=' || p || '|' || tag || ' tag[0..1]=' || tag || '|' || n || ' tag[-1..1]=' || p || '|' || tag || '|' || n AS features FROM l"""),
    "gold_tsv_rows": Query(gold_tsv_rows, f"WITH {CLUES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, label) AS i FROM clues) SELECT qid, string_agg(label || ' (' || printf('%.2f', weight / 10) || ')', ' | ' ORDER BY i) AS line FROM r WHERE i <= 4 GROUP BY qid"),
    "question_json": Query(question_json, f"""WITH {CLUES_SQL} SELECT b.item_id AS qid, '{{"qid":' || b.item_id || ',"clues":[' || coalesce(string_agg('{{"label":"' || label || '","weight":' || length(label) || '}}', ',' ORDER BY label), '') || ']}}' AS json FROM benchmark b LEFT JOIN clues c ON c.qid = b.item_id GROUP BY b.item_id"""),
}
