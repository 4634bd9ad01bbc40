"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, language_id, lexical, mixing, ngram_lm, packing, paragraphs, pivot_search, quality, rules, sharding, simhash, suffix
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold("doc_id", 4) != 2), metadata=("n_chars",))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return quality.scored(docs, model, ["doc_id"], metadata=("n_chars",)).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 16)


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), packing.public_encoder())


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = rules.judged(docs, rules.fit(docs, labels), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(_table(spark, sf_dir, "documents"), (3, 1, 2))


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model = ngram_lm.fit(docs.filter(~held_out))
    out = ngram_lm.scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_dual_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(*conversations.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    out = language_id.labelled(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    found = (op1_factorisation_machine, op2_golay_simhash, op3_rendezvous_sharding, op4_paragraph_minhash, op5_suffix_array_dedup, op6_grouping_genetic_packing, op7_decision_list, op8_pareto_mixing, op9_pivot_search, op10_kneser_ney, op11_dual_sorted_search, op12_conversation_trie, op13_language_crf)
    return {f.__name__: f for f in found}


#: The same search by comparing every query with every row.
_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


#: The same mix over plain windows; targets of sources by the water level, documents' levels by size, Pareto order, and the last correction.
_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size, source,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':17') AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM docs GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM sources
), waters AS (
  SELECT *, (least(1.5::DOUBLE * sum(source_size) OVER (), sum(cap) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT first(level ORDER BY cap / w, source) FROM waters WHERE level <= cap / w) * w), cap) AS target FROM waters
), sized AS (
  SELECT d.source, size, any_value(target) AS target, CASE WHEN size > 0 THEN CAST(floor(pow(CAST(size AS DOUBLE), 0.5) * 1024) AS BIGINT) ELSE 0 END AS dw, count(*) AS n
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, size
), levels AS (
  SELECT source, size, dw, CASE WHEN rest > 0 THEN (target - 2.0::DOUBLE * CAST(above AS DOUBLE)) / CAST(rest AS DOUBLE) END AS level FROM (
    SELECT *, coalesce(sum(CAST(n * size AS HUGEINT)) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
      sum(CAST(n AS HUGEINT) * size * dw) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM sized)
), level AS (
  SELECT source, arg_max(level, size) FILTER (level * dw <= 2) AS level FROM levels GROUP BY source
), expected AS (
  SELECT d.doc_id, d.size, d.key, d.source, t.source_size, t.target, CASE WHEN size > 0 THEN least(2.0::DOUBLE, coalesce(l.level * CAST(floor(pow(CAST(size AS DOUBLE), 0.5) * 1024) AS BIGINT), 2.0::DOUBLE)) ELSE 0.0::DOUBLE END AS m,
    (CAST('0x' || d.key[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN level l ON d.source IS NOT DISTINCT FROM l.source
), odds AS (
  SELECT *, CAST(floor(m) AS BIGINT) AS whole, CASE WHEN m > floor(m) THEN (u / (1 - u)) / ((m - floor(m)) / (1 - (m - floor(m)))) END AS odds FROM expected
), running AS (
  SELECT *, row_number() OVER () AS id, target - sum(whole * size) OVER (PARTITION BY source) AS gap,
    sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, key ROWS UNBOUNDED PRECEDING) AS upto FROM odds
), sample AS (
  SELECT *, CASE WHEN odds IS NOT NULL AND size > 0 AND upto - size / 2 <= gap THEN 1 ELSE 0 END AS more FROM running
), opened AS (
  SELECT *, gap - sum(more * size) OVER (PARTITION BY source) AS open FROM sample
), last AS (
  SELECT *, row_number() OVER (PARTITION BY source, odds IS NOT NULL AND size > 0 AND more = CASE WHEN open < 0 THEN 1 ELSE 0 END AND size < 2 * abs(open) ORDER BY abs(size - abs(open)), key, id) AS i,
    odds IS NOT NULL AND size > 0 AND more = CASE WHEN open < 0 THEN 1 ELSE 0 END AND size < 2 * abs(open) AS fits FROM opened
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN fits AND i = 1 THEN 1 - more ELSE more END) AS BIGINT) AS taken FROM last
"""


#: The same search by scoring every document that holds a term.
_RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t, row_number() OVER () AS r FROM documents
), totals AS (
  SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d
), tf AS (
  SELECT r, doc_id, CAST(any_value(n) AS BIGINT) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, doc_id, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
  SELECT item_id, r, term, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), w AS (
  SELECT item_id, q.r, term, times * CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN df USING (term), totals
), scored AS (
  SELECT w.item_id, w.r, tf.r AS dr, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term), totals GROUP BY w.item_id, w.r, tf.r, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


#: The same trie by grouping whole prefixes; crc32 is worked out bit by bit.
_TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS anchor, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), o AS (
  SELECT c.conv_id, t.i, role, text FROM c JOIN t ON t.conv_id = c.anchor AND t.i <= c.h
), n AS (
  SELECT conv_id, max(i) AS n FROM o GROUP BY conv_id
), b AS (
  SELECT * FROM o UNION ALL SELECT c.conv_id, t.i - c.h + coalesce(n.n, 0), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN n ON n.conv_id = c.conv_id
), lists AS (
  SELECT conv_id, list([role, text] ORDER BY i) AS turns FROM b GROUP BY conv_id
), every AS (
  SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN lists USING (conv_id)
), p AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS ends, CASE WHEN d > 0 THEN strlen(turns[d][2]) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM every)
), nodes AS (
  SELECT min(conv_id) AS rep, depth, prefix, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, prefix
), own AS (
  SELECT p.conv_id, p.depth, nodes.rep FROM p JOIN nodes ON p.depth = nodes.depth AND p.prefix = nodes.prefix
), up AS (
  SELECT nodes.rep, nodes.depth, nodes.n_convs, nodes.bytes, own.rep AS parent FROM nodes LEFT JOIN own ON own.conv_id = nodes.rep AND own.depth = nodes.depth - 1
), kids AS (
  SELECT parent AS rep, depth - 1 AS depth, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY ALL
), below AS (
  SELECT own.rep, own.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM up u LEFT JOIN kids k ON k.rep = u.rep AND k.depth = u.depth JOIN own ON own.conv_id = u.rep AND own.depth <= u.depth GROUP BY ALL
)
SELECT n.rep AS conv_id, n.depth, up.parent AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes n JOIN up ON up.rep = n.rep AND up.depth = n.depth LEFT JOIN kids ON kids.rep = n.rep AND kids.depth = n.depth JOIN below ON below.rep = n.rep AND below.depth = n.depth
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_pareto_mixing": _MIX_SQL, "op9_pivot_search": _TOP_K_SQL, "op11_dual_sorted_search": _RANKED_SQL, "op12_conversation_trie": _TRIE_SQL}
