"""How the logical tables are bound to the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Query:
    """A query and, where SQL can express it, the same in SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def clues(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    """Distinct words of a question that are no stop words, of `least` letters or more; longer words weigh more."""
    words = questions(spark, d).select("qid", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("label"))
    kept = words.filter((F.length("label") >= least) & ~tx.is_stop_word(F.col("label")))
    return kept.select("qid", F.lit("Token").alias("clue_type"), "label", F.length("label").cast("double").alias("weight"), F.lit(True).alias("reliable"))


def titled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their first five words as title."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " ", 6), 1, 5), " ").alias("title"), "text")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as answers: the order is the question, the part the text, numbers are features (f2 may be negative, f3 unset)."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), F.lit(1).alias("occurences"), F.col("l_quantity").alias("f1"),
        F.round(F.col("l_discount") - 0.05, 4).alias("f2"), F.when(F.col("l_tax") >= 0.02, F.col("l_tax")).alias("f3"), (F.col("l_extendedprice") / 100000).alias("confidence"),
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
    )


def triples(spark: SparkSession, d: str) -> DataFrame:
    """The star schema as a graph."""
    t = lambda n: table(spark, d, n)
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    row = lambda df, s, p, o, uri: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(uri).alias("o_is_uri"), F.lit(None).cast("string").alias("lang"))
    c, s, n, r, o, p = t("customer"), t("supplier"), t("nation"), t("region"), t("orders"), t("part")
    parts = [
        row(c, node("customer", "c_custkey"), "nation", node("nation", "c_nationkey"), True), row(c, node("customer", "c_custkey"), "label", F.col("c_name"), False), row(c, node("customer", "c_custkey"), "segment", F.col("c_mktsegment"), False),
        row(s, node("supplier", "s_suppkey"), "nation", node("nation", "s_nationkey"), True), row(s, node("supplier", "s_suppkey"), "label", F.col("s_name"), False),
        row(n, node("nation", "n_nationkey"), "region", node("region", "n_regionkey"), True), row(n, node("nation", "n_nationkey"), "label", F.col("n_name"), False), row(r, node("region", "r_regionkey"), "label", F.col("r_name"), False),
        row(o, node("order", "o_orderkey"), "customer", node("customer", "o_custkey"), True), row(o, node("order", "o_orderkey"), "status", F.col("o_orderstatus"), False),
        row(p, node("part", "p_partkey"), "label", F.col("p_name"), False), row(p, node("part", "p_partkey"), "brand", F.col("p_brand"), False), row(p, node("part", "p_partkey"), "type", F.col("p_type"), False),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)
CLUES_SQL = f"""clues AS (
  SELECT DISTINCT qid, label, CAST(length(label) AS DOUBLE) AS weight FROM (
    SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS label FROM benchmark)
  WHERE label NOT IN ({_STOP}))"""
HITS_SQL = """hits AS (
  SELECT l_orderkey AS qid, 'p' || CAST(l_partkey AS VARCHAR) AS text, 1 AS occurences, l_quantity AS f1, round(l_discount - 0.05, 4) AS f2,
    CASE WHEN l_tax >= 0.02 THEN l_tax END AS f3, l_extendedprice / 100000 AS confidence, l_linenumber AS line, l_returnflag AS flag FROM lineitem)"""
TRIPLES_SQL = """triples AS (
  SELECT 'customer:' || c_custkey AS s, 'nation' AS p, 'nation:' || c_nationkey AS o, true AS o_is_uri FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'label', c_name, false FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'segment', c_mktsegment, false FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation', 'nation:' || s_nationkey, true FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 'label', s_name, false FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region', 'region:' || n_regionkey, true FROM nation
  UNION ALL SELECT 'nation:' || n_nationkey, 'label', n_name, false FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'label', r_name, false FROM region
  UNION ALL SELECT 'order:' || o_orderkey, 'customer', 'customer:' || o_custkey, true FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'status', o_orderstatus, false FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'label', p_name, false FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'brand', p_brand, false FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'type', p_type, false FROM part)"""
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SENTENCES_SQL = r"""sents AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent, s[i] AS sentence FROM (
    SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+[ \t\n\r]+') AS s FROM documents))
  WHERE s[i] <> '')"""
