"""Queries of linking, graph retrieval, answer types, lifecycle and training, over the star schema as a graph, parts as names and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stages, trees
from ..operators import answers as an
from ..operators import graph as gr
from ..operators import questions as qs
from ..operators import boosting
from ..operators import scoring as sc
from ..operators import multilabel as ml
from ..operators import training as tr
from ..streaming import lifecycle as lc
from ..streaming import live
from .base import TRIPLES_SQL, Query, table, triples


def bgp_join(s: SparkSession, d: str) -> DataFrame:
    """Customers with their nation's and region's names: a pattern of four triples."""
    t = triples(s, d)
    where = gr.objects(t, "nation", "c", "n").filter(F.col("c").startswith("customer:")).join(gr.objects(t, "region", "n", "r"), "n")
    return where.join(gr.objects(t, "label", "n", "nation"), "n").join(gr.objects(t, "label", "r", "region"), "r").select("c", "nation", "region")


def popularity(s: SparkSession, d: str) -> DataFrame:
    return gr.popularity(triples(s, d)).select("resource", F.round("log_popularity", 6).alias("log_popularity"))


def _wiki(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as articles: every third redirects to the next, every fifth is a disambiguation of the two after it."""
    n = F.col("s_suppkey")
    base = table(s, d, "supplier")
    row = lambda df, p, o: df.select(F.concat(F.lit("a"), n.cast("string")).alias("s"), F.lit(p).alias("p"), o.alias("o"))
    to = lambda k: F.concat(F.lit("a"), (n + k).cast("string"))
    return (
        row(base, "label", F.col("s_name")).unionAll(row(base, "page", n.cast("string"))).unionAll(row(base.filter(n % 3 == 0), "redirect", to(1))).unionAll(row(base.filter(n % 5 == 0), "means", to(1))).unionAll(row(base.filter(n % 5 == 0), "means", to(2)))
        .unionAll(row(base.filter(n % 2 == 0), "comment", F.concat(F.lit("about "), F.col("s_name"))))
    )


_WIKI_SQL = """wiki AS (SELECT 'a' || s_suppkey AS s, 'label' AS p, s_name AS o FROM supplier UNION ALL SELECT 'a' || s_suppkey, 'page', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'a' || s_suppkey, 'redirect', 'a' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'a' || s_suppkey, 'means', 'a' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL SELECT 'a' || s_suppkey, 'means', 'a' || (s_suppkey + 2) FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'a' || s_suppkey, 'comment', 'about ' || s_name FROM supplier WHERE s_suppkey % 2 = 0)"""


def article_resolution(s: SparkSession, d: str) -> DataFrame:
    return gr.articles(_wiki(s, d), "label", "redirect", "means", "page", "comment")


def _types(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("resource"), F.explode(F.array(F.col("p_type"), F.concat("p_type", F.lit("/"), "p_brand"), F.lit("part"))).alias("type"))


def types_most_specific(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    edges = p.select(F.concat("p_type", F.lit("/"), "p_brand").alias("type"), F.col("p_type").alias("supertype")).filter("supertype <> 'ECONOMY'").unionAll(p.select("p_type", F.lit("part"))).distinct()
    return gr.most_specific(_types(s, d), gr.closure(edges, 4).select("type", "supertype"))


def props_ontology(s: SparkSession, d: str) -> DataFrame:
    t = triples(s, d).withColumn("p", F.concat(F.lit("onto/"), "p"))
    concepts = table(s, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("resource"))
    return gr.properties(concepts, t, "onto/", "onto/label", excluded="^(wiki|segment)")


def props_generic_limit(s: SparkSession, d: str) -> DataFrame:
    back = triples(s, d).filter("o_is_uri").select(F.col("o").alias("s"), F.concat(F.lit("of "), "p").alias("p"), F.col("s").alias("o"), "o_is_uri", "lang")
    topics = table(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("resource"))
    return gr.generic_properties(topics, back, 40)


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("resource"), F.lit(0.5).alias("score"))


def path_one_hop(s: SparkSession, d: str) -> DataFrame:
    return gr.one_hop(_paths(s, d).withColumn("p0", F.lit("customer")), triples(s, d))


def path_two_hop(s: SparkSession, d: str) -> DataFrame:
    return gr.two_hop(_paths(s, d).withColumn("p0", F.lit("customer")).withColumn("p1", F.lit("nation")), triples(s, d))


def path_witness(s: SparkSession, d: str) -> DataFrame:
    """Segments of an order's customer, with the customer's name as witness."""
    paths = _paths(s, d).withColumn("p0", F.lit("customer")).withColumn("p1", F.lit("segment")).withColumn("p2", F.lit("nation"))
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(s, d, "nation")
    seen = o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("w_resource"), F.lower("n_name").alias("w_label"))
    return gr.witnessed(paths, triples(s, d), seen, "label")


def path_top15(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    li = stages.dealt(li.select("l_orderkey", "l_returnflag", "l_linenumber"), li.count(), "l_orderkey", most=100_000)  # a line item gives many paths
    features = li.select(F.col("l_orderkey").alias("qid"), F.explode(F.array(F.concat(F.lit("f"), F.col("l_returnflag")), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")))).alias("feature")).distinct()
    p = table(s, d, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("price"))
    w = p.groupBy("path", F.concat(F.lit("n"), (F.col("n") % 7 + 1).cast("string")).alias("feature")).agg(F.round(F.avg("price") / 2000, 3).alias("weight"))
    bias = p.groupBy("path").agg(F.lit("_").alias("feature"), F.lit(-1.0).alias("weight"))
    return gr.best_paths(features, w.unionByName(bias.select("path", "feature", "weight")))


def property_answers(s: SparkSession, d: str) -> DataFrame:
    values = path_two_hop(s, d)
    return gr.property_answers(values, "originDBpOntology").withColumn("resultLogScore", F.round("resultLogScore", 6))


def clue_in_property(s: SparkSession, d: str) -> DataFrame:
    values = path_two_hop(s, d).unionByName(path_one_hop(s, d))
    asked = table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("qid"), F.lit("nation").alias("label"))
    return gr.clues_in_property(values, asked, "originDBpONoClue").select("qid", "property", "value", "n_clues", "originDBpONoClue")


def _linked(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.col("l_orderkey").alias("qid"), F.col("p_type").alias("clue"), F.col("p_name").alias("label"), F.col("p_partkey").alias("entity"), F.round(F.col("l_quantity") / 50, 4).alias("score")).groupBy("qid", "clue", "label", "entity").agg(F.max("score").alias("score"))


def concept_rr(s: SparkSession, d: str) -> DataFrame:
    return qs.concept_ranks(_linked(s, d)).select("qid", "clue", "label", "entity", "score", *[F.round(c, 6).alias(c) for c in ("source_rr", "label_rr")])


def concept_top5(s: SparkSession, d: str) -> DataFrame:
    return gr.limited(_linked(s, d), ["qid"], [F.desc("score"), "entity"], 5)


def concept_logistic(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    rows = p.select("p_partkey", (F.col("p_size") % 4).alias("edit_dist"), (F.col("p_size") / 50).alias("label_probability"), F.log("p_retailprice").alias("log_popularity"), F.lit(0.5).alias("relatedness"), F.lit(0).alias("by_lat"), (F.col("p_size") % 2).alias("by_ne"), F.lit(1).alias("by_subject"), F.lit(0).alias("by_ngram"), F.lit(1).alias("by_fuzzy"), (F.col("p_size") % 3 == 0).cast("int").alias("by_cross_wiki"))
    return rows.select("p_partkey", F.round(sc.concept_score(), 6).alias("score"))


def concept_features(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("qid"), F.upper("p_name").alias("text")).distinct()
    out = gr.concept_features(li, qs.concept_ranks(_linked(s, d).filter("score > 0.3")))
    return out.select("qid", "text", "originConcept", *[F.round(c, 6).alias(c) for c in ("originConceptSourceRR", "originConceptLabelRR", "originConceptScore")])


def question_class_argmax(s: SparkSession, d: str) -> DataFrame:
    features = table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("feature"))
    w = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("C"), F.substring("feature", 1, 1)).alias("class"), "feature", F.lit(1.5).alias("weight"))
    bias = w.select("class", F.lit("_").alias("feature"), (F.substring("class", 2, 1).cast("double") / -10).alias("weight"))
    status = w.filter("class IN ('C1', 'C2')").select("class", F.lit("F").alias("feature"), F.lit(2.0).alias("weight"))
    return qs.classify(features, w.unionByName(bias).unionByName(status))


def _names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("e"), F.min("p_partkey").cast("string")).alias("entity"))


def _misspelt(s: SparkSession, d: str) -> DataFrame:
    n = _names(s, d)
    return n.select(F.col("entity").alias("qid"), F.concat(F.lit("x"), F.substring("name", F.lit(3), F.length("name"))).alias("label"))


def entity_link_exact(s: SparkSession, d: str) -> DataFrame:
    n, p = _names(s, d), table(s, d, "part")
    return p.select("p_partkey", F.upper("p_name").alias("label")).join(n, F.lower("label") == F.lower("name")).select("p_partkey", "label", "entity")


def entity_link_fuzzy(s: SparkSession, d: str) -> DataFrame:
    return gr.fuzzy_hits(_misspelt(s, d), _names(s, d), 3)


def _lookups(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(s, d, "part")
    fuzzy = p.filter("p_size <= 30").select(F.col("p_partkey").alias("entity"), (F.col("p_size") % 4).alias("dist"))
    links = p.filter("p_size >= 20").select(F.col("p_type").alias("label"), F.col("p_partkey").alias("entity"), F.col("p_size").cast("long").alias("n"))
    return fuzzy, gr.label_probability(links).select("entity", "prob")


def lookup_merge(s: SparkSession, d: str) -> DataFrame:
    return gr.merge_lookups(*_lookups(s, d)).withColumn("prob", F.round("prob", 8))


def pageid_dedup(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.pmod(F.col("p_partkey"), F.lit(97)).alias("page_id"))
    return gr.one_per_page(gr.merge_lookups(*_lookups(s, d)).join(names, "entity")).withColumn("prob", F.round("prob", 8))


def _tails(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last letters of nations' names as names of three or four letters, and one letter less as asked labels."""
    n = table(s, d, "nation").select("n_nationkey", F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity"), "n_name")
    end = lambda k: F.substring("n_name", F.lit(k), F.length("n_name"))
    return n.select(F.col("n_nationkey").alias("qid"), end(7).alias("label")), n.select(end(6).alias("name"), "entity")


def entity_link_short(s: SparkSession, d: str) -> DataFrame:
    return gr.fuzzy_hits(*_tails(s, d), 3)


def entity_linking(s: SparkSession, d: str) -> DataFrame:
    """Part names, as they stand and misspelt, linked by spelling and by how often a label means a part."""
    part = lambda c: F.concat(F.lit("part:"), c.cast("string"))
    names = table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(part(F.min("p_partkey")).alias("entity"))
    asked = names.select(F.col("entity").alias("qid"), F.explode(F.array(F.struct(F.lit("Token").alias("t"), F.col("name").alias("l")), F.struct(F.lit("Ngram").alias("t"), F.concat(F.lit("x"), F.substring("name", F.lit(3), F.length("name"))).alias("l")), F.struct(F.lit("NE").alias("t"), F.concat(F.lit("y"), F.substring("name", F.lit(3), F.length("name"))).alias("l")))).alias("c"))
    cross = table(s, d, "part").select(F.col("p_name").alias("label"), part(F.col("p_partkey")).alias("entity"), F.col("p_size").cast("long").alias("n"))
    score = F.col("label_probability") * 4 + F.col("log_popularity") / 2 - F.col("edit_dist")
    return gr.linked_concepts(asked.select("qid", F.col("c.t").alias("clue_type"), F.col("c.l").alias("label")), names, cross, gr.popularity(triples(s, d)), score).select("qid", "label", "entity", "edit_dist", "by_fuzzy", "by_cross", F.round("score", 4).alias("score"))


def path_union(s: SparkSession, d: str) -> DataFrame:
    """All of an order's paths in one table: of one property, of two, and of one that leads to a witness."""
    paths = _paths(s, d).drop("score").withColumn("x", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("score")) for p, v in (("customer", 0.9), ("customer|nation", 0.7), ("customer|segment|nation", 0.5))])))
    seen = table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), F.lit("nation:1").alias("w_resource"), F.lit("nation_2").alias("w_label"))
    return gr.path_values(paths.select("qid", "resource", "x.path", "x.score"), triples(s, d), seen, "label")


def topic_lookup(s: SparkSession, d: str) -> DataFrame:
    """Customers as topics, by their label or by the nation as page; at most five."""
    by_page = table(s, d, "nation").select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("title"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("page_id"))
    by_name = table(s, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("page_id"))
    return gr.topics(by_page.unionByName(by_name), triples(s, d), "label", "nation", "segment")


def source_bindings(s: SparkSession, d: str) -> DataFrame:
    """Two-property values marked by the source that they came from."""
    values = path_one_hop(s, d).unionByName(path_two_hop(s, d))
    out = gr.source_bindings(values, [("originDBpOntology", F.col("property").contains("nation")), ("originFreebaseOntology", F.col("property") == "customer")])
    return out.select("qid", "property", "value", "originDBpOntology", "originFreebaseOntology")


def bilinear_relatedness(s: SparkSession, d: str) -> DataFrame:
    """Each vector against the mean vector of its label, over a diagonal matrix."""
    e = table(s, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("mean"))
    matrix = [[(1 + i % 3) / 2 if i == j else 0.0 for j in range(64)] for i in range(64)]
    return e.join(mean, "label").select("vec_id", F.round(gr.relatedness(F.col("mean"), F.col("embedding"), matrix, -0.25), 4).alias("score"))


def clue_overlap_cases(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    answers = li.select(F.col("l_orderkey").alias("qid"), F.col("p_name").alias("text")).distinct()
    words = li.select(F.col("l_orderkey").alias("qid"), F.when(F.col("p_size") % 2 == 0, "NE").otherwise("Token").alias("clue_type"), F.explode(F.concat(F.split("p_name", " "), F.array("p_name"))).alias("label")).distinct()
    return an.clue_overlap(answers, words)


_CASES = ["match", "prefixed", "prefixing", "suffixed", "suffixing", "substred", "substring"]
_OVERLAP_SQL = """WITH li AS (SELECT l_orderkey AS qid, p_name, p_size FROM lineitem JOIN part ON l_partkey = p_partkey), a AS (SELECT DISTINCT qid, p_name AS text FROM li),
c AS (SELECT DISTINCT qid, CASE WHEN p_size % 2 = 0 THEN 'NE' ELSE 'Token' END AS kind, unnest(list_append(string_split(p_name, ' '), p_name)) AS label FROM li),
h AS (SELECT a.qid, text, kind, CASE WHEN text = label THEN 'match' WHEN starts_with(text, label) AND regexp_matches(substr(text, length(label) + 1), '^\\s*\\W\\s*') THEN 'prefixed'
  WHEN ends_with(text, label) AND regexp_matches(left(text, length(text) - length(label)), '\\s*\\W\\s*$') THEN 'suffixed' END AS k FROM a JOIN c ON a.qid = c.qid)
SELECT qid, text, """ + ", ".join(f"CAST(nullif(count(*) FILTER (kind {op} 'NE' AND k = '{k}'), 0) AS DOUBLE) AS {pre}{k.capitalize()}Score" for pre, op in (("clOC", "="), ("clO", "<>")) for k in _CASES) + ", " + ", ".join(
    f"CAST((nullif(count(*) FILTER (kind {op} 'NE' AND k = 'prefixed'), 0) + nullif(count(*) FILTER (kind {op} 'NE' AND k = 'suffixed'), 0)) / 2 AS DOUBLE) AS {pre}MetaMatchScore" for pre, op in (("clOC", "="), ("clO", "<>"))
) + " FROM h WHERE k IS NOT NULL GROUP BY qid, text"


def _hypernyms(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    up = n.select((F.col("n_nationkey") + 100).cast("long").alias("synset"), (F.col("n_regionkey") + 10).cast("long").alias("up_synset")).join(r.select((F.col("r_regionkey") + 10).alias("up_synset"), F.lower("r_name").alias("up_text")), "up_synset").select("synset", "up_synset", "up_text")
    top = r.select((F.col("r_regionkey") + 10).cast("long").alias("synset"), F.lit(1).cast("long").alias("up_synset"), F.lit("location").alias("up_text"))
    beyond = s.createDataFrame([(1, 0, "entity")], "synset long, up_synset long, up_text string")
    return up.unionByName(top).unionByName(beyond)


def _lats(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("qid"), F.lower("n_name").alias("lat_text"), (F.col("n_nationkey") + 100).cast("long").alias("synset"), F.lit(0.0).alias("specificity"), F.lit("NE").alias("lat_type"), F.lit("NE").alias("base_lat_type"))


def lat_closure(s: SparkSession, d: str) -> DataFrame:
    return an.generalised(_lats(s, d), _hypernyms(s, d)).drop("base_lat_type")


def tycor_match(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' regions and nations as the answer's types, customers' as the question's, matched within market segments' first customers."""
    q = an.generalised(_lats(s, d), _hypernyms(s, d))
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a0 = sup.select(F.explode(F.array(F.col("s_suppkey"), F.col("s_suppkey") * 2, F.col("s_suppkey") * 3)).alias("qid"), F.col("s_name").alias("text"), F.lower("n_name").alias("lat_text"), (F.col("n_nationkey") + 100).cast("long").alias("synset"), F.lit(0.0).alias("specificity"), F.lit("WnInstance").alias("lat_type"), F.lit("WnInstance").alias("base_lat_type"))
    a = an.generalised(a0, _hypernyms(s, d), keys=("qid", "text"))
    out = an.coercion_features(a0.select("qid", "text"), q, a)
    return out.select("qid", "text", F.round("spWordNet", 6).alias("spWordNet"), "tyCorSpQHit", "tyCorSpAHit", "tyCorSpQAHit", "tyCorAWnInstance", "noTyCor", "LATANone")


def quantity_lat(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    rows = p.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5e1"))).otherwise(F.col("p_name")).alias("text"))
    return an.quantity_types(rows)


_STATES = {"view": "asked", "click": "in progress", "purchase": "answered"}


def _events(s: SparkSession, d: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv])[F.col("event_type")]
    return table(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("seq"), state.alias("state"), "ts", "value").filter("state IS NOT NULL")


def lifecycle_last_state(s: SparkSession, d: str) -> DataFrame:
    return lc.last_states(_events(s, d))


def lifecycle_recent(s: SparkSession, d: str) -> DataFrame:
    return lc.recent(lc.last_states(_events(s, d)), "answered", 6)


def lifecycle_answers(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d).select("qid", "seq", F.col("state").alias("text"), F.col("value").alias("confidence"))
    return lc.current_answers(rows)


def live_answers(s: SparkSession, d: str) -> DataFrame:
    """Events that arrive in three batches, the stream being started anew for each: answers, and the state of their question, which waits for three or, every second one, four origins."""
    ev = _events(s, d)
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in live.EVENTS.split(", ")}
    base = empty | {"qid": F.col("qid"), "seq": F.col("seq"), "ts": F.col("ts").cast("timestamp")}
    kinds = (
        {"kind": F.lit("state"), "text": F.col("state")}, {"kind": F.lit("answer"), "text": F.col("state"), "confidence": F.col("value")},
        {"kind": F.lit("part"), "origin": F.col("state"), "is_last": F.lit(True), "expected": (3 + F.col("qid") % 2).cast("int")},
    )
    each = F.array(*[F.struct(*[v.alias(n) for n, v in (base | k).items()]) for k in kinds])
    changes = live.replay(ev.select(F.explode(each).alias("e")).select("e.*"), 3, patience=86400.0)
    head = live.questions(changes).select("qid", "state", "generation", F.col("status") == "complete")
    return live.answers(changes).join(head.toDF("qid", "state", "generation", "complete"), "qid")


def source_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d).select("qid", "seq", F.lit("web").alias("type"), F.col("state").alias("origin"), F.concat(F.lit("t"), (F.col("seq") % 3).cast("string")).alias("title"), F.lit("u").alias("url"), (F.col("seq") % 3).alias("state"))
    return lc.source_registry(rows)


def answer_sentence(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("answer"), F.col("o_orderkey").alias("pos"), F.col("c_name").alias("source"), F.when(F.col("o_orderkey") % 2 == 0, "Order: Filled by").otherwise("Has Status").alias("property"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("witness"))
    return lc.answer_sentences(rows)


def tree_edit_distance(s: SparkSession, d: str) -> DataFrame:
    """All of each question's words as a chain against the next question's."""
    words = table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    nodes = F.transform("w", lambda w, i: F.struct(F.lower(w).alias("lemma"), F.when(F.length(w) > 5, "NN").otherwise("X").alias("pos"), F.lit("dep").alias("rel"), (i - 1).cast("int").alias("parent")))
    t = words.select("item_id", nodes.alias("t"))
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(other, "item_id").select("item_id", F.round(trees.tree_distance("t", "u"), 6).alias("distance"))


def _training_rows(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    n = F.length("text").cast("double")
    return docs.select("doc_id", F.col("quality").alias("class"), F.log1p(n).alias("f_length"), (F.length(F.regexp_replace("text", "[^|#$%&*!]", "")) / n).alias("f_marks"), (F.size(F.split("text", "\n")) / F.log1p(n)).alias("f_lines"))


_F = ["f_length", "f_marks", "f_lines"]


def train_passage_lr(s: SparkSession, d: str) -> DataFrame:
    rows = _training_rows(s, d)
    train, test = tr.split(rows, "doc_id", 0)
    return tr.scored(tr.logistic(train, _F), test).select("doc_id", "class", F.round("score", 4).alias("score"))


def train_answer_gbt(s: SparkSession, d: str) -> DataFrame:
    rows = _training_rows(s, d)
    train, test = tr.split(rows, "doc_id", 1)
    return tr.scored(tr.forest(train, _F, trees=10, depth=3), test).select("doc_id", "class", F.round("score", 4).alias("score"))


def train_answer_boosted(s: SparkSession, d: str, trees: int = 40) -> DataFrame:
    """Trees of at most ten leaves, trained on the rows of train_answer_gbt, scored as a model that was read. A tree takes about six jobs, so there are fewer here than the operator's 200."""
    train, test = tr.split(_training_rows(s, d), "doc_id", 1)
    model, _ = boosting.train(train, _F, trees=trees, sampled=2)
    return test.select("doc_id", "class", F.round(sc.forest_score(model), 4).alias("score"))


def train_class_cv(s: SparkSession, d: str) -> DataFrame:
    """Ten folds of a multinomial model of a document's language."""
    rows = _training_rows(s, d).join(table(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("kind")), "doc_id")
    return tr.cross_validated(rows, _F, "doc_id", "kind").select("fold", "n", F.round("accuracy", 4).alias("accuracy"))


_USER = ["f_n", "f_value", "f_spread", "f_most"]


def _users(s: SparkSession, d: str) -> DataFrame:
    """Users as questions, the types of their events as paths."""
    value = F.coalesce(F.col("value"), F.lit(0.0))
    return table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"), F.log1p(F.count(F.lit(1)).cast("double")).alias("f_n"), F.avg(value).alias("f_value"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("f_spread"), F.max(value).alias("f_most"))


def train_path_ovr(s: SparkSession, d: str) -> DataFrame:
    """A sparse logistic for every event type that a user may have, all in one descent."""
    models = ml.train(_users(s, d), _USER).by_label()
    return s.createDataFrame([(c, f, round(v, 4)) for c, m in models.items() for f, v in m.items()], "path string, feature string, weight double")


def path_model_measures(s: SparkSession, d: str) -> DataFrame:
    """Recall of any and of all paths, precision and reciprocal rank of the path models on users that they were not trained on."""
    users = _users(s, d)
    train, test = tr.split(users, "user_id", 1)
    said = ml.ranked(test, ml.train(train, _USER), ["user_id"])
    gold = test.select(F.col("user_id").alias("qid"), F.explode("labels").alias("path"))
    measures = tr.path_measures(said.select(F.col("user_id").alias("qid"), "path", "rank"), gold)
    return measures.select(*[F.round(c, 4).alias(c) for c in ("any_recall", "all_recall", "path_precision", "mrr")])


_LINKED = "linked AS (SELECT l_orderkey AS qid, p_type AS clue, p_name AS label, p_partkey AS entity, max(round(l_quantity / 50, 4)) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_RANKS = """top AS (SELECT * FROM (SELECT *, 1 / row_number() OVER (PARTITION BY qid, clue ORDER BY score DESC, entity) AS source_rr FROM {src}) WHERE source_rr >= 0.2),
lab AS (SELECT qid, label, 1 / row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS label_rr FROM (SELECT qid, label, max(score) AS s FROM top GROUP BY ALL)), ranks AS (SELECT top.*, label_rr FROM top JOIN lab ON top.qid = lab.qid AND top.label = lab.label)"""
_LOOK = """f AS (SELECT p_partkey AS entity, p_size % 4 AS dist FROM part WHERE p_size <= 30), c AS (SELECT p_partkey AS entity, p_size / sum(p_size) OVER (PARTITION BY p_type) AS prob FROM part WHERE p_size >= 20),
m AS (SELECT coalesce(f.entity, c.entity) AS entity, coalesce(dist, 0) AS dist, coalesce(prob, 0) AS prob, f.entity IS NOT NULL AS by_fuzzy, c.entity IS NOT NULL AS by_cross FROM f FULL JOIN c ON f.entity = c.entity)"""
_NAMES = "names AS (SELECT p_name AS name, 'e' || min(p_partkey) AS entity FROM part GROUP BY p_name)"
_EV = "ev AS (SELECT user_id AS qid, event_id AS seq, CASE event_type WHEN 'view' THEN 'asked' WHEN 'click' THEN 'in progress' ELSE 'answered' END AS state, value FROM events WHERE event_type IN ('view', 'click', 'purchase'))"
_UP = """up AS (SELECT n_nationkey + 100 AS synset, n_regionkey + 10 AS up_synset, lower(r_name) AS up_text FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 10, 1, 'location' FROM region)"""
_ONE = "SELECT o_orderkey AS qid, 'order:' || o_orderkey AS resource, 'customer' AS property, 'customer:' || o_custkey AS value, 0.5::DOUBLE AS score FROM orders"
_TWO = "SELECT o_orderkey AS qid, 'order:' || o_orderkey AS resource, 'customer: nation' AS property, 'nation:' || c_nationkey AS value, 0.5::DOUBLE AS score FROM orders JOIN customer ON o_custkey = c_custkey"
QUERIES = {
    "bgp_join": Query(bgp_join, "SELECT 'customer:' || c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "popularity": Query(popularity, f"WITH {TRIPLES_SQL} SELECT resource, round(ln(count(*)), 6) AS log_popularity FROM (SELECT s AS resource FROM triples UNION ALL SELECT o FROM triples WHERE o_is_uri) GROUP BY resource"),
    "article_resolution": Query(article_resolution, f"""WITH {_WIKI_SQL}, n AS (SELECT s, o AS title FROM wiki WHERE p = 'label'), r AS (SELECT s, o FROM wiki WHERE p = 'redirect'), m AS (SELECT s, o FROM wiki WHERE p = 'means'),
      x AS (SELECT title, s AS article, 'direct' AS how FROM n UNION SELECT title, r.o, 'redirect' FROM n JOIN r USING (s) UNION SELECT title, m.o, 'disambiguation' FROM n JOIN m USING (s) UNION SELECT title, m.o, 'redirect disambiguation' FROM n JOIN r USING (s) JOIN m ON m.s = r.o)
      SELECT title, article, how, pg.o AS page_id, c.o AS comment FROM x JOIN wiki pg ON pg.s = article AND pg.p = 'page' LEFT JOIN wiki c ON c.s = article AND c.p = 'comment' WHERE article NOT IN (SELECT s FROM r) AND article NOT IN (SELECT s FROM m)"""),
    "types_most_specific": Query(types_most_specific, "SELECT p_partkey AS resource, p_type || '/' || p_brand AS type FROM part UNION ALL SELECT p_partkey, p_type FROM part WHERE p_type = 'ECONOMY' "),
    "props_ontology": Query(props_ontology, "SELECT 'customer:' || c_custkey AS resource, 'nation' AS property, n_name AS value, 'nation:' || c_nationkey AS value_resource FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'customer:' || c_custkey, 'label', c_name, NULL FROM customer"),
    "props_generic_limit": Query(props_generic_limit, f"WITH {TRIPLES_SQL}, b AS (SELECT o AS resource, 'of ' || p AS property, s AS value FROM triples WHERE o_is_uri AND o LIKE 'nation:%') SELECT resource, property, value FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY property, value) AS i FROM b) WHERE i <= 40"),
    "path_one_hop": Query(path_one_hop, _ONE),
    "path_two_hop": Query(path_two_hop, _TWO),
    "path_witness": Query(path_witness, "SELECT o_orderkey AS qid, 'order:' || o_orderkey AS resource, 'customer: segment' AS property, c_mktsegment AS value, 0.5::DOUBLE AS score, lower(n_name) AS witness, unnest(['id', 'label']) AS \"by\" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "path_top15": Query(path_top15, """WITH f AS (SELECT DISTINCT l_orderkey AS qid, unnest(['f' || l_returnflag, 'n' || l_linenumber]) AS feature FROM lineitem), w AS (SELECT p_brand AS path, 'n' || (p_size % 7 + 1) AS feature, round(avg(p_retailprice) / 2000, 3) AS weight FROM part GROUP BY ALL),
      z AS (SELECT qid, path, round(1 / (1 + exp(-(sum(weight) - 1))), 6) AS score FROM f JOIN w USING (feature) GROUP BY qid, path) SELECT qid, path, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS i FROM z) WHERE i <= 15"""),
    "property_answers": Query(property_answers, f"SELECT qid, value AS text, value AS canon_text, 1 AS occurences, round(ln(2), 6) AS resultLogScore, score AS propertyScore, 1.0::DOUBLE AS originDBpOntology, property AS lat_text FROM ({_TWO})"),
    "clue_in_property": Query(clue_in_property, f"WITH v AS ({_TWO} UNION ALL {_ONE}), x AS (SELECT v.*, CASE WHEN o_orderstatus = 'F' AND property LIKE '%nation%' THEN 1 ELSE 0 END AS n FROM v JOIN orders ON qid = o_orderkey) SELECT qid, property, value, CAST(n AS BIGINT) AS n_clues, CASE WHEN n = 0 THEN -1.0::DOUBLE END AS originDBpONoClue FROM x"),
    "concept_rr": Query(concept_rr, f"WITH {_LINKED}, {_RANKS.format(src='linked')} SELECT qid, clue, label, entity, score, round(source_rr, 6) AS source_rr, round(label_rr, 6) AS label_rr FROM ranks"),
    "concept_top5": Query(concept_top5, f"WITH {_LINKED} SELECT qid, clue, label, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) AS i FROM linked) WHERE i <= 5"),
    "concept_logistic": Query(concept_logistic, "SELECT p_partkey, round(1 / (1 + exp(-(-6.556334 + 0.008670 * (p_size % 4) + 4.447859 * p_size / 50 + 0.506590 * ln(p_retailprice) + 4.145722 * 0.5 + 0.500504 * (p_size % 2) + 0.270530 + 0.837017 - 1.686557 * CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END))), 6) AS score FROM part"),
    "concept_features": Query(concept_features, f"""WITH {_LINKED}, strong AS (SELECT * FROM linked WHERE score > 0.3), {_RANKS.format(src="strong")}, b AS (SELECT qid, label, max(source_rr) AS a, max(label_rr) AS b, max(score) AS c FROM ranks GROUP BY ALL), t AS (SELECT DISTINCT qid, label FROM linked)
      SELECT t.qid, upper(t.label) AS text, CASE WHEN c IS NOT NULL THEN 1.0::DOUBLE END AS originConcept, round(a, 6) AS originConceptSourceRR, round(b, 6) AS originConceptLabelRR, round(c, 6) AS originConceptScore FROM t LEFT JOIN b ON t.qid = b.qid AND t.label = b.label"""),
    "question_class_argmax": Query(question_class_argmax, """WITH k AS (SELECT DISTINCT o_orderpriority AS f, 'C' || o_orderpriority[1] AS class FROM orders), z AS (SELECT o_orderkey AS qid, class, round(1 / (1 + exp(-(CASE WHEN f = o_orderpriority THEN 1.5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' AND class IN ('C1', 'C2') THEN 2.0 ELSE 0 END - CAST(class[2] AS DOUBLE) / 10))), 6) AS prob FROM orders, k)
      SELECT qid, class, prob FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prob DESC, class) AS i FROM z) WHERE i = 1"""),
    "entity_link_exact": Query(entity_link_exact, f"WITH {_NAMES} SELECT p_partkey, upper(p_name) AS label, entity FROM part JOIN names ON p_name = name"),
    "entity_link_fuzzy": Query(entity_link_fuzzy, f"""WITH {_NAMES}, q AS (SELECT entity AS qid, 'x' || substr(name, 3) AS label FROM names), h AS (SELECT qid, label, name, n.entity, CAST(levenshtein(lower(label), lower(name)) AS INTEGER) AS dist FROM q JOIN names n ON levenshtein(lower(label), lower(name)) <= 3)
      SELECT qid, label, name, entity, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY dist, name, entity) AS i FROM h) WHERE dist = 0 OR i = 1"""),
    "entity_link_short": Query(entity_link_short, """WITH n AS (SELECT substr(n_name, 6) AS name, 'nation:' || n_nationkey AS entity FROM nation), q AS (SELECT n_nationkey AS qid, substr(n_name, 7) AS label FROM nation),
      h AS (SELECT qid, label, name, entity, CAST(levenshtein(lower(label), lower(name)) AS INTEGER) AS dist FROM q JOIN n ON levenshtein(lower(label), lower(name)) <= 3
        AND len(list_filter(range(1, length(label) + 1), lambda i: contains(substr(lower(name), greatest(i - 3, 1), i + 3 - greatest(i - 3, 1) + 1), substr(lower(label), i, 1)))) > 0)
      SELECT qid, label, name, entity, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY dist, name, entity) AS i FROM h) WHERE dist = 0 OR i = 1"""),
    "entity_linking": Query(entity_linking, f"""WITH {TRIPLES_SQL}, names AS (SELECT p_name AS name, 'part:' || min(p_partkey) AS entity FROM part GROUP BY p_name),
      cl AS (SELECT entity AS qid, 'Token' AS t, name AS label FROM names UNION ALL SELECT entity, 'Ngram', 'x' || substr(name, 3) FROM names UNION ALL SELECT entity, 'NE', 'y' || substr(name, 3) FROM names),
      h AS (SELECT qid, t, label, name, n.entity, CAST(levenshtein(lower(label), lower(name)) AS INTEGER) AS dist FROM cl JOIN names n ON levenshtein(lower(label), lower(name)) <= 3),
      f AS (SELECT qid, label, entity, min(dist) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY dist, name, entity) AS i FROM h) WHERE (dist = 0 OR i = 1) AND (t <> 'Ngram' OR dist = 0) GROUP BY ALL),
      c AS (SELECT p_name AS label, 'part:' || p_partkey AS entity, p_size / sum(p_size) OVER (PARTITION BY p_name) AS prob FROM part), w AS (SELECT qid, label, entity, max(prob) AS prob FROM (SELECT DISTINCT qid, label FROM cl) JOIN c USING (label) GROUP BY ALL),
      b AS (SELECT coalesce(f.qid, w.qid) AS qid, coalesce(f.label, w.label) AS label, coalesce(f.entity, w.entity) AS entity, coalesce(dist, 0) AS edit_dist, coalesce(prob, 0) AS prob, f.qid IS NOT NULL AS by_fuzzy, w.qid IS NOT NULL AS by_cross FROM f FULL JOIN w ON f.qid = w.qid AND f.label = w.label AND f.entity = w.entity),
      pop AS (SELECT resource, ln(count(*)) AS p FROM (SELECT s AS resource FROM triples UNION ALL SELECT o FROM triples WHERE o_is_uri) GROUP BY resource), z AS (SELECT b.*, round(prob * 4 + coalesce(p, 0) / 2 - edit_dist, 6) AS score FROM b LEFT JOIN pop ON resource = entity)
      SELECT qid, label, entity, edit_dist, by_fuzzy, by_cross, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, entity) AS i FROM z) WHERE i <= 5"""),
    "path_union": Query(path_union, """SELECT o_orderkey AS qid, 'order:' || o_orderkey AS resource, 'customer' AS property, 'customer:' || o_custkey AS value, 0.9::DOUBLE AS score FROM orders
      UNION ALL SELECT o_orderkey, 'order:' || o_orderkey, 'customer: nation', 'nation:' || c_nationkey, 0.7 FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT o_orderkey, 'order:' || o_orderkey, 'customer: segment', c_mktsegment, 0.5 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 1 OR contains(lower(n_name), 'nation_2')"""),
    "topic_lookup": Query(topic_lookup, """WITH x AS (SELECT n_nationkey AS qid, n_name AS title, 'customer:' || c_custkey AS topic FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT a.c_custkey, a.c_name, 'customer:' || b.c_custkey FROM customer a JOIN customer b ON a.c_name = b.c_name)
      SELECT qid, title, topic FROM (SELECT *, row_number() OVER (PARTITION BY qid, title ORDER BY topic) AS i FROM x) WHERE i <= 5"""),
    "source_bindings": Query(source_bindings, f"SELECT qid, property, value, CASE WHEN property LIKE '%nation%' THEN 1.0::DOUBLE END AS originDBpOntology, CASE WHEN property = 'customer' THEN 1.0::DOUBLE END AS originFreebaseOntology FROM ({_ONE} UNION ALL {_TWO})"),
    "lookup_merge": Query(lookup_merge, f"WITH {_LOOK} SELECT entity, dist, round(prob, 8) AS prob, by_fuzzy, by_cross FROM m"),
    "pageid_dedup": Query(pageid_dedup, f"WITH {_LOOK}, x AS (SELECT m.*, p_name AS name, CAST(entity % 97 AS BIGINT) AS page_id FROM m JOIN part ON entity = p_partkey) SELECT page_id, first(name ORDER BY dist, name) AS name, min(dist) AS dist, round(max(prob), 8) AS prob, bool_or(by_fuzzy) AS by_fuzzy, bool_or(by_cross) AS by_cross FROM x GROUP BY page_id"),
    "bilinear_relatedness": Query(bilinear_relatedness, """WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)
      SELECT vec_id, round(1 / (1 + exp(-(sum(m * x * (1 + (e.i - 1) % 3) / 2) - 0.25))), 4) AS score FROM e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY vec_id"""),
    "clue_overlap_cases": Query(clue_overlap_cases, _OVERLAP_SQL),
    "lat_closure": Query(lat_closure, f"""WITH RECURSIVE {_UP}, l AS (SELECT c_custkey AS qid, lower(n_name) AS lat_text, n_nationkey + 100 AS synset FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT qid, lat_text, synset, 0 AS level FROM l UNION ALL SELECT qid, up_text, up_synset, level + 1 FROM w JOIN up ON w.synset = up.synset)
      SELECT qid, lat_text, CAST(synset AS BIGINT) AS synset, CAST(-level AS DOUBLE) AS specificity, CASE WHEN level = 0 THEN 'NE' ELSE 'Wordnet' END AS lat_type FROM w"""),
    "tycor_match": Query(tycor_match, f"""WITH RECURSIVE {_UP}, q0 AS (SELECT c_custkey AS qid, n_nationkey + 100 AS synset, 0 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey), q AS (SELECT * FROM q0 UNION ALL SELECT qid, up_synset, level + 1 FROM q JOIN up ON q.synset = up.synset),
      a0 AS (SELECT unnest([s_suppkey, s_suppkey * 2, s_suppkey * 3]) AS qid, s_name AS text, s_nationkey + 100 AS synset, 0 AS level FROM supplier), a AS (SELECT * FROM a0 UNION ALL SELECT qid, text, up_synset, level + 1 FROM a JOIN up ON a.synset = up.synset),
      m AS (SELECT a.qid, text, q.level + a.level AS level, q.level AS ql, a.level AS al FROM a JOIN q ON a.qid = q.qid AND a.synset = q.synset), k AS (SELECT DISTINCT qid, text FROM a0), h AS (SELECT qid, text, min(level) AS l, max(CASE WHEN ql = 0 THEN 1.0::DOUBLE END) AS qh, max(CASE WHEN al = 0 THEN 1.0::DOUBLE END) AS ah, max(CASE WHEN ql = 0 AND al = 0 THEN 1.0::DOUBLE END) AS qa FROM m GROUP BY qid, text)
      SELECT k.qid, k.text, round(exp(-l), 6) AS spWordNet, qh AS tyCorSpQHit, ah AS tyCorSpAHit, qa AS tyCorSpQAHit, coalesce(qh, ah) AS tyCorAWnInstance, CASE WHEN l IS NULL AND k.qid IN (SELECT qid FROM q) THEN -1.0::DOUBLE END AS noTyCor, CAST(NULL AS DOUBLE) AS LATANone FROM k LEFT JOIN h ON k.qid = h.qid AND k.text = h.text"""),
    "quantity_lat": Query(quantity_lat, """WITH r AS (SELECT p_partkey AS qid, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5e1' ELSE p_name END AS text FROM part), k(lat_text, synset) AS (VALUES ('measure', 33914), ('magnitude relation', 13815152), ('magnitude', 5097645))
      SELECT qid, text, lat_text, CAST(synset AS BIGINT) AS synset, 0.0::DOUBLE AS specificity, 'QuantityCD' AS lat_type FROM r, k WHERE TRY_CAST(text AS DOUBLE) IS NOT NULL"""),
    "lifecycle_last_state": Query(lifecycle_last_state, f"WITH {_EV} SELECT qid, arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS n_events FROM ev GROUP BY qid"),
    "lifecycle_recent": Query(lifecycle_recent, f"WITH {_EV}, l AS (SELECT qid, arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS n_events FROM ev GROUP BY qid) SELECT * FROM l WHERE state = 'answered' ORDER BY seq DESC, qid LIMIT 6"),
    "lifecycle_answers": Query(lifecycle_answers, f"WITH {_EV}, g AS (SELECT qid, count(*) AS generation FROM ev GROUP BY qid) SELECT ev.qid, state AS text, arg_max(value, seq) AS confidence, max(seq) AS seq, any_value(generation) AS generation FROM ev JOIN g ON ev.qid = g.qid GROUP BY ev.qid, state"),
    "live_answers": Query(live_answers, f"WITH {_EV}, g AS (SELECT qid, arg_max(state, seq) AS state, count(*) AS generation, qid % 2 = 0 AND count(DISTINCT state) = 3 AS complete FROM ev GROUP BY qid) SELECT ev.qid, ev.state AS text, arg_max(value, seq) AS confidence, max(seq) AS seq, any_value(g.state) AS state, any_value(generation) AS generation, any_value(complete) AS complete FROM ev JOIN g ON ev.qid = g.qid GROUP BY ev.qid, ev.state"),
    "source_dedup": Query(source_dedup, f"WITH {_EV}, x AS (SELECT qid, 'web' AS type, state AS origin, 't' || (seq % 3) AS title, 'u' AS url, min(seq) AS first, max(seq % 3) AS state FROM ev GROUP BY qid, ev.state, seq % 3) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY first, type, origin, title, url) - 1 AS INTEGER) AS source_id FROM x"),
    "answer_sentence": Query(answer_sentence, """WITH r AS (SELECT o_custkey AS qid, o_orderstatus AS answer, c_name AS source, o_orderkey % 2 = 0 AS b, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS w, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey % 3 = 0 DESC, o_orderkey DESC) AS i FROM orders JOIN customer ON o_custkey = c_custkey)
      SELECT qid, answer, source || CASE WHEN b THEN ' is filled by ' ELSE ' has status ' END || coalesce('(for ' || w || ') ', '') || CASE WHEN b THEN '' ELSE 'is ' END || answer || '.' AS sentence FROM r WHERE i = 1"""),
    "tree_edit_distance": Query(tree_edit_distance),
    "train_passage_lr": Query(train_passage_lr),
    "train_answer_gbt": Query(train_answer_gbt),
    "train_answer_boosted": Query(train_answer_boosted),
    "train_class_cv": Query(train_class_cv),
    "train_path_ovr": Query(train_path_ovr),
    "path_model_measures": Query(path_model_measures),
}
