"""Queries of the hitlist algebra, scoring and evaluation, over line items as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stages
from ..operators import evaluation as ev
from ..operators import hitlist as hl
from ..operators import scoring as sc
from .base import HITS_SQL, Query, hits, table

FS = ["f1", "f2", "f3"]
_MERGE = ", ".join(f"CASE WHEN max({f}) >= 0 OR count({f}) = count(*) THEN max({f}) END AS {f}" for f in FS)


def fv_merge(s: SparkSession, d: str) -> DataFrame:
    return hl.merge_vectors(hits(s, d), ["qid", "text"], FS)


def hitlist_merge(s: SparkSession, d: str) -> DataFrame:
    rows = hits(s, d).withColumn("o1", F.when(F.col("flag") == "R", 1.0)).withColumn("o2", F.when(F.col("line") > 2, 1.0))
    return hl.merge_hitlist(rows, [*FS, "o1", "o2"], ["o1", "o2"], more=[F.max("confidence").alias("confidence")])


def hitlist_overlay(s: SparkSession, d: str) -> DataFrame:
    best = hits(s, d).groupBy("qid", "text").agg(F.max("confidence").alias("confidence"), F.max("f1").alias("f1"))
    new = hits(s, d).filter("flag = 'R'").groupBy("qid", "text").agg((F.min("confidence") + 1).alias("confidence"), F.min("f1").alias("f1"))
    return hl.overlay(best.filter("f1 > 10"), new, ["qid", "text"], ["confidence", "f1"])


def hitlist_topk(s: SparkSession, d: str) -> DataFrame:
    rows = hits(s, d).groupBy("qid", "text").agg(F.max("confidence").alias("confidence"))
    return hl.ranked(rows).filter("rank <= 3").select("qid", "text", "confidence", "rank")


def text_merge(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("text"), "p_name")
    rows = hits(s, d).groupBy("qid", "text").agg(F.max("confidence").alias("confidence"), F.lit(1).alias("occurences"), F.max("f2").alias("f2")).join(names, "text")
    return hl.merge_by_canonical_text(rows, F.col("p_name"), ["f2"])


def _forms(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("p_partkey"), "l_quantity")
    # names are shuffled once, before they become forms
    named = stages.dealt(li.join(p, "p_partkey").drop("p_partkey"), li.count(), "qid")
    form = F.explode(F.array(F.col("p_name"), F.concat("p_type", F.lit(", "), "p_name"), F.concat("p_name", F.lit(" - "), "p_brand")))
    return named.select("qid", "l_quantity", form.alias("text")).groupBy("qid", "text").agg((F.max("l_quantity") / 64).alias("confidence"))


#: Of these forms none lies inside another, so the last two cases don't arise.
_FORMS_SQL = """forms AS (
  SELECT l_orderkey AS qid, form AS text, max(l_quantity) / 64 AS confidence FROM lineitem JOIN (
    SELECT p_partkey, unnest([p_name, p_type || ', ' || p_name, p_name || ' - ' || p_brand]) AS form FROM part) ON l_partkey = p_partkey GROUP BY ALL),
pairs AS (
  SELECT a.qid, a.text, b.text AS other, b.confidence AS oc, CASE
    WHEN starts_with(a.text, b.text) AND regexp_matches(substr(a.text, length(b.text) + 1), '^\\s*[.,:;()–-]\\s*') THEN 'prefixed'
    WHEN starts_with(b.text, a.text) AND regexp_matches(substr(b.text, length(a.text) + 1), '^\\s*[.,:;()–-]\\s*') THEN 'prefixing'
    WHEN ends_with(a.text, b.text) AND regexp_matches(left(a.text, length(a.text) - length(b.text)), '\\s*[.,:;()–-]\\s*$') THEN 'suffixed'
    WHEN ends_with(b.text, a.text) AND regexp_matches(left(b.text, length(b.text) - length(a.text)), '\\s*[.,:;()–-]\\s*$') THEN 'suffixing' END AS c
  FROM forms a JOIN forms b ON a.qid = b.qid AND a.text <> b.text AND (contains(a.text, b.text) OR contains(b.text, a.text)))""".replace("\\\\", "\\")


def _diffusion(policy: str, every: bool) -> Query:
    where = "c IS NOT NULL" if every else "c IS NOT NULL AND c NOT IN ('prefixing', 'suffixed')"
    value = {"sum": "sum(oc)", "max": "max(oc)", "decay": "sum(oc / pow(2, i))"}[policy]
    sql = f"""WITH {_FORMS_SQL}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY qid, text, c ORDER BY oc DESC, other) - 1 AS i FROM pairs WHERE {where})
    SELECT qid, text, c AS "case", round({value}, 4) AS score FROM placed GROUP BY qid, text, c"""
    return Query(lambda s, d: hl.diffuse(_forms(s, d), policy, every).withColumn("score", F.round("score", 4)), sql)


def hitlist_zscore(s: SparkSession, d: str) -> DataFrame:
    out = hl.expanded(hits(s, d), FS)
    return out.select("qid", "text", "line", *[F.round(F.col(f"`{m}{f}`"), 4).alias(f"{n}_{f}") for f in FS for m, n in zip("@%!", "vzu", strict=True)])


_EXPAND_SQL = HITS_SQL + ", stats AS (SELECT *, " + ", ".join(f"avg(coalesce({f}, 0)) OVER w AS m_{f}, stddev_pop(coalesce({f}, 0)) OVER w AS s_{f}" for f in FS) + " FROM hits WINDOW w AS (PARTITION BY qid))"
_COLUMNS = {f: (f"coalesce({f}, 0.0)", f"CASE WHEN s_{f} = 0 THEN 0.0 ELSE (coalesce({f}, 0) - m_{f}) / s_{f} END", f"CASE WHEN {f} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END") for f in FS}
_WEIGHTS, _INTERCEPT = {"f1": (0.02, 0.5, 0.0), "f2": (-3.0, 0.25, 0.0), "f3": (4.0, -0.5, 0.75)}, -1.0


def score_logistic(s: SparkSession, d: str) -> DataFrame:
    out = hl.expanded(hits(s, d), FS)
    return out.select("qid", "text", "line", F.round(sc.logistic_score(_WEIGHTS, _INTERCEPT), 4).alias("score"))


_LOGISTIC_SQL = " + ".join(f"({e}) * ({w})" for f in FS for e, w in zip(_COLUMNS[f], _WEIGHTS[f], strict=True))
_FOREST = {
    "prior": -0.5, "learning_rate": 0.5, "labels": ["f1", "f2", "f3"],
    "forest": [
        {"children_left": [1, -1, 3, -1, -1], "children_right": [2, -1, 4, -1, -1], "features": [0, 0, 2, 0, 0], "thresholds": [25.0, 0, 0.04, 0, 0], "values": [0, -1.0, 0, 0.5, 2.0]},
        {"children_left": [1, -1, -1], "children_right": [2, -1, -1], "features": [1, 0, 0], "thresholds": [0.01, 0, 0], "values": [0, 0.25, -0.75]},
    ],
}


def score_forest(s: SparkSession, d: str) -> DataFrame:
    return hits(s, d).select("qid", "text", "line", F.round(sc.forest_score(_FOREST), 4).alias("score"))


def _simple_rows(s: SparkSession, d: str) -> DataFrame:
    h = hits(s, d)
    return h.select("qid", "text", "line", "occurences", F.when(F.col("flag") != "N", F.exp(-F.col("line").cast("double") / 2)).alias("spWordNet"), F.when(F.col("f3").isNotNull(), F.log1p("f1")).alias("passageLogScore"), F.when(F.col("flag") == "A", 1.0).alias("originDocTitle"), F.when(F.col("flag") == "R", 1.0).alias("originPsgNE"), F.log1p("confidence").alias("resultLogScore"))


def score_simple(s: SparkSession, d: str) -> DataFrame:
    return _simple_rows(s, d).select("qid", "text", "line", F.round(sc.simple_score(), 4).alias("score"))


def score_carry(s: SparkSession, d: str) -> DataFrame:
    rows = sc.carry_over(hits(s, d), "")
    return hl.merge_vectors(rows, ["qid", "text"], ["phase0Score"])


def reference_answer(s: SparkSession, d: str) -> DataFrame:
    return ev.reference_answers(_forms(s, d), F.contains("text", F.lit("widget")))


def _run(s: SparkSession, d: str, flag: str = "R", weight: str = "confidence") -> DataFrame:
    """A run: rank of the first returned item of each order, by falling price."""
    h = hits(s, d).groupBy("qid", "text").agg(F.max(weight).alias("confidence"), F.max((F.col("flag") == flag).cast("int")).alias("ok"))
    r = hl.ranked(h)
    return r.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("ok") == 1, F.col("rank") - 1)), F.lit(-1)).alias("rank"), F.round(F.max(F.when(F.col("ok") == 1, F.col("confidence")).otherwise(0.0)), 4).alias("score"))


def _run_sql(name: str, flag: str = "R", weight: str = "confidence") -> str:
    return f"""{name} AS (SELECT qid, coalesce(min(CASE WHEN ok = 1 THEN rk - 1 END), -1) AS rank, round(max(CASE WHEN ok = 1 THEN c ELSE 0.0 END), 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, text) AS rk FROM (
        SELECT qid, text, max({weight}) AS c, max(CASE WHEN flag = '{flag}' THEN 1 ELSE 0 END) AS ok FROM hits GROUP BY qid, text)) GROUP BY qid)"""


def eval_accuracy_mrr(s: SparkSession, d: str) -> DataFrame:
    return ev.run_statistics(_run(s, d)).select("n", "n_first", "n_found", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "mrr")])


def eval_compare(s: SparkSession, d: str) -> DataFrame:
    """The first run has the orders with a line that was returned or accepted, the second those with a line whose third feature is set."""
    known, set_ = hits(s, d).filter("flag <> 'N'").select("qid"), hits(s, d).filter("f3 IS NOT NULL").select("qid")
    a, b = _run(s, d).join(known, "qid", "left_semi"), _run(s, d, "A", "f1").withColumn("score", F.round(F.col("score") / 50, 4)).join(set_, "qid", "left_semi")
    return ev.compare_runs(a, b).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("score_b") - F.col("score_a")), 2).alias("change"))


def eval_rank_curve(s: SparkSession, d: str) -> DataFrame:
    return ev.rank_curve(_run(s, d), 500).select("place", F.col("rank").cast("int").alias("rank"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return hits(s, d).select("qid", F.col("f1").alias("score"), (F.col("flag") == "R").cast("int").alias("correct"))


def eval_pr_roc(s: SparkSession, d: str) -> DataFrame:
    out = ev.precision_recall(_scored(s, d))
    return out.select("score", "n_correct", "n_taken", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fp_rate")])


def _long(s: SparkSession, d: str, line: str = "line > 0") -> DataFrame:
    # dealt by question, so that answers, features and questions are counted without another shuffle
    own = stages.dealt(hits(s, d).filter(line).select("qid", "text", "flag", *FS), table(s, d, "lineitem").count(), "qid")
    h = own.withColumn("correct", (F.col("flag") == "R").cast("int")).groupBy("qid", "text").agg(F.max("correct").alias("correct"), *[F.max(f).alias(f) for f in FS])
    return h.select("qid", F.col("text").alias("answer"), "correct", F.explode(F.create_map(*[x for f in FS for x in (F.lit(f), F.col(f))])).alias("feature", "value")).filter("value IS NOT NULL AND value > 0")


_LONG_SQL = """{n} AS (SELECT qid, answer, correct, feature, value FROM (
  SELECT qid, text AS answer, max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS correct, max(f1) AS f1, max(f2) AS f2, max(f3) AS f3 FROM hits WHERE {w} GROUP BY qid, text)
  UNPIVOT (value FOR feature IN (f1, f2, f3)) WHERE value > 0)"""


def eval_feature_stats(s: SparkSession, d: str) -> DataFrame:
    out = ev.feature_statistics(_long(s, d))
    return out.select("feature", "n_questions", "n_answers", "n_correct", *[F.round(c, 6).alias(c) for c in ("question_share", "answer_share", "lift")], "kind")


def eval_feature_diff(s: SparkSession, d: str) -> DataFrame:
    a, b = _long(s, d), _long(s, d, "line > 1")
    return ev.feature_difference(a.drop("correct"), b.drop("correct")).select("qid", "answer", "feature", "value_a", "value_b")


def eval_anygood_ties(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).withColumn("score", F.round(F.col("score") / 10) / 5)
    out = ev.answer_metrics(rows, k=2)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_MET_SQL = f"""WITH {HITS_SQL}, r AS (SELECT qid, round(f1 / 10) / 5 AS score, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS correct FROM hits),
p AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY score DESC) - 1 + (count(*) OVER (PARTITION BY qid, score) - 1) / 2.0 AS place FROM r),
q AS (SELECT qid, min(CASE WHEN correct = 1 THEN place END) AS best, count(*) AS n, count(*) FILTER (score >= 0.5 AND correct = 1) AS tp, count(*) FILTER (score >= 0.5 AND correct = 0) AS fp, count(*) FILTER (score < 0.5 AND correct = 1) AS fn FROM p GROUP BY qid)
SELECT round((sum(n) - sum(fp) - sum(fn)) / sum(n), 6) AS accuracy, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS "precision", round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1,
round(avg(CASE WHEN best < 2 THEN 1.0 ELSE 0.0 END), 6) AS any_good, round(avg(coalesce(1 / (1 + best), 0.0)), 6) AS mrr, round(avg(CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS available FROM q"""

_TREE = "CASE WHEN coalesce(f1, 0) <= 25 THEN -1.0 WHEN coalesce(f3, 0) <= 0.04 THEN 0.5 ELSE 2.0 END + CASE WHEN coalesce(f2, 0) <= 0.01 THEN 0.25 ELSE -0.75 END"
QUERIES = {
    "fv_merge": Query(fv_merge, f"WITH {HITS_SQL} SELECT qid, text, CAST(sum(occurences) AS BIGINT) AS occurences, {_MERGE} FROM hits GROUP BY qid, text"),
    "hitlist_merge": Query(hitlist_merge, f"""WITH {HITS_SQL}, o AS (SELECT *, CASE WHEN flag = 'R' THEN 1.0::DOUBLE END AS o1, CASE WHEN line > 2 THEN 1.0::DOUBLE END AS o2 FROM hits)
      SELECT qid, text, CAST(sum(occurences) AS BIGINT) AS occurences, {_MERGE}, max(o1) AS o1, max(o2) AS o2, max(confidence) AS confidence, CASE WHEN coalesce(max(o1), 0) + coalesce(max(o2), 0) > 1 THEN 1.0::DOUBLE END AS originMultiple FROM o GROUP BY qid, text"""),
    "hitlist_overlay": Query(hitlist_overlay, f"""WITH {HITS_SQL}, a AS (SELECT qid, text, max(confidence) AS confidence, max(f1) AS f1 FROM hits GROUP BY qid, text HAVING max(f1) > 10),
      b AS (SELECT qid, text, min(confidence) + 1 AS confidence, min(f1) AS f1 FROM hits WHERE flag = 'R' GROUP BY qid, text)
      SELECT coalesce(b.qid, a.qid) AS qid, coalesce(b.text, a.text) AS text, coalesce(b.confidence, a.confidence) AS confidence, coalesce(b.f1, a.f1) AS f1 FROM a FULL JOIN b ON a.qid = b.qid AND a.text = b.text"""),
    "hitlist_topk": Query(hitlist_topk, f"""WITH {HITS_SQL}, m AS (SELECT qid, text, max(confidence) AS c FROM hits GROUP BY qid, text), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY c DESC, text) AS INTEGER) AS rank FROM m)
      SELECT qid, text, c AS confidence, rank FROM r WHERE rank <= 3"""),
    "text_merge": Query(text_merge, f"""WITH {HITS_SQL}, m AS (SELECT qid, text, max(confidence) AS c, max(f2) AS f2 FROM hits GROUP BY qid, text),
      r AS (SELECT m.*, p_name AS canon_text, row_number() OVER (PARTITION BY qid ORDER BY c DESC, text) AS rk FROM m JOIN part ON text = 'p' || p_partkey)
      SELECT qid, canon_text, count(*) AS occurences, CASE WHEN max(f2) >= 0 OR count(f2) = count(*) THEN max(f2) END AS f2, arg_min(text, rk) AS text, max(c) AS confidence FROM r GROUP BY qid, canon_text"""),
    "evidence_diffusion_sum": _diffusion("sum", False),
    "evidence_diffusion_decay": _diffusion("decay", False),
    "evidence_diffusion_max": _diffusion("max", True),
    "hitlist_zscore": Query(hitlist_zscore, f"WITH {_EXPAND_SQL} SELECT qid, text, line, " + ", ".join(f"round({e}, 4) AS {n}_{f}" for f in FS for e, n in zip(_COLUMNS[f], "vzu", strict=True)) + " FROM stats"),
    "score_logistic": Query(score_logistic, f"WITH {_EXPAND_SQL} SELECT qid, text, line, round(1 / (1 + exp(-(({_LOGISTIC_SQL}) + ({_INTERCEPT})))), 4) AS score FROM stats"),
    "score_forest": Query(score_forest, f"WITH {HITS_SQL} SELECT qid, text, line, round(1 / (1 + exp(-(-0.5 + 0.5 * ({_TREE})))), 4) AS score FROM hits"),
    "score_simple": Query(score_simple, f"""WITH {HITS_SQL} SELECT qid, text, line, round(CASE WHEN flag <> 'N' THEN exp(-line / 2.0) ELSE exp(-4) END * CASE WHEN flag = 'R' THEN exp(1) ELSE 1 END * occurences *
      CASE WHEN f3 IS NOT NULL THEN ln(1 + f1) WHEN flag = 'A' THEN ln(3) ELSE 0 END * ln(1 + confidence), 4) AS score FROM hits"""),
    "score_carry": Query(score_carry, f"WITH {HITS_SQL} SELECT qid, text, CAST(sum(occurences) AS BIGINT) AS occurences, max(confidence) AS phase0Score FROM hits GROUP BY qid, text"),
    "reference_answer": Query(reference_answer, f"""WITH {_FORMS_SQL}, m AS (SELECT * FROM forms WHERE contains(text, 'widget')), b AS (SELECT qid, first(text ORDER BY confidence DESC, text DESC) AS best FROM m GROUP BY qid)
      SELECT qid, best, text FROM (SELECT m.qid, best, text, row_number() OVER (PARTITION BY m.qid ORDER BY length(text), confidence DESC, text) AS i FROM m JOIN b ON m.qid = b.qid AND contains(best, text)) WHERE i = 1"""),
    "eval_accuracy_mrr": Query(eval_accuracy_mrr, f"""WITH {HITS_SQL}, {_run_sql("r")} SELECT count(*) AS n, count(*) FILTER (rank = 0) AS n_first, count(*) FILTER (rank >= 0) AS n_found, round(count(*) FILTER (rank = 0) / count(*), 6) AS accuracy,
      round(count(*) FILTER (rank >= 0) / count(*), 6) AS recall, round(avg(1 / (1 + CASE WHEN rank < 0 THEN 10000 ELSE rank END)), 6) AS mrr FROM r"""),
    "eval_compare": Query(eval_compare, f"""WITH {HITS_SQL}, {_run_sql("a0")}, {_run_sql("b0", "A", "f1")}, a AS (SELECT * FROM a0 WHERE qid IN (SELECT qid FROM hits WHERE flag <> 'N')), b AS (SELECT qid, rank, round(score / 50, 4) AS score FROM b0 WHERE qid IN (SELECT qid FROM hits WHERE f3 IS NOT NULL))
      SELECT CASE WHEN a.score IS NULL THEN 'only_b' WHEN b.score IS NULL THEN 'only_a' WHEN a.rank < 0 AND b.rank >= 0 THEN 'gained' WHEN a.rank >= 0 AND b.rank < 0 THEN 'lost'
        WHEN b.score - a.score > 0.05 THEN 'improved' WHEN b.score - a.score < -0.05 THEN 'worsened' ELSE 'same' END AS fate, count(*) AS n, round(sum(b.score - a.score), 2) AS change FROM a FULL JOIN b ON a.qid = b.qid GROUP BY 1"""),
    "eval_rank_curve": Query(eval_rank_curve, f"""WITH {HITS_SQL}, {_run_sql("r")}, o AS (SELECT row_number() OVER (ORDER BY rank) AS place, rank FROM r WHERE rank >= 0)
      SELECT CAST(i AS BIGINT) AS place, CAST(rank AS INTEGER) AS rank FROM range(1, 501) t(i) LEFT JOIN o ON o.place = i"""),
    "eval_pr_roc": Query(eval_pr_roc, f"""WITH {HITS_SQL}, p AS (SELECT f1 AS score, count(*) FILTER (flag = 'R') AS t, count(*) AS n FROM hits GROUP BY f1),
      c AS (SELECT score, CAST(sum(t) OVER w AS BIGINT) AS t, CAST(sum(n) OVER w AS BIGINT) AS n, sum(t) OVER () AS all_t, sum(n) OVER () AS all_n FROM p WINDOW w AS (ORDER BY score DESC))
      SELECT score, t AS n_correct, n AS n_taken, round(t / n, 6) AS "precision", round(t / all_t, 6) AS recall, round((n - t) / (all_n - all_t), 6) AS fp_rate FROM c"""),
    "eval_feature_stats": Query(eval_feature_stats, f"""WITH {HITS_SQL}, {_LONG_SQL.format(n="l", w="true")}, t AS (SELECT count(DISTINCT qid) AS q, count(*) AS a, sum(correct) AS c FROM (SELECT DISTINCT qid, answer, correct FROM l)),
      e AS (SELECT feature, count(DISTINCT qid) AS n_questions, count(*) AS n_answers, CAST(sum(correct) AS BIGINT) AS n_correct FROM l GROUP BY feature), x AS (SELECT e.*, n_questions / q AS qs, n_answers / a AS a_s, (n_correct / n_answers) / (c / a) AS li FROM e, t)
      SELECT feature, n_questions, n_answers, n_correct, round(qs, 6) AS question_share, round(a_s, 6) AS answer_share, round(li, 6) AS lift,
        CASE WHEN a_s < 0.001 AND qs < 0.01 THEN 'extremely rare' WHEN a_s < 0.01 THEN 'rare' WHEN abs(li - 1) <= 0.1 THEN 'poor predictor' ELSE 'useful' END AS kind FROM x"""),
    "eval_feature_diff": Query(eval_feature_diff, f"""WITH {HITS_SQL}, {_LONG_SQL.format(n="a", w="true")}, {_LONG_SQL.format(n="b", w="line > 1")}
      SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.answer, b.answer) AS answer, coalesce(a.feature, b.feature) AS feature, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b ON a.qid = b.qid AND a.answer = b.answer AND a.feature = b.feature
      WHERE a.value IS DISTINCT FROM b.value AND (coalesce(a.qid, b.qid), coalesce(a.answer, b.answer)) IN (SELECT (qid, answer) FROM a INTERSECT SELECT (qid, answer) FROM b)"""),
    "eval_anygood_ties": Query(eval_anygood_ties, _MET_SQL),
}
