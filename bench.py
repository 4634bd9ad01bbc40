"""Runs the headline queries once warm and prints one JSON line of their seconds."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from sibyl.queries import QUERIES  # noqa: E402

HEADLINES = [
    "answer_questions", "answer_candidates", "passage_score_top3", "tfidf_topn", "phrase_boolean", "proximity_slop", "evidence_hits", "path_top15", "path_witness", "popularity",
    "hitlist_merge", "hitlist_topk", "hitlist_zscore", "text_merge", "evidence_diffusion_decay", "score_forest", "tycor_match", "lat_closure", "clue_overlap_cases",
    "eval_pr_roc", "eval_feature_stats", "eval_anygood_ties", "lifecycle_last_state",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        t = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
