"""Answers of a question meet where they are shuffled to, once."""

from sibyl.operators import hitlist as hl


def test_diffusion_shuffles_once(spark):
    df = spark.createDataFrame([(1, "Paris, France", 0.5), (1, "France", 0.25), (1, "Lyon, France", 0.2), (1, "France", 0.5), (None, "France", 1.0), (2, None, 1.0), (2, "é, a", 1.0), (2, "a", 0.5)], "qid int, text string, confidence double")
    for policy in ("sum", "max", "decay"):
        out = hl.diffuse(df, policy, True)
        assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.qid, r.text, r.case): r.score for r in hl.diffuse(df, "sum", True).collect()}
    assert got == {(1, "France", "suffixing"): 1.4, (1, "Paris, France", "suffixed"): 0.75, (1, "Lyon, France", "suffixed"): 0.75, (2, "é, a", "suffixed"): 0.5, (2, "a", "suffixing"): 1.0}


def test_tasks_grow_with_rows(spark):
    from sibyl.functions import stages

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(10)
    assert stages.dealt(df, 10, "id", most=1_000).rdd.getNumPartitions() == n
    assert stages.dealt(df, 1_000 * (n + 7), "id", most=1_000).rdd.getNumPartitions() == n + 7


def test_best_paths_stay_where_questions_are(spark):
    from sibyl.functions import stages
    from sibyl.operators import graph as gr

    features = stages.dealt(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "none")], "qid long, feature string"), 4, "qid")
    weights = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("q", "a", 0.5), ("p", "_", 0.0), ("q", "_", 0.0)], "path string, feature string, weight double")
    out = gr.best_paths(features, weights, 1)
    assert "Exchange hashpartitioning(feature" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, "p", 0.880797), (2, "p", 0.731059)]
