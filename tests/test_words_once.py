"""The documents' words are found once, whatever reads them after."""

from sibyl.queries import QUERIES


def test_documents_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "cats cat walked walk cities city"), (2, "dogs dog walked cat")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["corpus_lemmas"].run(spark, str(tmp_path))
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in out.collect()} == {"cats", "cat", "walked", "walk", "cities", "city", "dogs", "dog"}
