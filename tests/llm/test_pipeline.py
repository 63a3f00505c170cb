import duckdb

import __spark_entry__
import corpus_pipeline


def test_stages_keep_clean_documents_and_drop_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, sf))
        seen[name] = docs.count()
        if name != "tokens":
            assert docs.columns == columns
    assert seen["near_dup"] == seen["substring"] == seen["mixing"] == seen["tokens"] < seen["quality"] < 200
    labels = duckdb.sql(f"SELECT count(*) FILTER (quality = 1) FROM '{sf}/labels.parquet'").fetchall()[0][0]
    assert seen["quality"] >= labels


def test_run_and_entry(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids"] and got.count() > 100
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] if q.startswith("op") else q for q in __spark_entry__.queries()}


def test_stages_take_empty_and_odd_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot int"
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (None, "", "en", "a", 0, 2), (2, "a b c", "en", "a", 5, 3), (2, "a b c", "en", "a", 5, 3)], schema)
    for docs in (spark.createDataFrame([], schema), odd):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, sf))
            if name != "tokens":
                assert docs.columns == odd.columns
