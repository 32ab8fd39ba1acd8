"""Stages of the pipeline bound the rows that a worker gets at once."""

import corpus_pipeline


def test_stages_bound_arrow_batches(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(name, "10000")
        corpus_pipeline.near_copies(spark, docs, "")
        assert spark.conf.get(name) == str(corpus_pipeline.BATCH_TEXTS)
        spark.conf.set(name, "7")
        corpus_pipeline.bounded_batches(spark)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.unset(name)
