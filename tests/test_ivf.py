"""Inverted file against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.operators.ivf import NO_DIRECTION, build_ivf, fit_centres, recall_at, vector_topk_ivf
from catalogkit.operators.topk import vector_topk
from qsuite.load import load_all
from qsuite.registry import QUERIES

load_all()


def table(spark, rows=3000, dims=16, seed=0):
    """Vectors around 40 directions; a third of them around one. Some are zero, missing or of another size."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    own = np.where(rng.random(rows) < 1 / 3, 0, rng.integers(0, 40, rows))
    x = centres[own] + 0.25 * rng.normal(size=(rows, dims))
    data = [(n, [float(v) for v in row]) for n, row in enumerate(x.tolist())]
    data += [(rows, [0.0] * dims), (rows + 1, None), (rows + 2, [1.0]), (rows + 3, data[5][1]), (rows + 4, data[5][1])]
    return spark.createDataFrame(data, "doc_id long, vector array<double>").repartition(6)


def asked(corpus):
    return corpus.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["similarity"], 8)) for r in df.collect())


def test_every_row_is_indexed_and_recall_holds(spark):
    corpus = table(spark)
    index = build_ivf(corpus, 50)
    assert index.rows.count() == corpus.count() and sum(index.sizes.values()) == corpus.count()
    assert index.rows.filter(F.col("list") == NO_DIRECTION).count() == 3
    truth = vector_topk(asked(corpus), corpus, 10)
    few = recall_at(vector_topk_ivf(asked(corpus), index, 10, probes=8), truth, 10).first()
    assert few["queries"] == 61 and few["recall"] >= 0.9


@pytest.mark.parametrize("probes,corpus_rows,query_rows", [(1, 1024, 1024), (4, 100, 7)])
def test_exact_mode_equals_all_pairs(spark, probes, corpus_rows, query_rows):
    corpus = table(spark, 1500, seed=probes)
    got = vector_topk_ivf(asked(corpus), build_ivf(corpus, 30), 10, probes, exact=True, corpus_rows=corpus_rows, query_rows=query_rows)
    assert rows(got) == rows(vector_topk(asked(corpus), corpus, 10))


def test_given_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    truth = vector_topk(asked(corpus), corpus, 10)
    assert recall_at(QUERIES["vector_topk_ivf"](spark, sf_dir), truth, 10).first()["recall"] >= 0.9


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, vector array<double>")
    assert vector_topk_ivf(asked(empty), build_ivf(empty, 4), 3, 2).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "doc_id long, vector array<double>")
    assert rows(vector_topk_ivf(asked(two), build_ivf(two, 8), 3, 8)) == [(0, 1, 0, 1.0), (0, 2, 50, 0.0), (50, 1, 50, 1.0), (50, 2, 0, 0.0)]
    with pytest.raises(ValueError):
        fit_centres(two, 1 << 24)
