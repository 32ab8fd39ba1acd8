"""Tiles of vector blocks: the rows sent do not grow with the number of blocks, and results are those of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogkit.operators import topk
from catalogkit.operators.topk import _score_vectors, vector_topk


def _expected(x, ids, k, least=None):
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sims = np.round(unit @ unit.T, 9) + 0.0
    out = set()
    for q in range(len(x)):
        best = sorted(range(len(x)), key=lambda c: (-sims[q, c], ids[c]))[:k]
        out |= {(int(ids[q]), int(ids[c]), float(sims[q, c])) for c in best if least is None or sims[q, c] >= least}
    return out


@pytest.mark.parametrize("least", [None, 0.4])
def test_tile_keeps_the_best_rows_among_copies(least):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:400], x[500] = x[7], 0
    x[600:610] = x[20] * (1 + 1e-7)
    ids = rng.permutation(700)
    vectors = pa.array(list(x), pa.list_(pa.float32()))
    queries, corpus = pa.table({"query_id": ids, "query_vector": vectors}), pa.table({"doc_id": ids, "vector": vectors})
    for rows in (64, 1024):
        found = _score_vectors(10, least, 9, rows, rows)(queries, corpus).to_pylist()
        assert {(r["query_id"], r["doc_id"], r["similarity"]) for r in found} == _expected(x.astype(float), ids, 10, least)


def test_small_blocks_do_not_send_rows_more_often(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    seen = spark.sparkContext.accumulator(0)
    real = topk._score_vectors

    def counting(*args):
        run = real(*args)

        def best(queries, corpus):
            seen.add(corpus.num_rows)
            return run(queries, corpus)

        return best

    monkeypatch.setattr(topk, "_score_vectors", counting)
    asked = rows.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = vector_topk(asked, rows, 5, query_rows=10, corpus_rows=10).collect()
    # thirty blocks of queries: each corpus row went out thirty times
    assert seen.value <= 300 * topk.QUERY_TILES
    assert {(r["query_id"], r["doc_id"], r["similarity"]) for r in found} == _expected(x, np.arange(300), 5)
