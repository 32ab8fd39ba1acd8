"""Arrow batches of many or long rows are worked through in bounded slices, with the same results."""

import tracemalloc

import numpy as np
import pyarrow as pa

from catalogkit.functions import vectors
from catalogkit.operators import ivf
from catalogkit.operators.patterns import pattern_hits


def _peak(run):
    tracemalloc.start()
    try:
        made = run()
        return made, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hash_vector_in_slices(spark, monkeypatch):
    lists = [["a", "b", "a"], None, [], ["c"] * 9, ["d", None]] * 20
    tokens = pa.array(lists, pa.list_(pa.string()))
    for made in (vectors._dense_udf(32, True, 12), vectors._sparse_udf(32, True, 12)):
        whole = made.func(tokens).to_pylist()
        with monkeypatch.context() as m:
            m.setattr(vectors, "_SLICE_TOKENS", 4)
            assert made.func(tokens).to_pylist() == whole


def test_hash_vector_memory_does_not_follow_the_batch(spark):
    tokens = pa.array([[f"w{i % 97}" for i in range(500)]] * 3000, pa.list_(pa.string()))
    dense = vectors._dense_udf(8, True, 12).func
    _, peak = _peak(lambda: dense(tokens))
    # one and a half million tokens: over 100 MB in one piece
    assert peak < 50_000_000


def test_asked_lists_memory_does_not_follow_the_batch():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(1500, 8))
    centres = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    index = ivf.InvertedFile(centres, None, np.zeros(1500), {n: 1 for n in range(1500)})
    vectors_ = pa.array(list(rng.normal(size=(4000, 8))), pa.list_(pa.float64()))
    floors = pa.array([None] * 4000, pa.float64())
    lists, peak = _peak(lambda: ivf._probed(index, 20, False)(vectors_, floors))
    near = np.stack(vectors_.to_pylist()) @ centres.T
    assert lists[17].as_py() == [*np.argsort(-near[17], kind="stable")[:20], ivf.NO_DIRECTION]
    placed, more = _peak(lambda: ivf._nearest(centres)(vectors_))
    assert placed.field("list").to_pylist() == near.argmax(axis=1).tolist()
    # one matrix of all similarities has 48 MB
    assert peak < 40_000_000 and more < 40_000_000


def test_hits_of_texts_without_words(spark):
    rows = spark.createDataFrame([(1, "ab ab b"), (2, None), (3, "none"), (4, "b")], "id int, t string")
    found = {r["id"]: [tuple(h) for h in r["h"]] for r in rows.select("id", pattern_hits("t", ["ab", "b"]).alias("h")).collect()}
    assert found == {1: [(0, 2), (1, 1)], 2: [], 3: [], 4: [(1, 1)]}
