"""Name join and dictionary matching against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from catalogkit.operators.namejoin import similar_names
from catalogkit.operators.patterns import dictionary_matches


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_every_similar_pair_is_found(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = ["the"] * 30 + [f"w{chr(97 + n)}" for n in range(26)]  # one word stands nearly everywhere
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    left, right = [(n, name()) for n in range(150)], [(n, rng.choice([name(), None])) for n in range(180)]
    right += [(1000 + n, left[n][1]) for n in range(40)] + [(2000 + n, "the") for n in range(30)]
    got = similar_names(spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "id long, name string"), threshold)
    want = set()
    for a, x in left:
        for b, y in right:
            s, t = set(x.split()), set((y or "").split())
            if s and t and len(s & t) / len(s | t) >= threshold - 1e-9:
                want.add((a, b, round(len(s & t) / len(s | t), 9)))
    assert sorted((r.left_id, r.right_id, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_pairs_of_a_frequent_name_are_spread_over_tasks(spark):
    rows = spark.range(1200).selectExpr("id", "'a b c' as name")
    pairs = similar_names(rows, rows.limit(900), 0.5, digits=6, spread_pairs=1200 * 900 // 64)
    per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 1200 * 900 and max(per_task) < 1200 * 900 // 3
    assert pairs.distinct().count() == 1200 * 900


def test_no_pairs_from_empty_sides(spark):
    none, some = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([(1, "a b"), (2, "  ")], "id long, name string")
    assert similar_names(none, some).count() == similar_names(some, none).count() == 0
    with pytest.raises(ValueError):
        similar_names(some, some, 0)


def test_dictionary_matches(spark):
    rows = spark.createDataFrame([(1, "abc abcd, bc (abc) xabc"), (2, None), (3, ""), (4, "bcébc bc"), (5, "none")], "id long, text string")
    dictionary = spark.createDataFrame([("abc",), ("bc",), ("bc",), ("",), (None,), ("abcd",)], "w string")
    found = lambda whole: {(r.id, r.pattern): r.n for r in dictionary_matches(rows, "text", dictionary, "w", whole).collect()}
    assert found(True) == {(1, "abc"): 2, (1, "abcd"): 1, (1, "bc"): 1, (4, "bc"): 1}
    assert found(False) == {(1, "abc"): 4, (1, "abcd"): 1, (1, "bc"): 5, (4, "bc"): 3}
    assert dictionary_matches(rows, "text", dictionary.limit(0), "w").count() == 0


def test_dictionaries_are_bounded(spark):
    from catalogkit.operators import patterns

    with pytest.raises(ValueError):
        patterns.pattern_hits("text", ["x" * (patterns.MAX_CHARACTERS + 1)])
    with pytest.raises(ValueError):
        patterns.pattern_hits("text", ["a", "a"])
