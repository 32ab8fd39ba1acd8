"""Level thresholds of the taxonomy against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from catalogkit.operators import taxonomy as t


def tables(spark, seed, entries=400, items=120):
    rng = random.Random(seed)
    value = lambda n, size: rng.choice([None, "", *(f"L{n} name{k}" for k in range(size))])
    rows = [(k + 1, *(value(n, 2 + 2 * n) for n in range(5)), str(rng.choice([0, 3, 30, 7]))) for k in range(entries)]
    made = t.taxonomy_entries(spark.createDataFrame(rows, f"no long, {', '.join(f'{x} string' for x in t.LEVELS)}, item_count string"), "no")
    asked = [(k, *(value(n, 3 + 2 * n) for n in range(5)), " ".join(rng.choice(["l0", "name1", "name3", "other"]) for _ in range(rng.randint(0, 6)))) for k in range(items)]
    return spark.createDataFrame(asked, f"k long, {', '.join(f'{x} string' for x in t.LEVELS)}, words string"), made


def plain(items, entries, limit):
    norm = lambda x: " ".join((x or "").lower().split())
    held = [(e.entry_no, e.item_count, set(e.path_tokens), [norm(e[x]) for x in t.LEVELS]) for e in entries.collect()]
    out = {}
    for i in items.collect():
        words, own = set(norm(i.words).split()), [norm(i[x]) for x in t.LEVELS]
        scored = [(-(4 * len(words & w) + sum(p for p, a, b in zip(t.LEVEL_POINTS, own, levels) if a == b) + min(n, 25) / 25), -n, no) for no, n, w, levels in held]
        out[i.k] = [(no, round(-s, 6)) for s, _, no in sorted(scored)[:limit] if s < 0]
    return out


@pytest.mark.parametrize("limit", [1, 7, 60, 500])
def test_same_rows_as_scoring_every_pair(spark, limit):
    items, entries = tables(spark, limit)
    got = t.taxonomy_candidates(items, entries, "words", limit, item_rows=50, entry_rows=90)
    found = {r.k: [(c.entry_no, round(c.score, 6)) for c in r.candidates] for r in got.collect()}
    assert found == plain(items, entries, limit)


def test_few_pairs_are_scored(spark):
    from qsuite import views as v
    from qsuite.q_taxonomy import signals

    sf_dir = "/root/testdata/sf0.01"
    items, entries = signals(spark, sf_dir), v.taxonomy(spark, sf_dir)
    held = entries.select("entry_no", "item_count", "path_tokens", *[t.normalize_text(x).alias(f"n_{x}") for x in t.LEVELS])
    asked = items.select(
        F.xxhash64("p_partkey").alias("h1"), F.lit(0).alias("h2"), *[t.normalize_text(x).alias(f"n_{x}") for x in t.LEVELS],
        F.array_sort(t.tokenize_unique("all_words")).alias("tokens"),
    )
    needed = t.level_thresholds(asked, held, 5).filter(~F.array_contains("levels_needed", 0))
    assert needed.count() == asked.count()
    assert t.scored_by_levels(needed, held).count() < 0.1 * asked.count() * held.count()


def test_smallest_sets_of_levels():
    for points in range(0, 501, 10):
        sets = t._enough(points)
        assert all((worth >= points) == any(s & m == s for s in sets) for m, worth in t._SETS.items())
