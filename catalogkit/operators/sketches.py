"""Sketches that are stored per batch and united later: distinct counts, quantiles and frequent items.

Each is a column of bytes or a small table, with a stated error; uniting the sketches of parts stands for reading all parts again.
Distinct counts and quantiles use Spark's HyperLogLog and KLL sketches; frequent items are counts with a bound on what was left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.operators.dedupe import top_per_key

#: Two to this power of registers: a relative error of 1.04 / 64 = 1.6 % (one deviation) in 4 KB.
LOG_REGISTERS = 12
#: Size of a quantile sketch: a rank is off by 1.7 % at most, in 99 of 100 cases, in 4 KB.
QUANTILE_SIZE = 200
RANK_ERROR = 0.017


def distinct_error() -> float:
    """Relative error of a distinct count, as one standard deviation."""
    return 1.04 / 2 ** (LOG_REGISTERS / 2)


def distinct_sketches(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One sketch of the distinct values per group; partial sketches are made before the shuffle. Nulls are not counted."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, LOG_REGISTERS).alias("sketch"))


def unite_distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the sketch of all values, and ``n``, their estimated number; the same as the sketch of the whole."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("n", F.hll_sketch_estimate("sketch"))


def quantile_sketches(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One sketch of the values' distribution per group. Nulls are left out; a group of nulls has none."""
    kept = rows.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    return kept.groupBy(*keys).agg(F.kll_sketch_agg_double("_x", QUANTILE_SIZE).alias("sketch"))


def unite_quantiles(sketches: DataFrame, keys: Sequence[str], ranks: dict[str, float]) -> DataFrame:
    """Per group a column per name in ``ranks``: the value at about that share of all values."""
    united = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", QUANTILE_SIZE).alias("sketch"))
    return united.select(*keys, *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in ranks.items()])


def frequent_items(rows: DataFrame, keys: Sequence[str], item: str, size: int) -> DataFrame:
    """Per group (one key column at least) the ``size`` most frequent items with ``n``, and ``missed``: no item left out stands more often than that.

    Counts are aggregated before anything is ranked. Ties go to the lesser item.
    """
    counted = rows.filter(F.col(item).isNotNull()).groupBy(*keys, F.col(item).alias("item")).agg(F.count("*").alias("n"))
    ranked = top_per_key(counted, list(keys), [F.desc("n"), F.asc("item")], size + 1, "rank")
    missed = ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") > size, F.col("n")).otherwise(0)).alias("missed"))
    kept = ranked.filter(F.col("rank") <= size).drop("rank")
    return kept.join(missed, list(keys))


def unite_frequent(summaries: DataFrame, part: str, keys: Sequence[str], size: int) -> DataFrame:
    """Per group the ``size`` items most frequent in the summaries of all parts: ``item, n, at_most``.

    ``part`` names the batch. The true count lies between ``n`` and ``at_most``: a part without the item may have left out as many
    as its ``missed``.
    """
    parts = summaries.groupBy(*keys, part).agg(F.first("missed").alias("missed"))
    total = parts.groupBy(*keys).agg(F.sum("missed").alias("all_missed"))
    summed = summaries.groupBy(*keys, "item").agg(F.sum("n").alias("n"), F.sum("missed").alias("had"))
    bounded = summed.join(total, list(keys)).select(*keys, "item", "n", (F.col("n") + F.col("all_missed") - F.col("had")).alias("at_most"))
    return top_per_key(bounded, list(keys), [F.desc("n"), F.asc("item")], size)


def relative_error(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact) / exact
