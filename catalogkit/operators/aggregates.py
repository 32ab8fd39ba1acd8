"""Counters and summaries of imports, lookups and load tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.functions.text import _c, trim
from catalogkit.operators.ordering import nearest_rank_percentiles

# Lookup statuses of a batch answer.
LOOKUP_STATUSES = ["enriched", "review", "not_found", "invalid_ean", "error"]


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def import_counters(items: DataFrame, batch: str = "batch_id", status: str = "status") -> DataFrame:
    """Processed, success, failed and review counts per batch, and the batch's final status.

    Skipped rows count only as processed. A batch failed only if every row failed.
    """
    state = F.col(status)
    counted = items.groupBy(batch).agg(
        F.count("*").alias("total"),
        count_if(state.isin("enriched", "failed", "review") | state.startswith("skipped")).alias("processed"),
        count_if(state == "enriched").alias("success"),
        count_if(state == "failed").alias("failed"),
        count_if(state == "review").alias("review"),
    )
    return counted.withColumn("batch_status", finalize_status("total", "failed"))


def finalize_status(total: str | Column, failed: str | Column) -> Column:
    return F.when((_c(total) > 0) & (_c(failed) == _c(total)), "failed").otherwise("completed")


def status_summary(df: DataFrame, status: str, known: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Total and one count per known status, zero where absent."""
    counts = [count_if(F.col(status) == s).alias(s) for s in known]
    return df.groupBy(*groups).agg(F.count("*").alias("total"), *counts)


def distinct_concat(df: DataFrame, keys: Sequence[str], value: str, sep: str = ",", name: str = "joined") -> DataFrame:
    """Distinct non-blank values per group, sorted and joined. Copies are removed before gathering."""
    pairs = df.filter(trim(F.col(value).cast("string")) != "").select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name))


def distinct_values(df: DataFrame, column: str, name: str = "name") -> DataFrame:
    """Distinct non-blank values of a dimension column."""
    return df.filter(trim(F.col(column)) != "").select(F.col(column).alias(name)).distinct()


def count_distinct_keys(df: DataFrame, key: str, approximate: bool = False, name: str = "total") -> DataFrame:
    """Number of distinct non-blank keys; the exact form counts a distinct table, not one task's set."""
    present = df.filter(trim(F.col(key).cast("string")) != "").select(key)
    if approximate:
        return present.agg(F.approx_count_distinct(key).alias(name))
    return present.distinct().agg(F.count("*").alias(name))


def group_by_key(df: DataFrame, key: str, item_id: str, order: Sequence[str], size: int = 1000) -> DataFrame:
    """Rows of each non-blank key as lists: ``(key, part_no, parts, items)``.

    Every key has ``ceil(rows / size)`` lists, over which its rows are spread by row id, so no list
    grows with the table; together they hold every row. Keys of one list are no special case.
    """
    present = df.filter(trim(F.col(key).cast("string")) != "")
    sizes = present.groupBy(key).agg(F.count("*").alias("_n"))
    sizes = sizes.select(key, F.ceil(F.col("_n") / size).cast("int").alias("parts"))
    keyed = present.join(sizes, key)
    keyed = keyed.withColumn("part_no", F.pmod(F.xxhash64(item_id), F.col("parts")).cast("int"))
    fields = [*order, *[c for c in present.columns if c not in order]]
    return keyed.groupBy(key, "part_no", "parts").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("items")
    )


def token_frequencies(df: DataFrame, tokens: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and weight ``1 + ln(count)`` of each token."""
    exploded = df.select(*keys, F.explode(tokens).alias("token"))
    counted = exploded.groupBy(*keys, "token").agg(F.count("*").alias("occurrences"))
    return counted.withColumn("weight", 1 + F.log(F.col("occurrences").cast("double")))


def quality_by_category(outcomes: DataFrame, category: str, passed: str, error: str | None = None) -> DataFrame:
    """Passed, total and percent per category and overall (``category`` null); errors counted apart."""
    is_error = F.col(error) if error else F.lit(False)
    hit = F.col(passed) & ~is_error
    return (
        outcomes.rollup(category)
        .agg(
            F.count("*").alias("total"),
            count_if(hit).alias("passed"),
            count_if(is_error).alias("errors"),
            count_if(~hit & ~is_error).alias("missed"),
        )
        .withColumn("pass_pct", F.round(F.col("passed") / F.col("total") * 100, 2))
    )


# Percentiles of a latency summary.
LATENCY_FRACTIONS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def latency_summary(
    requests: DataFrame, stage: str, latency: str, ok: Column, elapsed: DataFrame, overall: str = "all"
) -> DataFrame:
    """Request counts, rate, success percent, and exact latency statistics per stage and overall.

    ``elapsed`` has one row per stage with its ``elapsed_ms``.
    """
    stamped = requests.withColumn("_ok", ok)
    both = stamped.withColumn("_stage", F.explode(F.array(F.col(stage), F.lit(overall))))
    base = both.groupBy("_stage").agg(
        F.count("*").alias("requests"),
        count_if(F.col("_ok")).alias("successes"),
        F.min(latency).alias("min"),
        F.avg(latency).alias("avg"),
        F.max(latency).alias("max"),
    )
    ranks = nearest_rank_percentiles(both.select("_stage", latency), ["_stage"], latency, LATENCY_FRACTIONS)
    time = elapsed.withColumn("_stage", F.explode(F.array(F.col(stage), F.lit(overall))))
    time = time.groupBy("_stage").agg(F.sum("elapsed_ms").alias("elapsed_ms"))
    joined = base.join(ranks, "_stage").join(time, "_stage")
    rounded = [F.round(c, 2).alias(c) for c in ["min", "avg", *LATENCY_FRACTIONS, "max"]]
    rate = F.when(F.col("elapsed_ms") > 0, F.round(F.col("requests") / (F.col("elapsed_ms") / 1000), 2)).otherwise(0.0)
    return joined.select(
        F.col("_stage").alias("stage"),
        "requests",
        "successes",
        F.round(F.col("elapsed_ms"), 2).alias("elapsed_ms"),
        rate.alias("requests_per_second"),
        F.round(F.col("successes") / F.col("requests") * 100, 2).alias("success_pct"),
        *rounded,
    )
