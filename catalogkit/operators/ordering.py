"""Global order without a single-task sort: row numbers, pages, chunks and exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogkit.session import cut_lineage

# Rows of a page when none are asked for, and the bound that a web page may set.
DEFAULT_LIMIT, WEB_LIMIT = 10, 50


def page_size(limit: int | None, max_limit: int | None = None) -> int:
    """Rows of a page: as many as asked for, at least one, at most ``max_limit`` where given."""
    size = DEFAULT_LIMIT if limit is None else max(int(limit), 1)
    return size if max_limit is None else min(size, max_limit)


def _range_partitioned(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """``df`` sorted over range partitions and stored, with ``_part`` and ``_pos`` in the partition."""
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    stored = cut_lineage(spread.sortWithinPartitions(*order))
    local = F.monotonically_increasing_id()
    return stored.withColumn("_part", F.spark_partition_id()).withColumn(
        "_pos", local - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    )


def with_row_number(
    df: DataFrame, order: Sequence[str | Column], name: str = "row_no", partitions: int | None = None
) -> DataFrame:
    """1-based row number in a total order.

    Range partitions are sorted side by side; only one count per partition is brought
    together to place them. End ``order`` with a unique column, so that a value shared by
    many rows can still be split over partitions.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = _range_partitioned(df, order, partitions)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per partition of the table: bounded by the partition count
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_pos") + 1).drop("_part", "_pos", "_offset")


def chunk(df: DataFrame, order: Sequence[str | Column], size: int, name: str = "chunk_no") -> DataFrame:
    """Number fixed-size batches of consecutive rows, from 0."""
    numbered = with_row_number(df, order, "_row")
    return numbered.withColumn(name, F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row")


def page(
    df: DataFrame, order: Sequence[str | Column], limit: int | None = None, offset: int = 0, max_limit: int | None = None
) -> DataFrame:
    """One page in order with ``position, returned, has_more, next_offset``.

    One row beyond the page is fetched to learn whether more follow. Spark keeps only
    ``offset + limit + 1`` rows per partition for it.
    """
    limit = page_size(limit, max_limit)
    fetched = df.orderBy(*order).offset(offset).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))
    numbered = fetched.withColumn("position", F.row_number().over(everything.orderBy(*order)).cast("long"))
    numbered = numbered.withColumn("_n", F.count("*").over(everything))
    has_more = F.col("_n") > limit
    return (
        numbered.withColumn("returned", F.least(F.col("_n"), F.lit(limit)).cast("long"))
        .withColumn("has_more", has_more)
        .withColumn("next_offset", F.when(has_more, F.lit(offset + limit)).cast("long"))
        .filter(F.col("position") <= limit)
        .drop("_n")
    )


def keyset_page(df: DataFrame, key: str, after: str | None = None, limit: int = 100) -> DataFrame:
    """Next ``limit`` rows with a key above ``after``, in key order."""
    rest = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(max(int(limit), 1))


def export_slice(df: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in key order from ``offset``, all of them when no limit is given."""
    if limit is None and offset:
        # an offset alone would bring the table to one task: number the rows instead
        return with_row_number(df, [key], "_row").filter(F.col("_row") > offset).drop("_row").orderBy(key)
    ordered = df.orderBy(key)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def nearest_rank_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float], partitions: int | None = None
) -> DataFrame:
    """Exact nearest-rank percentiles per group, one column per named fraction.

    Equal values are counted first. The counts are then range-partitioned by group and value,
    so a group with a third of all rows is spread over many tasks; per-partition totals place
    each run of ranks.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    placed = _range_partitioned(counted, [*map(F.col, groups), F.col(value)], partitions).drop("_pos")
    totals = placed.groupBy(*groups, "_part").agg(F.sum("_n").alias("_t"))
    per_group = Window.partitionBy(*groups)
    before = per_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *groups,
        "_part",
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"),
        F.sum("_t").over(per_group).alias("_total"),
    )
    within = Window.partitionBy(*groups, "_part").orderBy(value)
    ranked = (
        placed.withColumn("_upto", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(totals, [*groups, "_part"])
        .withColumn("_hi", F.col("_before") + F.col("_upto"))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )
    picks = []
    for name, fraction in fractions.items():
        rank = F.greatest(F.ceil(F.col("_total") * F.lit(float(fraction))), F.lit(1))
        picks.append(F.max(F.when((rank > F.col("_lo")) & (rank <= F.col("_hi")), F.col(value))).alias(name))
    return ranked.groupBy(*groups).agg(*picks)
