"""Keeping one row per key. Order always comes from named columns, never from partition order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogkit.functions.text import trim

Order = Sequence[str | Column]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Order, n: int, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    The ``row_number <= n`` shape lets Spark cut each key to ``n`` rows before the shuffle,
    so a key holding a third of the table reaches its task as a few rows per input partition.
    """
    rank = rank_col or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return kept if rank_col else kept.drop(rank)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """First row per key; rows with a null or blank key are dropped."""
    present = reduce(lambda a, b: a & b, [trim(F.col(k).cast("string")) != "" for k in keys])
    return top_per_key(df.filter(present), keys, order, 1)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """``DISTINCT ON (keys) … ORDER BY keys, order``; null keys form a group."""
    return top_per_key(df, keys, order, 1)


def newest_snapshot_wins(
    snapshots: DataFrame, key: str, snapshot: str, legacy: str | None = None, include_legacy: bool = False,
    tie: Order = (),
) -> DataFrame:
    """One row per key, from the snapshot with the highest name.

    If a snapshot may repeat a key, ``tie`` orders its rows; the first is taken.

    ``legacy`` names a boolean column; such snapshots take part only when asked for.
    """
    if legacy and not include_legacy:
        snapshots = snapshots.filter(~F.col(legacy))
    return first_per_key(snapshots, [key], [F.desc(snapshot), *tie])


def mark_duplicates(
    items: DataFrame, scope: Sequence[str], ean: str, valid: str, order: Sequence[str], item_id: str,
    out: str = "is_duplicate",
) -> DataFrame:
    """Flag every valid row after the first of its code within ``scope``.

    Invalid codes are never duplicates. Only the first row's id per code is shuffled by code
    (cut before the shuffle); the flag comes back over the unique row id, so a code with very
    many copies never gathers in one task.
    """
    keys = [*scope, ean]
    columns = list(dict.fromkeys([*keys, *order, item_id]))
    firsts = top_per_key(items.filter(F.col(valid)).select(*columns), keys, [*order, item_id], 1)
    firsts = firsts.select(item_id, F.lit(True).alias("_first"))
    flagged = items.join(firsts, item_id, "left")
    return flagged.withColumn(out, F.col(valid) & F.col("_first").isNull()).drop("_first")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate like-shaped inputs by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
