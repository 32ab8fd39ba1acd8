"""Scoring every row of one table against every row of another in bounded blocks.

Both tables are cut into blocks of a stated number of rows by the hash of a key. Only the rows' copies for
the other side's blocks are shuffled; a pair of blocks meets in one bounded group, whose best rows alone leave
its task. The driver holds nothing, and no row pair is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Keys = str | Sequence[str]


def _block_count(df: DataFrame, rows: int) -> Column:
    """How many blocks the table needs: found while the job runs, not while it is planned."""
    return F.greatest(F.ceil(df.agg(F.count("*")).scalar() / rows), F.lit(1)).cast("int")


def block_pairs(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys, left_rows: int, right_rows: int,
                left_of: DataFrame | None = None, counts: tuple[Column, Column] | None = None):
    """The two tables grouped by pairs of blocks, for ``applyInArrow``; each group has the extra columns
    ``_left_block`` and ``_right_block``. ``left_of`` is a cheaper table with at least as many rows as ``left``, to
    count instead of it. ``counts`` gives the numbers of blocks instead."""
    left_key, right_key = ([k] if isinstance(k, str) else list(k) for k in (left_key, right_key))
    own = counts or (_block_count(left if left_of is None else left_of, left_rows), _block_count(right, right_rows))
    numbers = [own[0].alias("_l"), own[1].alias("_r")]

    def placed(df: DataFrame, key: Sequence[str], own: str, other: str, names: tuple[str, str]) -> DataFrame:
        counted = df.select("*", *numbers)
        numbered = counted.withColumn(names[0], F.pmod(F.xxhash64(*key), F.col(own)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return numbered.withColumn(names[1], every).drop("_l", "_r")

    blocks = ("_left_block", "_right_block")
    a = placed(left, left_key, "_l", "_r", blocks).groupBy(*blocks)
    b = placed(right, right_key, "_r", "_l", blocks[::-1]).groupBy(*blocks)
    return a.cogroup(b)
