"""Sharding by a lookup table that the shards fill in turns, each by its own permutation of the slots.

A key hashes to a slot of a table of prime size, and the slot names its shard. Every shard prefers the slots
in an order of its own; in turns, each claims the first slot of its order that is still free. Shards get
almost equal numbers of slots, and when a shard comes or goes, few other slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Prime, and at least a hundred times the shards for shares within about one per cent.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> np.ndarray:
    """The shard number of every slot.

    Slot orders depend on the shards' names alone, and turns are taken in order of the names, so the order
    in which shards are listed does not matter. A shard of weight ``w`` takes ``w`` turns a round.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be prime and not below the number of shards")
    turns = [n for n in sorted(range(len(shards)), key=lambda n: shards[n]) for _ in range((weights or {}).get(shards[n], 1))]
    if not turns:
        raise ValueError("some shard needs a positive weight")
    orders = {}
    for n in set(turns):
        digest = hashlib.blake2b(shards[n].encode(), digest_size=16).digest()
        offset = int.from_bytes(digest[:8], "little") % slots
        skip = int.from_bytes(digest[8:], "little") % (slots - 1) + 1 if slots > 2 else 1
        orders[n] = [offset, skip]
    table, free = np.full(slots, -1, np.int32), slots
    while free:
        for n in turns:
            at, skip = orders[n]
            while table[at] >= 0:
                at = (at + skip) % slots
            table[at] = n
            orders[n][0] = (at + skip) % slots
            free -= 1
            if not free:
                break
    return table


def slot_of(keys: Sequence[Column], slots: int = SLOTS, without_key: Sequence[Column] = ()) -> Column:
    """Slot of a row's key. A key of nulls only falls back to ``without_key``, so that such rows spread."""
    none = F.lit(True)
    for key in keys:
        none = none & key.isNull()
    own = F.xxhash64(*keys)
    other = F.xxhash64(*without_key) if without_key else own
    return F.pmod(F.when(none, other).otherwise(own), F.lit(slots)).cast("int")


def place_rows(
    df: DataFrame,
    keys: Sequence[str],
    shards: Sequence[str],
    slots: int = SLOTS,
    weights: Mapping[str, int] | None = None,
    without_key: Sequence[str] = (),
    names: tuple[str, str] = ("slot", "shard"),
) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``; columns of these names are replaced.

    Rows with equal keys share a shard, however many they are. Rows whose keys are all null are placed by
    ``without_key`` where given, else together. The table has ``slots`` rows whatever the data, and is broadcast
    with that bound; rows are not moved. An empty table stays empty.
    """
    spark: SparkSession = df.sparkSession
    table = fill_table(shards, slots, weights)
    slot, shard = names
    rows = [(n, shards[s]) for n, s in enumerate(table.tolist())]
    lookup = F.broadcast(spark.createDataFrame(rows, f"`{slot}` int, `{shard}` string"))
    placed = df.drop(shard).withColumn(slot, slot_of([F.col(k) for k in keys], slots, [F.col(k) for k in without_key]))
    # every slot has exactly one row in the table
    return placed.join(lookup, slot).select(*[c for c in placed.columns if c != slot], slot, shard)


def write_shards(
    df: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str], rows_per_file: int = 1_000_000, **how
) -> None:
    """Write one Parquet folder per shard. Each task writes into the shards that its rows belong to."""
    placed = place_rows(df, keys, shards, **how)
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy(how.get("names", ("slot", "shard"))[1]).parquet(path)
