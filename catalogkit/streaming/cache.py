"""Keeping the last stock rows per key for a limited time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from catalogkit.operators.dedupe import top_per_key
from catalogkit.streaming.imports import start
from catalogkit.streaming.requests import with_keyed_state

# Fixed value: how long a row stays valid.
TTL_SECONDS = 300
# held rows carry their time as a number; such names may not begin with an underscore
_AT = "cached_at_micros"


def cached_rows(
    rows: DataFrame, keys: Sequence[str], ts: str, now: Column, ttl_seconds: int = TTL_SECONDS,
    max_entries: int | None = None, tie: Sequence[str] = (),
) -> DataFrame:
    """Last row per key that has not expired at ``now``; ``max_entries`` keeps only the latest of them.

    Expired rows are filtered first; the time condition reaches the scan.
    """
    live = rows.filter((F.col(ts) > now - F.expr(f"interval {ttl_seconds} seconds")) & (F.col(ts) <= now))
    latest = top_per_key(live, keys, [F.desc(ts), *map(F.desc, tie)], 1)
    if max_entries is None:
        return latest
    return latest.orderBy(F.desc(ts), *keys).limit(max_entries)


def cache_hits(requests: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests with the cached columns and ``cache_hit``; an expired or missing key is a miss."""
    known = cache.withColumn("_hit", F.lit(True))
    joined = requests.join(known, list(keys), "left")
    return joined.withColumn("cache_hit", F.col("_hit").isNotNull()).drop("_hit")


class _LastRow(StatefulProcessor):
    """The newest row of one key, until the watermark reaches its time."""

    def __init__(self, row_type: str, order: Sequence[str]):
        self.row_type, self.order = row_type, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.row_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = self.columns()
        held = tuple(self.row.get()) if self.row.exists() else None
        newest = held
        for frame in rows:
            values = self._last(frame)
            if newest is None or self._rank(values) >= self._rank(newest):
                newest = values
        if held != newest:
            self.row.update(newest)
        # a held row has one timer, which follows from its time
        due, before = (None if row is None else int(row[columns.index(self.order[0])]) // 1000 for row in (newest, held))
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        yield pd.DataFrame([newest], columns=columns)

    def _last(self, frame: pd.DataFrame) -> tuple:
        """The newest row of a frame, of equals the last; a null is the greatest."""
        if len(frame) == 1:
            at = 0
        elif all(frame[c].dtype.kind in "iuf" for c in self.order):
            at = np.lexsort([frame[c].to_numpy() for c in reversed(self.order)])[-1]
        else:
            at = frame.reset_index(drop=True).sort_values(self.order, kind="stable").index[-1]
        values = (frame[c].iat[at] for c in self.columns())
        return tuple(None if pd.isna(x) else x.item() if isinstance(x, np.generic) else x for x in values)

    def _rank(self, row: tuple) -> list[tuple]:
        places = [self.columns().index(c) for c in self.order]
        return [(row[n] is None, 0 if row[n] is None else row[n]) for n in places]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        return iter([])

    def columns(self) -> list[str]:
        return [part.strip().split(" ")[0].strip("`") for part in self.row_type.split(",")]

    def close(self) -> None:
        pass


def stock_cache_stream(
    rows: DataFrame, checkpoint: str, keys: Sequence[str], ts: str, ttl_seconds: int = TTL_SECONDS,
    tie: Sequence[str] = (), interval: str | None = None, handle: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the newest row per key in Spark's keyed state for ``ttl_seconds``; expired keys leave the state by themselves.

    Time is that of the rows: the watermark runs ``ttl_seconds`` behind the newest time seen, so a row as old as that is late, and a
    held row's timer fires when the watermark reaches it. The state holds no more keys than had a row within that time.
    A micro-batch reads its own keys alone. ``handle`` gets the rows that changed; ``cached_state`` reads the whole cache.
    Columns of simple types only.
    """
    others = [c for c in rows.columns if c != ts]
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{ttl_seconds} seconds")
    plain = timed.select(ts, F.unix_micros(ts).alias(_AT), *others)
    held = [_AT, *others]
    kind = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in held)
    changed = plain.groupBy(*keys).transformWithStateInPandas(
        _LastRow(kind, [_AT, *tie]), kind, "update", "EventTime"
    )
    done = handle or (lambda df, epoch: df.write.format("noop").mode("overwrite").save())
    back = changed.withColumn(ts, F.timestamp_micros(_AT).cast(rows.schema[ts].dataType)).select(*rows.columns)
    return with_keyed_state(rows.sparkSession, lambda: start(back, done, checkpoint, interval, mode="update"))


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows that the state of a cache stream holds, expired ones whose timer has not fired yet among them."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load()
    return state.select("value.*")


def cached_state(
    spark: SparkSession, checkpoint: str, ts: str, ttl_seconds: int = TTL_SECONDS, max_entries: int | None = None,
) -> DataFrame:
    """The cache of a stream as of the newest time seen: one row per key; ``max_entries`` keeps only the latest of them."""
    rows = state_rows(spark, checkpoint)
    # the newest row of all is never expired, so the state holds it
    live = rows.filter(F.col(_AT) > rows.agg(F.max(_AT)).scalar() - ttl_seconds * 1_000_000)
    if max_entries is not None:
        live = live.orderBy(F.desc(_AT)).limit(max_entries)
    return live.withColumn(ts, F.timestamp_micros(_AT)).drop(_AT)
