"""Requests filled over micro-batches: full ones go at once, the rest when its time is up.

Rows wait in keyed state, one list per lane. A lane sends as soon as it holds enough rows for a request, whichever
micro-batches they came in; a processing-time timer sends what has waited for the flush interval.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from catalogkit.sinks.publish import BATCH_ROWS, SENT, dead_letter_sink, publish_payload, send_batches
from catalogkit.streaming.imports import FLUSH_INTERVAL, start, write_epoch

#: Lanes fill requests side by side; each holds fewer rows than one request needs.
LANES = 8
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}


def milliseconds(interval: str) -> int:
    """``1500 milliseconds`` as a number."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", interval)
    if not found or found[2] not in _UNITS:
        raise ValueError(f"not an interval: {interval}")
    return int(found[1]) * _UNITS[found[2]]


def with_keyed_state(spark: SparkSession, begin: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose operators keep state with timers, for which Spark needs its RocksDB store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return begin()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class FillRequests(StatefulProcessor):
    """Rows of one lane to requests of ``size``."""

    def __init__(self, row_type: str, size: int, wait: int | None, order: Sequence[str]):
        self.row_type, self.size, self.wait, self.order = row_type, size, wait, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row_type)
        self.sent = handle.getValueState("sent", "n long, due long")

    def _requests(self, lane: int, rows: pd.DataFrame, first: int) -> pd.DataFrame:
        return rows.assign(lane=lane, request_no=first + pd.RangeIndex(len(rows)) // self.size)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).drop(columns="lane")
        if self.order:
            new = new.sort_values(self.order, kind="stable")
        n, due = self.sent.get() if self.sent.exists() else (0, 0)
        before = pd.DataFrame(list(self.held.get()), columns=new.columns)
        every = pd.concat([before, new], ignore_index=True) if len(before) else new.reset_index(drop=True)
        full = len(every) - len(every) % self.size
        rest = [tuple(r) for r in every.iloc[full:].itertuples(index=False)]
        if rest:
            self.held.put(rest)
        elif len(before):
            self.held.clear()
        # the timer belongs to the oldest row that waits
        if self.wait is not None and due and (full or not rest):
            self.handle.deleteTimer(due)
            due = 0
        if self.wait is not None and rest and not due:
            due = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(due)
        self.sent.update((n + full // self.size, due))
        if full:
            yield self._requests(key[0], every.iloc[:full], n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, due = self.sent.get()
        rows = list(self.held.get())
        if rows and due <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            self.sent.update((n + 1, 0))
            yield self._requests(key[0], pd.DataFrame(rows, columns=self.columns()), n)

    def columns(self) -> list[str]:
        return [part.strip().split(" ")[0].strip("`") for part in self.row_type.split(",")]

    def close(self) -> None:
        pass


def _row_type(products: DataFrame) -> str:
    """Simple columns only: a comma inside a type would end it."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in products.schema)


def requests_of(
    products: DataFrame, row_id: str = "item_id", size: int = BATCH_ROWS, wait: str | None = FLUSH_INTERVAL,
    order: Sequence[str] = (), lane: Column | None = None, lanes: int = LANES,
) -> DataFrame:
    """``row_id, payload, lane, request_no`` of a stream: requests of exactly ``size`` rows, or fewer after ``wait``.

    Numbers go up within a lane over the whole stream, so ``(lane, request_no)`` names one request. Rows go to lanes by the
    hash of ``row_id``, or as ``lane`` (a whole number) tells; ``order`` orders the rows of a micro-batch. Without ``wait`` rows
    wait for a full request however long; with it the stream looks at the clock all the time, so it never counts as caught up.
    """
    rows = publish_payload(products).select(row_id, "payload", *[c for c in order if c not in (row_id, "payload")])
    kind = _row_type(rows)
    own = F.pmod(F.xxhash64(row_id), F.lit(lanes)) if lane is None else lane
    keyed = rows.withColumn("lane", own.cast("int"))
    return keyed.groupBy("lane").transformWithStateInPandas(
        FillRequests(kind, size, None if wait is None else milliseconds(wait), order),
        f"{kind}, lane int, request_no long", "append", "None" if wait is None else "ProcessingTime",
    )


def waiting_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``lane, request_no`` and the columns of the rows that still wait after a stream has stopped."""
    state = spark.read.format("statestore").option("path", checkpoint)
    held = state.option("stateVarName", "held").option("flattenCollectionTypes", "true").load()
    sent = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "sent").load()
    rows = held.select(F.col("key.lane").alias("lane"), "list_element.*")
    numbers = sent.select(F.col("key.lane").alias("lane"), F.col("value.n").alias("request_no"))
    return rows.join(numbers, "lane")


def _store(requests: DataFrame, send: Callable[[str], None], out: str, name: str, row_id: str, size: int) -> None:
    """Send whole requests and store their outcome under ``name``."""
    spark = requests.sparkSession
    stage = lambda part: f"{out}/{part}/{name}"
    requests.withColumn("batch_no", F.struct("lane", "request_no")).write.mode("overwrite").parquet(stage("staged"))
    staged = spark.read.parquet(stage("staged"))
    send_batches(staged, send, row_id, size).write.mode("overwrite").parquet(stage("outcome"))
    answered = staged.join(spark.read.parquet(stage("outcome")), row_id).drop("batch_no")
    answered.filter("error is null").withColumn("status", F.lit(SENT)).write.mode("overwrite").parquet(stage("sent"))
    dead_letter_sink(answered).write.mode("overwrite").parquet(stage("dead"))


def publish_requests(
    products: DataFrame, send: Callable[[str], None], out: str, checkpoint: str, row_id: str = "item_id",
    size: int = BATCH_ROWS, wait: str | None = FLUSH_INTERVAL, interval: str | None = None, order: Sequence[str] = (),
    lane: Column | None = None, lanes: int = LANES,
) -> StreamingQuery:
    """Publish a stream in requests that are filled over micro-batches (see ``requests_of``); failed ones go to ``out/dead``.

    A lane sends when it holds ``size`` rows or its oldest row has waited for ``wait``, which needs an ``interval``. A stream
    that ends when it is caught up has neither and leaves rows waiting: ``publish_waiting`` sends them. A repeated micro-batch writes its own folders again and sends again.
    """
    if wait is not None and interval is None:
        raise ValueError("waiting rows need a stream that goes on: name an interval, or no wait")
    requests = requests_of(products, row_id, size, wait, order, lane, lanes)

    def handle(df: DataFrame, epoch: int) -> None:
        _store(df, send, out, f"epoch={epoch}", row_id, size)

    return with_keyed_state(products.sparkSession, lambda: start(requests, handle, checkpoint, interval))


def publish_waiting(spark: SparkSession, send: Callable[[str], None], out: str, checkpoint: str, row_id: str = "item_id", size: int = BATCH_ROWS) -> None:
    """Send what waits after the last micro-batch of a stream that has ended for good."""
    _store(waiting_rows(spark, checkpoint), send, out, "epoch=-1", row_id, size)
