"""Publishing product payloads in batches, with a dead-letter table for the ones that failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogkit.operators.ordering import chunk
from catalogkit.session import new_work_path

# Payload fields, in order, and the status of rows waiting to be sent again.
PAYLOAD_FIELDS = {
    "descricaoProduto": "description",
    "ean": "ean",
    "principioAtivo": "active_ingredient",
    "classificacao": "classification",
    "nomeSocial": "social_name",
    "fabricante": "manufacturer",
    "departamento": "department",
    "categoria": "category",
    "subcategoria": "subcategory",
    "segmento": "segment",
    "subsegmento": "subsegment",
    "detalhes": "details",
}
PENDING, REPLAYED, SENT = "pending_replay", "replayed", "published"
BATCH_ROWS = 10
BATCH_NO = "batch_no"


def publish_payload(products: DataFrame) -> DataFrame:
    """Add ``payload``: the product's JSON, empty optional fields left out."""
    fields = [
        (F.col(c) if target in ("descricaoProduto", "ean") else F.nullif(F.col(c).cast("string"), F.lit(""))).alias(target)
        for target, c in PAYLOAD_FIELDS.items()
        if c in products.columns
    ]
    return products.withColumn("payload", F.to_json(F.struct(*fields)))


def batch_body(payloads: Sequence[str]) -> str:
    """Request body: a single product as it is, several under ``products``."""
    return payloads[0] if len(payloads) == 1 else '{"products":[' + ",".join(payloads) + "]}"


def send_batches(rows: DataFrame, send: Callable[[str], None], row_id: str, size: int = BATCH_ROWS) -> DataFrame:
    """Call ``send`` with batches of up to ``size`` payloads, in the tasks; ``(row_id, error)`` per row.

    When a batch fails all of its rows carry the error. Rows numbered by :func:`number_batches` are sent
    together by that number, others as they stand in their task. The result must be stored before it is
    used, since computing it again would send again; a task that is retried sends its rows again,
    so the receiver should upsert by code.
    """
    schema = f"{row_id} {rows.schema[row_id].dataType.simpleString()}, error string"

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames sorted by number to one frame a number; only the last number of a frame may go on in the next."""
        left = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            number = frame[BATCH_NO].to_numpy()
            starts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(frame)]
            if len(starts) > 2:
                yield answers(frame.iloc[: starts[-2]], starts[:-1])
            left = frame.iloc[starts[-2] :]
        if left is not None and len(left):
            yield answers(left, [0, len(left)])

    def answers(frame: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        payloads, errors = frame["payload"].tolist(), []
        for begin, end in zip(starts, starts[1:]):
            for low in range(begin, end, size):
                errors += answer(payloads[low : min(low + size, end)])
        return pd.DataFrame({row_id: frame[row_id], "error": pd.Series(errors, index=frame.index, dtype=object)})

    def answer(group: list[str]) -> list[str | None]:
        try:
            send(batch_body(group))
            return [None] * len(group)
        except Exception as error:  # the batch goes to the dead-letter table
            return [str(error)] * len(group)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield answers(frame, [0, len(frame)])

    if BATCH_NO in rows.columns:
        # many requests a task, one after the other: a group of Spark's own for each costs far more than its rows
        named = rows.select(row_id, "payload", F.col(BATCH_NO).cast("string").alias(BATCH_NO))
        return named.repartition(BATCH_NO).sortWithinPartitions(BATCH_NO).mapInPandas(numbered, schema)
    return rows.select(row_id, "payload").mapInPandas(run, schema)


def number_batches(rows: DataFrame, order: Sequence[str], size: int = BATCH_ROWS) -> DataFrame:
    """Add ``batch_no`` for requests of ``size`` consecutive rows in ``order``; without an order, ``rows`` as they are."""
    return chunk(rows, list(order), size, BATCH_NO) if order else rows


def dead_letter_sink(answered: DataFrame, error: str = "error") -> DataFrame:
    """All rows of failed batches, waiting to be sent again."""
    return answered.filter(F.col(error).isNotNull()).withColumn("status", F.lit(PENDING))


def publish(
    rows: DataFrame, send: Callable[[str], None], sent_path: str, dead_path: str, row_id: str, size: int = BATCH_ROWS,
    order: Sequence[str] = (),
) -> None:
    """Send ``rows`` (with ``payload``) once and append them to the sent or the dead-letter table.

    With ``order``, requests are consecutive rows in that order.
    """
    spark = rows.sparkSession
    source = new_work_path(spark, "publish-rows")
    number_batches(rows, order, size).write.parquet(source)
    stored = spark.read.parquet(source)
    outcome = new_work_path(spark, "publish-outcome")
    send_batches(stored, send, row_id, size).write.parquet(outcome)
    answered = stored.join(spark.read.parquet(outcome), row_id)
    answered.filter(F.col("error").isNull()).withColumn("status", F.lit(SENT)).write.mode("append").parquet(sent_path)
    dead_letter_sink(answered).write.mode("append").parquet(dead_path)


def replay(
    spark: SparkSession, dead_path: str, send: Callable[[str], None], sent_path: str, row_id: str, size: int = BATCH_ROWS
) -> DataFrame:
    """Send the dead-letter table's pending rows again; returns the table's new content.

    Rows that go through join the sent table, the others stay pending with their new error. The
    caller writes the result as the next dead-letter table.
    """
    table = spark.read.parquet(dead_path)
    pending = table.filter(F.col("status") == PENDING)
    outcome = new_work_path(spark, "replay-outcome")
    send_batches(pending, send, row_id, size).write.parquet(outcome)
    again = spark.read.parquet(outcome).select(row_id, F.col("error").alias("_error"), F.lit(True).alias("_tried"))
    joined = table.join(again, row_id, "left")
    passed = F.col("_tried").isNotNull() & F.col("_error").isNull()
    sent = joined.filter(passed).withColumn("error", F.lit(None).cast("string")).withColumn("status", F.lit(SENT))
    sent.select(*table.columns).write.mode("append").parquet(sent_path)
    return joined.withColumn("status", F.when(passed, REPLAYED).otherwise(F.col("status"))).withColumn(
        "error", F.coalesce("_error", "error")
    ).select(*table.columns)
