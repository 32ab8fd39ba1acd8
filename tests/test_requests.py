"""Requests filled over micro-batches."""

import json
import time

import pytest
from pyspark.sql import functions as F

from catalogkit.streaming.imports import read_table_stream
from catalogkit.streaming.requests import milliseconds, publish_requests, publish_waiting


def folder_of(spark, path, rows=70, files=10):
    df = spark.range(rows).select(F.col("id").alias("item_id"), F.concat(F.lit("item "), "id").alias("description"), F.lit("1").alias("ean"))
    for n in range(files):
        df.filter((F.col("item_id") >= n * rows // files) & (F.col("item_id") < (n + 1) * rows // files)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def receiver(folder):
    """Notes every request as a file."""
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)

    def send(body):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(body)

    return send


def received(folder):
    import os

    out = []
    for name in os.listdir(folder):
        sent = json.loads(open(f"{folder}/{name}").read())
        out.append(sorted(int(p["descricaoProduto"].split(" ")[1]) for p in sent.get("products", [sent])))
    return sorted(out)


def test_micro_batches_of_seven_give_requests_of_ten(spark, tmp_path):
    folder_of(spark, str(tmp_path / "in"), 74, 10)
    stream = read_table_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    send = receiver(str(tmp_path / "got"))
    run = publish_requests(stream, send, out, check, wait=None, order=["item_id"], lanes=1)
    run.awaitTermination()
    assert len({p["batchId"] for p in run.recentProgress if p["numInputRows"]}) == 10
    assert received(str(tmp_path / "got")) == [list(range(n, n + 10)) for n in range(0, 70, 10)]
    publish_waiting(spark, send, out, check)
    assert received(str(tmp_path / "got"))[-1] == [70, 71, 72, 73]
    sent = spark.read.parquet(f"{out}/sent")
    assert sent.count() == 74 and sent.select("lane", "request_no").distinct().count() == 8
    assert spark.read.parquet(f"{out}/dead").count() == 0


def test_rows_that_waited_go_at_the_interval(spark, tmp_path):
    folder_of(spark, str(tmp_path / "in"), 13, 1)
    stream = read_table_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    run = publish_requests(
        stream, receiver(str(tmp_path / "got")), str(tmp_path / "out"), str(tmp_path / "check"), wait="2 seconds", interval="500 milliseconds",
        order=["item_id"], lanes=1,
    )
    try:
        until = time.time() + 60
        while time.time() < until and len(received(str(tmp_path / "got"))) < 2:
            time.sleep(0.5)
    finally:
        run.stop()
    assert received(str(tmp_path / "got")) == [list(range(10)), [10, 11, 12]]


def test_intervals():
    assert milliseconds("1500 milliseconds") == 1500 and milliseconds("2 seconds") == 2000 and milliseconds("1 minute") == 60_000
    with pytest.raises(ValueError):
        milliseconds("soon")
