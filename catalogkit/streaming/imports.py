"""Imports as streams: staging, de-duplication, known codes, enrichment, publishing and counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogkit.functions.ean import validate_ean
from catalogkit.functions.values import computed_once
from catalogkit.operators.aggregates import import_counters
from catalogkit.plans.bucketed import BucketedCatalog, known_codes
from catalogkit.plans.triage import DUPLICATE, ELIGIBLE, EXISTING, triage
from catalogkit.sinks.publish import BATCH_ROWS, SENT, dead_letter_sink, number_batches, publish_payload, send_batches

# Fixed value: longest wait before a partial batch is sent.
FLUSH_INTERVAL = "1500 milliseconds"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder whose name matches, as a stream."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``handle``; without an interval it stops when caught up."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Store one micro-batch; a repeated micro-batch replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def dedupe_stream(
    items: DataFrame, scope: Sequence[str] = ("batch_id",), ean: str = "ean",
    watermark: tuple[str, str] | None = None, unbounded: bool = False,
) -> DataFrame:
    """First valid row of each code per scope, over the whole stream.

    ``watermark`` (event time column, delay) bounds the state. A stream that ends, as an import does, may
    ask for ``unbounded`` state instead: one entry per code and scope.
    """
    if not watermark and not unbounded:
        raise ValueError("name a watermark, or ask for unbounded state")
    checked = computed_once(items, _c=validate_ean(ean)).filter("_c.is_valid")
    valid = checked.withColumn("valid_ean", F.col("_c.ean")).drop("_c")
    keys = [*scope, "valid_ean"]
    if watermark:
        return valid.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return valid.dropDuplicates(keys)


def exclude_known(items: DataFrame, catalog: DataFrame, ean: str = "valid_ean", catalog_ean: str = "ean") -> DataFrame:
    """Stream rows whose code the catalogue lacks; the catalogue is read anew for each micro-batch."""
    known = catalog.select(F.col(catalog_ean).alias("_known"))
    return items.join(known, F.col(ean) == F.col("_known"), "left_anti")


def enrich_stream(items: DataFrame, answers: DataFrame, ean: str = "valid_ean") -> DataFrame:
    """Stream rows with their code's answers ``(ean, …)``, one answer per code."""
    return items.join(answers.withColumnRenamed("ean", "_ean"), F.col(ean) == F.col("_ean"), "left").drop("_ean")


#: Micro-batches whose codes are gathered into one folder of the history.
COMPACT = 16
_BUCKET, _BUCKETS = "code_bucket", 64


def _history(spark: SparkSession, path: str, epoch: int, buckets: list[int] | None, schema: str) -> DataFrame:
    """Codes of micro-batches before ``epoch`` in the named buckets: the last gathered folder, and those since."""
    since = epoch - epoch % COMPACT
    folders = [f"{path}/upto={since}"] * (since > 0) + [f"{path}/epoch={n}" for n in range(since, epoch)]
    if not folders:
        return spark.createDataFrame([], schema)
    names = [part.split(" ")[0] for part in schema.split(", ")]
    read = lambda folder: spark.read.schema(f"{schema}, {_BUCKET} int").parquet(folder)
    found = read(folders[0])
    for folder in folders[1:]:
        found = found.unionByName(read(folder))
    return (found if buckets is None else found.filter(F.col(_BUCKET).isin(buckets))).select(*names)


def _remember(codes: DataFrame, path: str, epoch: int, schema: str) -> None:
    """Store a micro-batch's codes by bucket; every ``COMPACT`` micro-batches all so far become one folder."""
    by_bucket = lambda df: df.withColumn(_BUCKET, F.pmod(F.xxhash64("valid_ean"), F.lit(_BUCKETS)).cast("int"))
    by_bucket(codes).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/epoch={epoch}")
    if (epoch + 1) % COMPACT == 0:
        whole = _history(codes.sparkSession, path, epoch, None, schema).unionByName(codes.select(*[p.split(" ")[0] for p in schema.split(", ")]))
        by_bucket(whole).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/upto={epoch + 1}")


def import_stream(
    items: DataFrame, catalog: DataFrame | BucketedCatalog, out: str, checkpoint: str, batch: Sequence[str] = ("batch_id",),
    item_id: str = "item_id", process: Callable[[DataFrame, int], None] | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Triage every micro-batch and store all of its rows with their verdict under ``out``.

    Codes met in earlier micro-batches of the same import are duplicates; they are kept in a table
    beside the rows, so a restarted stream knows them. That table lies in buckets by code and is gathered every ``COMPACT``
    micro-batches, and a micro-batch reads only the buckets of its own codes. Of a ``BucketedCatalog`` it likewise reads only buckets
    with codes that the Bloom filters let through. ``process`` receives the rows that go on
    (eligible and invalid), e.g. to enrich and publish them. A repeated micro-batch overwrites what
    it wrote before.
    """
    rows_path, seen_path = f"{out}/rows", f"{out}/seen"

    def handle(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join([*(f"{b} {types[b]}" for b in batch), "valid_ean string"])
        asked = computed_once(df, _c=validate_ean("ean")).filter("_c.is_valid")
        asked = asked.select(*batch, F.col("_c.ean").alias("valid_ean")).distinct()
        touched = sorted(r[0] for r in asked.select(F.pmod(F.xxhash64("valid_ean"), F.lit(_BUCKETS)).cast("int")).distinct().collect())
        # the history is reduced to the micro-batch's codes; at run time the smaller side decides how
        seen = _history(spark, seen_path, epoch, touched, schema).join(asked, [*batch, "valid_ean"], "left_semi")
        seen = seen.withColumn("_seen", F.lit(True))
        known = known_codes(catalog, asked, "valid_ean").withColumnRenamed("valid_ean", "ean") if isinstance(catalog, BucketedCatalog) else catalog
        placed = triage(df, known, batch, order=(item_id,), item_id=item_id)
        marked = placed.join(seen, [*batch, "valid_ean"], "left")
        again = F.col("_seen") & F.col("triage").isin(ELIGIBLE, EXISTING)
        final = marked.withColumn("triage", F.when(again, DUPLICATE).otherwise(F.col("triage"))).drop("_seen")
        write_epoch(final, rows_path, epoch)
        stored = spark.read.parquet(f"{rows_path}/epoch={epoch}")
        fresh = stored.filter(F.col("triage").isin(ELIGIBLE, EXISTING)).select(*batch, "valid_ean")
        _remember(fresh, seen_path, epoch, schema)
        if process is not None:
            process(stored.filter(~F.col("triage").isin(DUPLICATE, EXISTING)), epoch)

    return start(items, handle, checkpoint, interval)


def publish_stream(
    products: DataFrame, send: Callable[[str], None], out: str, checkpoint: str, row_id: str = "item_id",
    size: int = BATCH_ROWS, interval: str | None = None, order: Sequence[str] = (),
) -> StreamingQuery:
    """Publish each micro-batch in requests of up to ``size`` rows; failed requests go to ``out/dead``.

    With ``order``, requests are consecutive rows in that order, else rows that stand together.

    Partial requests are sent at the end of a micro-batch, so ``interval`` is the flush time. The
    outcome is stored before it is split, hence rows are not sent twice by a later read.
    """

    def handle(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        write_epoch(number_batches(publish_payload(df), order, size), f"{out}/staged", epoch)
        staged = spark.read.parquet(f"{out}/staged/epoch={epoch}")
        write_epoch(send_batches(staged, send, row_id, size), f"{out}/outcome", epoch)
        answered = staged.join(spark.read.parquet(f"{out}/outcome/epoch={epoch}"), row_id)
        write_epoch(answered.filter("error is null").withColumn("status", F.lit(SENT)), f"{out}/sent", epoch)
        write_epoch(dead_letter_sink(answered), f"{out}/dead", epoch)

    return start(products, handle, checkpoint, interval)


def running_counters(items: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Counters per import so far, rewritten after every micro-batch in one of two folders under ``out``."""

    def handle(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{'even' if epoch % 2 == 0 else 'odd'}")

    return start(import_counters(items), handle, checkpoint, interval, mode="complete")


def latest_counters(spark: SparkSession, out: str, last_epoch: int) -> DataFrame:
    return spark.read.parquet(f"{out}/{'even' if last_epoch % 2 == 0 else 'odd'}")
