"""Held-out split and bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A classifier with more labels than this has no small sample.
MAX_LABELS = 10_000


def held_out(key: str = "doc_id") -> Column:
    """True for the third of the keys that no classifier may learn from; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(
    docs: DataFrame, key: str, text: str, label: str, rows: int, chars: int, labels: DataFrame | None = None,
    total_chars: int | None = None,
) -> DataFrame:
    """At most ``rows`` rows and about ``chars`` characters of whole texts per label value: ``key, text, label``.

    The label is a column of ``docs``, or comes by ``key`` from ``labels``. With ``total_chars``, labels share so many characters evenly.

    Rows are taken in hash order of the key, so the same data give the same sample. Labels are counted first,
    and only rows whose hash is low enough to be among the first are ranked: a few thousand rows per label, however many
    the table or its partitions. The row limit works on keys and lengths alone, and the few keys taken are sent
    to the texts. A text longer than the whole budget is taken only if it comes first. More than ``MAX_LABELS`` labels
    are an error, since the sample would no longer be small.
    """
    place = F.xxhash64(F.col(key))
    sized = docs.select(key, F.length(text).alias("_n"), *([label] if labels is None else []))
    sized = sized if labels is None else sized.join(labels.select(key, label), key)
    counted = sized.groupBy(label).agg(F.count("*").alias("_rows")).limit(MAX_LABELS + 1).collect()
    if len(counted) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if total_chars is not None:
        chars = min(chars, total_chars // max(1, len(counted)))
    # rows of each label below this hash: several times those wanted, or all
    below = [(r[0], min(2**63 - 1, -(2**63) + (4 * rows + 1000) * 2**64 // r[1])) for r in counted if r[0] is not None]
    schema = f"{label} {sized.schema[label].dataType.simpleString()}, _below long"
    low = sized.join(F.broadcast(docs.sparkSession.createDataFrame(below, schema)), label).filter(place <= F.col("_below"))
    low = low.groupBy(key, label).agg(F.max("_n").alias("_n"))
    order = Window.partitionBy(label).orderBy(place, F.col(key))
    keys = (
        low.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= rows)
        .withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_upto") <= chars) | (F.col("_rank") == 1))
        .select(key, label)
    )
    # at most ``rows`` keys per label value
    on = [key, label] if labels is None else [key]
    chosen = docs.join(F.broadcast(keys), on).select(key, text, label)
    # repeated keys could exceed the bound: equal rows are counted first, so a key repeated a million times is one row to rank
    copies = chosen.groupBy(key, text, label).agg(F.count("*").alias("_copies"))
    before = Window.partitionBy(label).orderBy(place, F.col(key), F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.least("_copies", F.lit(rows) - F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    taken = copies.withColumn("_left", left).filter(F.col("_left") > 0)
    return taken.withColumn("_left", F.explode(F.sequence(F.lit(1), F.col("_left")))).drop("_copies", "_left")
