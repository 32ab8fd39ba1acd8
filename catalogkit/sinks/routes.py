"""Review and mirror rows of processed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogkit.functions.values import field_type


def _json_of(df: DataFrame, name: str):
    kind = field_type(df.schema, name)
    if kind is None:
        return F.lit(None).cast("string")
    return F.col(name) if kind.simpleString() == "string" else F.to_json(name)


def review_sink(items: DataFrame) -> DataFrame:
    """Items that need approval, with the reason and what is known of them."""
    content = _json_of(items, "product" if "product" in items.columns else "raw")
    return items.filter("requires_approval").select(
        "batch_id",
        "item_id",
        "ean",
        F.col("received_name").alias("suggested_name"),
        F.col("approval_reason").alias("reason"),
        "source",
        content.alias("content"),
        F.lit("pending").alias("review_status"),
    )


def audit_mirror(items: DataFrame, source: str) -> DataFrame:
    """One source's items as received, as enriched and as published."""
    return items.filter(F.col("source") == source).select(
        "batch_id",
        "item_id",
        "ean",
        "status",
        _json_of(items, "raw").alias("original"),
        _json_of(items, "product").alias("enriched"),
        _json_of(items, "payload").alias("payload"),
    )
