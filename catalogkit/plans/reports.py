"""Reports over imports and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalogkit.functions.values import json_parse_or_keep
from catalogkit.operators.aggregates import count_if
from catalogkit.operators.dedupe import top_per_key


def import_report(batches: DataFrame, children: dict[str, DataFrame], batch: str = "batch_id") -> DataFrame:
    """One row per batch with ``<child>_count``; each child is aggregated before the join."""
    report = batches
    for name, child in children.items():
        counts = child.groupBy(batch).agg(F.count("*").alias(f"{name}_count"))
        report = report.join(counts, batch, "left")
    zeros = {f"{name}_count": F.coalesce(F.col(f"{name}_count"), F.lit(0)) for name in children}
    return report.withColumns(zeros)


def import_report_rows(children: dict[str, DataFrame], batch: str = "batch_id", row_id: str = "row_id") -> DataFrame:
    """All child rows as ``(batch, section, row_id, content)``, JSON text fields parsed.

    The rows are the report's nested lists in long form, so a batch of any size stays spread.
    """
    parts = []
    for name, child in children.items():
        fields = [
            json_parse_or_keep(c).alias(c) if c.endswith("_json") else F.col(c)
            for c in child.columns if c not in (batch, row_id)
        ]
        content = F.to_json(F.struct(*fields))
        parts.append(child.select(batch, F.lit(name).alias("section"), F.col(row_id).cast("string").alias("row_id"), content.alias("content")))
    return reduce(lambda a, b: a.unionByName(b), parts)



def quality_report(
    snapshots: DataFrame, key: str, snapshot: str, legacy: str | None = None, include_legacy: bool = False
) -> DataFrame:
    """Rows found, included, duplicate and skipped per snapshot, and in total (snapshot null).

    A key counts as included in the snapshot that supplies it, the one with the highest name.
    """
    is_legacy = F.col(legacy) if legacy else F.lit(False)
    skipped = is_legacy if not include_legacy else F.lit(False)
    rows = snapshots.select(key, snapshot, skipped.alias("_skipped"))
    used = rows.filter(~F.col("_skipped"))
    included = top_per_key(used.select(key, snapshot), [key], [F.desc(snapshot)], 1)
    per_snapshot = included.groupBy(snapshot).agg(F.count("*").alias("_included"))
    found = rows.groupBy(snapshot).agg(F.count("*").alias("found"), count_if(F.col("_skipped")).alias("skipped"))
    joined = found.join(per_snapshot, snapshot, "left").withColumn("included", F.coalesce("_included", F.lit(0)))
    return joined.rollup(snapshot).agg(
        F.sum("found").alias("found"),
        F.sum("included").alias("included"),
        F.sum(F.col("found") - F.col("skipped") - F.col("included")).alias("duplicates"),
        F.sum("skipped").alias("skipped"),
    )
