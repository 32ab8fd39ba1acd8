"""Import triage: invalid, duplicate, already known, eligible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from catalogkit.functions.ean import validate_ean
from catalogkit.functions.values import computed_once
from catalogkit.operators.aggregates import count_if
from catalogkit.operators.dedupe import top_per_key

INVALID, DUPLICATE, EXISTING, ELIGIBLE = "invalid", "duplicate", "existing", "eligible"

# What a skipped item's message says around its code.
DUPLICATE_TEXT = "Produto descartado por EAN duplicado no lote do provedor: "


def drop_existing(items: DataFrame, catalog: DataFrame, ean: str = "ean", out: str = "exists_in_catalog") -> DataFrame:
    """Add ``out``: whether the item's code is in the catalogue. Both sides are reduced to codes first."""
    known = catalog.select(F.col(ean).alias("_known")).distinct()
    return items.join(known, F.col(ean) == F.col("_known"), "left").withColumn(out, F.col("_known").isNotNull()).drop("_known")


def missing_keys(requests: DataFrame, catalog: DataFrame, ean: str = "ean") -> DataFrame:
    """Distinct requested codes that the catalogue lacks."""
    return requests.select(ean).distinct().join(catalog.select(ean), ean, "left_anti")


def triage(
    items: DataFrame, catalog: DataFrame, batch: Sequence[str] = ("batch_id",), ean: str = "ean",
    order: Sequence[str] = ("item_id",), item_id: str = "item_id", mode: str = "left", enabled: bool = True,
) -> DataFrame:
    """Add ``valid_ean``, ``ean_reason``, ``triage`` and ``triage_message``.

    Only the first valid row of each code in a batch probes the catalogue; the verdict returns
    to the rows over their unique id. Invalid rows stay in and fail later, in publishing.
    With ``enabled`` off (file imports) every row is eligible.
    """
    rows = computed_once(items, _check=validate_ean(ean, mode))
    rows = rows.select("*", F.col("_check.ean").alias("valid_ean"), F.col("_check.is_valid").alias("_valid"),
                       F.col("_check.reason").alias("ean_reason")).drop("_check")
    if not enabled:
        return rows.withColumn("triage", F.when(F.col("_valid"), ELIGIBLE).otherwise(INVALID)).withColumn(
            "triage_message", F.lit(None).cast("string")).drop("_valid")
    keys = [*batch, "valid_ean"]
    narrow = rows.filter("_valid").select(*dict.fromkeys([*keys, *order, item_id]))
    firsts = top_per_key(narrow, keys, [*order, item_id], 1)
    # the catalogue is not made distinct: repeats are taken out of the few rows that met it
    probed = firsts.join(catalog.select(F.col(ean).alias("_known")), F.col("valid_ean") == F.col("_known"), "left")
    met = F.max(F.col("_known").isNotNull())
    verdict = probed.groupBy(item_id).agg(F.when(met, EXISTING).otherwise(ELIGIBLE).alias("_verdict"))
    placed = rows.join(verdict, item_id, "left")
    state = F.when(~F.col("_valid"), INVALID).otherwise(F.coalesce(F.col("_verdict"), F.lit(DUPLICATE)))
    message = F.when(state == DUPLICATE, F.concat(F.lit(DUPLICATE_TEXT), F.col("valid_ean"), F.lit("."))).when(
        state == EXISTING, F.concat(F.lit("Produto descartado porque o EAN "), F.col("valid_ean"), F.lit(" ja existe no catalogo."))
    )
    return placed.withColumn("triage", state).withColumn("triage_message", message).drop("_verdict", "_valid")


def triage_summary(triaged: DataFrame, batch: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Counts per batch; ``to_process`` is what goes on to enrichment, invalid rows included."""
    state = F.col("triage")
    return triaged.groupBy(*batch).agg(
        F.count("*").alias("staged"),
        count_if(state == INVALID).alias("invalid"),
        count_if(state == DUPLICATE).alias("duplicate"),
        count_if(state == EXISTING).alias("existing"),
        count_if(state.isin(INVALID, ELIGIBLE)).alias("to_process"),
    )
