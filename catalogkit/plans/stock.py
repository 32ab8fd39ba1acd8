"""Joining search results to a client's stock and price feed, and choosing offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogkit.functions.text import trim
from catalogkit.functions.ean import only_digits
from catalogkit.functions.values import format_stock, price_block
from catalogkit.functions.vectors import ranking_score
from catalogkit.operators.aggregates import count_if
from catalogkit.operators.dedupe import first_per_key, top_per_key

# Shortlist length, generic highlights, price tiers and the generic class.
SHORTLIST, HIGHLIGHTS = 7, 3
TIER_LOW, TIER_MIDDLE, TIER_HIGH = "mais_barato", "preco_medio", "mais_caro"
GENERIC = "GENERICO"


def merge_stock(
    results: DataFrame, feed: DataFrame, feed_order: Sequence[str], min_stock: float = 0, group: Sequence[str] = ("query_id",)
) -> DataFrame:
    """Results that the feed has in stock, with score, prices and ``merged_rank`` per ``group``.

    ``results``: group columns, ``doc_id, ean, description, similarity, overlap, exact``. ``feed``:
    ``id, code, ean, description, stock, price, promo_price, discount_pct`` and the order columns.
    Order: score, similarity, lowest price (none last), description.
    """
    joined = _matched(results, feed, feed_order)
    stocked = joined.filter(F.coalesce(F.col("_stock"), F.lit(0.0)) >= min_stock)
    prices = price_block("_price", "_promo_price", "_discount_pct")
    merged = stocked.select(
        *group,
        "doc_id",
        F.col("_digits").alias("ean"),
        F.col("_id").alias("feed_id"),
        F.col("_code").alias("feed_code"),
        "description",
        F.col("_description").alias("feed_description"),
        format_stock("_stock").alias("stock"),
        ranking_score("similarity", "overlap", "exact").alias("score"),
        "similarity",
        prices.alias("prices"),
    )
    window = Window.partitionBy(*group).orderBy(*merged_order())
    return merged.withColumn("merged_rank", F.row_number().over(window))


def merged_order(prices: str = "prices") -> list[Column]:
    return [
        F.desc("score"), F.desc(F.coalesce("similarity", F.lit(0.0))),
        F.col(f"{prices}.sale_price").asc_nulls_last(), F.asc("description"), F.asc("doc_id"),
    ]


def _matched(results: DataFrame, feed: DataFrame, feed_order: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Results beside the first feed row of their code.

    Each task cuts the feed to the first row per code before it is shuffled. Where ``few`` codes are asked for, the feed is cut to these
    before that; with many, such a join would shuffle the whole feed.
    """
    names = ["id", "code", "description", "stock", "price", "promo_price", "discount_pct"]
    keyed = results.withColumn("_digits", only_digits("ean", null_when_empty=True))
    offered = feed.withColumn("_ean", only_digits("ean", null_when_empty=True))
    if few:
        wanted = keyed.filter(F.col("_digits").isNotNull()).select(F.col("_digits").alias("_ean")).distinct()
        offered = offered.join(wanted, "_ean", "left_semi")
    rows = first_per_key(offered, ["_ean"], feed_order).select("_ean", *[F.col(n).alias(f"_{n}") for n in names])
    return keyed.join(rows, F.col("_digits") == F.col("_ean"), how)


def merge_diagnostics(
    results: DataFrame, feed: DataFrame, feed_order: Sequence[str], min_stock: float = 0, group: Sequence[str] = ("query_id",)
) -> DataFrame:
    """The merge's counters per ``group``, and the feed's own two counters."""
    received = feed.agg(F.count("*").alias("feed_received"),
                        F.count_distinct(only_digits("ean", null_when_empty=True)).alias("feed_with_ean"))
    joined = _matched(results, feed, feed_order, "left")
    matched, low = F.col("_ean").isNotNull(), F.coalesce(F.col("_stock"), F.lit(0.0)) < min_stock
    return joined.groupBy(*group).agg(
        received.select("feed_received").scalar().alias("feed_received"),
        received.select("feed_with_ean").scalar().alias("feed_with_ean"),
        F.count("*").alias("results_received"),
        count_if(F.col("_digits").isNotNull()).alias("results_with_ean"),
        count_if(F.col("_digits").isNotNull() & ~matched).alias("missing_match"),
        count_if(matched).alias("matched"),
        count_if(matched & low).alias("low_stock"),
        count_if(matched & ~low).alias("merged"),
    )


def window_sizes(start: int, cap: int) -> list[int]:
    """Search windows tried in turn: doubled up to the cap."""
    sizes = [min(max(start, 1), cap)]
    while sizes[-1] < cap:
        sizes.append(min(cap, max(sizes[-1] + 1, sizes[-1] * 2)))
    return sizes


def expand_window(
    ranked: DataFrame, feed: DataFrame, feed_order: Sequence[str], start: int, cap: int, min_stock: float = 0
) -> DataFrame:
    """Smallest search window per query that holds a stocked row, and the attempts it took.

    ``ranked`` has ``query_id, rank, ean, …`` down to the ``cap`` that the caller sets. A query stops early, with nothing,
    once a window is not filled and holds no row short of stock. Windows follow from ranks: one
    join answers all of them.
    """
    sizes = window_sizes(start, cap)
    joined = _matched(ranked.filter(F.col("rank") <= cap), feed, feed_order, "left", few=True)
    matched = F.col("_ean").isNotNull()
    low = matched & (F.coalesce(F.col("_stock"), F.lit(0.0)) < min_stock)
    per_query = joined.groupBy("query_id").agg(
        F.max("rank").alias("returned"),
        F.min(F.when(matched & ~low, F.col("rank"))).alias("first_stocked"),
        F.min(F.when(low, F.col("rank"))).alias("first_low"),
    )
    attempts, limit, found = None, None, None
    for number, size in reversed(list(enumerate(sizes, 1))):
        hit = F.coalesce(F.col("first_stocked") <= size, F.lit(False))
        goes_on = (F.col("returned") >= size) | F.coalesce(F.col("first_low") <= size, F.lit(False))
        stop = hit | ~goes_on | F.lit(number == len(sizes))
        attempts = F.lit(number) if attempts is None else F.when(stop, number).otherwise(attempts)
        limit = F.lit(size) if limit is None else F.when(stop, size).otherwise(limit)
        found = hit if found is None else F.when(stop, hit).otherwise(found)
    return per_query.select("query_id", attempts.alias("attempts"), limit.alias("window_size"), found.alias("found"))


def offer_candidates(
    products: DataFrame, stock: str = "stock", sale: str = "sale_price", list_price: str = "list_price", promo: str = "promo_price",
    related: str | None = None,
) -> DataFrame:
    """Products that can be offered: described, related, in stock and priced, with ``final_price``.

    The promotional price counts first, then the sale price, then the list price.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    final = F.coalesce(positive(promo), positive(sale), positive(list_price))
    kept = products.filter((F.col("description") != "") & (F.col(stock) > 0))
    kept = kept.filter(F.col(related)) if related else kept
    on_offer = F.col(promo) > 0
    return kept.withColumn("final_price", final).filter(F.col("final_price").isNotNull()).withColumn(
        "has_offer", F.coalesce(on_offer, F.lit(False)))


def offer_tiers(candidates: DataFrame, group: Sequence[str], order: Sequence[str], by_price: bool = True) -> DataFrame:
    """Shortlist of seven per group with ``offer_rank`` and ``tier``.

    By price: the cheapest seven, the first three tagged low, middle and high (two: low and high;
    one: none). By relevance: the first seven in ``order``, keeping a given ``tier``.
    """
    sort = ["final_price", *order] if by_price else list(order)
    short = top_per_key(candidates, group, sort, SHORTLIST, "offer_rank")
    if not by_price:
        return short if "tier" in short.columns else short.withColumn("tier", F.lit(None).cast("string"))
    size = F.count("*").over(Window.partitionBy(*group))
    rank = F.col("offer_rank")
    tier = (
        F.when((size >= 2) & (rank == 1), TIER_LOW)
        .when((size == 2) & (rank == 2), TIER_HIGH)
        .when((size >= 3) & (rank == 2), TIER_MIDDLE)
        .when((size >= 3) & (rank == 3), TIER_HIGH)
    )
    return short.withColumn("tier", tier)


def generic_highlights(
    candidates: DataFrame, shortlist: DataFrame, group: Sequence[str], order: Sequence[str], product_id: str,
    kind: str = "kind",
) -> DataFrame:
    """The three cheapest distinct generics of each group whose shortlist has none."""
    is_generic = F.upper(trim(F.col(kind))) == GENERIC
    covered = shortlist.filter(is_generic).select(*group).distinct()
    generics = candidates.filter(is_generic).join(covered, list(group), "left_anti")
    once = top_per_key(generics, [*group, product_id], order, 1)
    return top_per_key(once, group, ["final_price", *order], HIGHLIGHTS, "highlight_rank")
