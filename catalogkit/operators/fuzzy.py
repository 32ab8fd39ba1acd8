"""Matching tokens within a bounded edit distance by equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.functions.text import bounded_levenshtein, fuzzy_bound, is_numeric_token

# A string within distance d of another shares at least one of its d+1 segments, moved by at
# most d places. Segment lengths are fixed by the query token's length, so both sides can
# compute the same join key.


def _segments(length: Column, bound: int) -> Column:
    """``array<struct<part, start, size>>``: even cuts of a token of that length, 1-based."""
    parts = bound + 1
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    cells, start = [], F.lit(1)
    for i in range(parts):
        size = base + F.when(F.lit(i) < rest, 1).otherwise(0)
        cells.append(F.struct(F.lit(i).alias("part"), start.cast("int").alias("start"), size.alias("size")))
        start = start + size
    return F.array(*cells)


def _query_keys(queries: DataFrame, bound: int) -> DataFrame:
    length = F.length("query_token")
    cut = queries.select("query_token", F.inline(_segments(length, bound)))
    return cut.select(
        "query_token",
        F.length("query_token").alias("_len"),
        F.col("part").alias("_part"),
        F.expr("substring(query_token, start, size)").alias("_segment"),
    )


def _token_keys(tokens: DataFrame, bound: int, low: int, high: int | None) -> DataFrame:
    """Keys for query tokens of ``low`` to ``high`` characters."""
    length = F.length("token")
    near = F.sequence(length - bound, length + bound)
    sizes = tokens.select("token", F.explode(near).alias("_len")).filter(F.col("_len") >= low)
    sizes = sizes.filter(F.col("_len") <= high) if high else sizes
    cut = sizes.select("token", "_len", F.inline(_segments(F.col("_len"), bound)))
    moved = cut.select("token", "_len", "part", "size", F.explode(F.sequence(F.col("start") - bound, F.col("start") + bound)).alias("_at"))
    inside = moved.filter((F.col("_at") >= 1) & (F.col("_at") + F.col("size") - 1 <= length))
    return inside.select(
        "token", "_len", F.col("part").alias("_part"), F.expr("substring(token, _at, size)").alias("_segment")
    )


def _pairs(asked: DataFrame, known: DataFrame, bound: int, low: int, high: int | None) -> DataFrame:
    pairs = _token_keys(known, bound, low, high).join(_query_keys(asked, bound), ["_len", "_part", "_segment"])
    near = pairs.withColumn("distance", bounded_levenshtein("query_token", "token", bound))
    return near.filter(F.col("distance").isNotNull()).select("query_token", "token", "distance")


def near_token_pairs(queries: DataFrame, tokens: DataFrame, query_col: str, token_col: str, bound: int) -> DataFrame:
    """``(query_token, token, distance)`` for every pair of distinct tokens within ``bound``, whatever their length.

    Segments of tokens of up to ``bound`` characters may be empty; such tokens meet all of like length, of which there
    are few.
    """
    asked = queries.select(F.col(query_col).alias("query_token")).filter("query_token is not null").distinct()
    known = tokens.select(F.col(token_col).alias("token")).filter("token is not null").distinct()
    return _pairs(asked, known, bound, 0, None).distinct()


def match_token_pairs(queries: DataFrame, tokens: DataFrame, query_col: str, token_col: str) -> DataFrame:
    """``(query_token, token, distance)`` for every pair within the query token's allowed distance.

    Numbers are skipped and tokens shorter than five characters have no allowance. Both sides are
    made distinct first; candidates meet on (length, segment number, segment text), and the sizes measured at run time
    decide how.
    """
    asked = queries.select(F.col(query_col).alias("query_token")).distinct()
    asked = asked.filter(~is_numeric_token("query_token"))
    known = tokens.select(F.col(token_col).alias("token")).distinct().filter(~is_numeric_token("token"))
    found = None
    for bound, low, high in ((1, 5, 9), (2, 10, None)):
        near = _pairs(asked.filter(fuzzy_bound("query_token") == bound), known, bound, low, high)
        found = near if found is None else found.unionByName(near)
    return found.distinct()
