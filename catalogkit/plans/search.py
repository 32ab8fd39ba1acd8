"""Batch catalogue search with vector and word signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.functions.ean import exact_ean_from_query
from catalogkit.functions.text import fuzzy_equal, normalize_match_text, normalize_search_text, tokenize
from catalogkit.functions.vectors import DEFAULT_DIMENSIONS, hash_vector
from catalogkit.operators.ordering import page_size
from catalogkit.operators.postings import Postings, short_topk
from catalogkit.operators.topk import CORPUS_ROWS, QUERY_ROWS, scored_topk

# A query of at most two tokens is short; fuzzy hits need this similarity.
SHORT_TOKENS = 2
RELIABLE_SIMILARITY = 0.45

# Product fields a result is matched by.
RESULT_FIELDS = ["ean", "description", "active_ingredient", "classification", "social_name", "manufacturer"]


def prepare_queries(
    queries: DataFrame, text: str = "query", query_id: str = "query_id", dims: int = DEFAULT_DIMENSIONS,
    vector: str | None = None, explicit_ean: str | None = None, max_tokens: int | None = None,
) -> DataFrame:
    """Queries with normal form, tokens, code, length class and vector; those without a token are dropped.

    ``vector`` names a ready-made embedding column; without it tokens are hashed.
    """
    tokens = queries.withColumn("query_tokens", tokenize(text, max_tokens)).filter(F.size("query_tokens") > 0)
    return tokens.select(
        F.col(query_id).alias("query_id"),
        F.col(text).alias("query"),
        normalize_search_text(text).alias("normalized_query"),
        "query_tokens",
        exact_ean_from_query(text, explicit_ean).alias("query_ean"),
        (F.size("query_tokens") <= SHORT_TOKENS).alias("is_short"),
        (F.col(vector) if vector else hash_vector("query_tokens", dims)).alias("query_vector"),
    )


def hybrid_search(
    prepared: DataFrame, corpus: DataFrame, limit: int | None = None, offset: int = 0, min_score: float | None = None,
    max_limit: int | None = None, query_rows: int = QUERY_ROWS, corpus_rows: int = CORPUS_ROWS,
    postings: Postings | None = None,
) -> DataFrame:
    """One page of ranked results per query.

    ``corpus``: ``doc_id, vector, tokens, ean, recency``. Result: ``query_id, doc_id, similarity,
    overlap, exact, is_short, rank, position, has_more``. One row beyond the page tells whether
    more follow. ``max_limit`` bounds the page where a caller wants that. With ``postings`` of the corpus, short
    queries score only rows that can enter the page; the result is the same.
    """
    limit = page_size(limit, max_limit)
    k, blocks = offset + limit + 1, dict(query_rows=query_rows, corpus_rows=corpus_rows)
    if postings is None:
        best = scored_topk(prepared, corpus, k, min_score, **blocks)
    else:
        short, rest = short_topk(prepared.filter("is_short"), corpus, postings, k, min_score)
        # one pass over the corpus for long queries and for short ones that few rows answer
        whole = prepared.filter(~F.col("is_short")).unionByName(rest)
        best = scored_topk(whole, corpus, k, min_score, **blocks).unionByName(short)
    beyond = best.groupBy("query_id").agg((F.max("rank") > offset + limit).alias("has_more"))
    kept = best.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return kept.withColumn("position", F.col("rank") - offset).join(beyond, "query_id")


def reliable_filter(results: DataFrame, result_tokens: str = "result_tokens", query_tokens: str = "query_tokens") -> DataFrame:
    """Drop weak hits of short queries.

    Kept are exact codes, shared words, and similarities of at least 0.45 with a word within the
    allowed edit distance. It works on a page already cut, which may therefore come out shorter.
    """
    near = F.exists(
        query_tokens, lambda q: F.exists(F.array_distinct(F.col(result_tokens)), lambda t: fuzzy_equal(q, t))
    )
    keep = (
        ~F.col("is_short") | (F.col("exact") > 0) | (F.col("overlap") > 0)
        | ((F.col("similarity") >= RELIABLE_SIMILARITY) & near)
    )
    return results.filter(keep)


def result_text(fields: Sequence[str] = RESULT_FIELDS) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields])


def apply_relevance(results: DataFrame, notes: DataFrame | None) -> DataFrame:
    """Attach outside relevance notes ``(query_id, doc_id, score, reason)``; missing or invalid stay null."""
    if notes is None:
        return results.withColumn("relevance_score", F.lit(None).cast("int")).withColumn(
            "relevance_reason", F.lit(None).cast("string"))
    whole = F.col("score").try_cast("double")
    given = notes.select(
        "query_id", "doc_id", F.when(whole == F.floor(whole), whole.cast("int")).alias("relevance_score"),
        F.col("reason").alias("relevance_reason"),
    )
    return results.join(given, ["query_id", "doc_id"], "left")


def benchmark_match(cases: DataFrame, results: DataFrame, haystack: str = "haystack") -> DataFrame:
    """Per case, whether a matcher hits within its top-k and the rank of the first hit.

    ``cases``: ``query_id, category, expected_top_k, matchers array<struct<ean, all_of, any_of>>``.
    ``results``: ``query_id, rank, ean`` and the result's text in ``haystack``. A matcher with no
    condition never hits.
    """
    term = normalize_match_text
    empty = F.array().cast("array<string>")

    def hits(m: Column) -> Column:
        code, every, some = F.nullif(m["ean"], F.lit("")), F.coalesce(m["all_of"], empty), F.coalesce(m["any_of"], empty)
        contains = lambda t: F.contains(F.col("_hay"), term(t))
        return (
            (code.isNull() | (F.coalesce(F.col("ean"), F.lit("")) == code))
            & F.forall(every, contains)
            & ((F.size(some) == 0) | F.exists(some, contains))
            & (code.isNotNull() | (F.size(every) > 0) | (F.size(some) > 0))
        )

    top_k = F.greatest(F.coalesce(F.col("expected_top_k"), F.lit(1)), F.lit(1))
    tested = results.withColumn("_hay", normalize_match_text(haystack)).join(cases, "query_id")
    found = tested.filter(F.col("rank") <= top_k).filter(F.exists("matchers", hits))
    first = found.groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return cases.select("query_id", "category", top_k.alias("expected_top_k")).join(first, "query_id", "left").withColumn(
        "passed", F.col("hit_rank").isNotNull()
    )
