"""Postings are counted within a row, and the whole corpus is ranked once."""

import collections

from pyspark.sql import functions as F
from test_postings import corpus_of, queries_of

from catalogkit.functions import vectors
from catalogkit.operators import postings as p
from catalogkit.operators.topk import scored_topk
from catalogkit.plans import search


def test_counts_of_odd_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_SLICE_TOKENS", 3)
    lists = [["a", "b", "a"], [], None, ["é", "é", "é", "a"], ["x"], [None, "b", None]]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>").coalesce(1)
    stored = p.build_postings(rows, buckets=4)
    want = {(n, t, c) for n, tokens in enumerate(lists) for t, c in collections.Counter(tokens or []).items() if t is not None}
    assert {(r["doc_id"], r["token"], r["count"]) for r in stored.rows.collect()} == want
    assert {(r["token"], r["n"]) for r in stored.blocks.groupBy("token").agg(F.sum("n").alias("n")).collect()} == set(
        collections.Counter(t for _, t, _ in want).items()
    )


def test_the_corpus_is_ranked_once(spark, monkeypatch):
    calls = []

    def spy(queries, *args, **options):
        calls.append({r["query_id"] for r in queries.select("query_id").collect()})
        return scored_topk(queries, *args, **options)

    monkeypatch.setattr(search, "scored_topk", spy)
    monkeypatch.setattr(p, "scored_topk", spy, raising=False)
    corpus, queries = corpus_of(spark), queries_of(spark)
    search.hybrid_search(queries, corpus, 10, postings=p.build_postings(corpus, buckets=8)).collect()
    asked = {r["query_id"] for r in queries.collect()}
    # long queries and those that few rows answer; the others never meet the whole corpus
    assert len(calls) == 1 and {r["query_id"] for r in queries.filter("not is_short").collect()} <= calls[0] < asked
