"""Short queries by postings against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from catalogkit.functions.vectors import hash_vector
from catalogkit.operators.postings import build_postings, needed_blocks, short_candidates
from catalogkit.plans.search import hybrid_search, prepare_queries

WORDS = ["w" + chr(97 + n // 10) + chr(97 + n % 10) for n in range(40)]


def corpus_of(spark, rows=600, seed=1):
    """A third of all rows hold the first word, from once to many times; later words are ever rarer."""
    rng = random.Random(seed)
    data = []
    for n in range(rows):
        tokens = [rng.choice(WORDS[: 1 + rng.randrange(40)]) for _ in range(rng.randint(1, 12))]
        tokens += [WORDS[0]] * (min(60, int(rng.paretovariate(0.8))) if n % 3 == 0 else 0)
        data.append((n, tokens, f"78910000000{n % 50:02d}" if n % 7 == 0 else None, rng.choice([None, 1, 2])))
    df = spark.createDataFrame(data, "doc_id long, tokens array<string>, ean string, recency int").repartition(5)
    return df.withColumn("vector", hash_vector("tokens", 32))


def queries_of(spark):
    texts = [*WORDS[:12], "waa waf", "wab waa", "wdj wdi", "nothing here", "waa waa", "7891000000007", "7891000000014 waa", "wac wad wae"]
    return prepare_queries(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"), dims=32)


COLUMNS = ["query_id", "rank", "doc_id", "similarity", "overlap", "exact", "is_short", "has_more"]


@pytest.mark.parametrize("limit,offset,min_score", [(5, 0, None), (20, 3, None), (10, 0, 0.3), (200, 0, None)])
def test_pages_equal_all_pairs(spark, limit, offset, min_score):
    corpus, queries = corpus_of(spark), queries_of(spark)
    want = hybrid_search(queries, corpus, limit, offset, min_score)
    got = hybrid_search(queries, corpus, limit, offset, min_score, postings=build_postings(corpus, buckets=8))
    key = lambda df: sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())
    assert key(got) == key(want)


def test_fewer_rows_are_scored_and_fewer_blocks_read(spark):
    corpus, queries = corpus_of(spark, 3000), queries_of(spark).filter("is_short and query_ean is null and query_id < 14")
    postings = build_postings(corpus, buckets=8)
    asked = queries.select("query_id", F.explode(F.array_distinct("query_tokens")).alias("token"))
    scored = short_candidates(queries, corpus, postings, 6).count()
    assert scored < 0.1 * queries.count() * corpus.count()
    blocks = asked.join(postings.blocks, "token").count()
    assert needed_blocks(asked, postings, 6).count() < blocks
    # the token that a third of all rows hold: only its topmost blocks
    hot = needed_blocks(asked.filter("query_id = 0"), postings, 6).join(postings.blocks, ["token", "block"]).agg(F.sum("n")).first()[0]
    assert hot < 200


def test_empty_corpus_and_queries(spark):
    corpus, queries = corpus_of(spark), queries_of(spark)
    none = corpus.limit(0)
    assert hybrid_search(queries, none, 5, postings=build_postings(none)).count() == 0
    assert hybrid_search(queries.limit(0), corpus, 5, postings=build_postings(corpus)).count() == 0
