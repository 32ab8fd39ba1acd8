"""The feed reaches its shuffle as one row per code and task."""

import pytest
from pyspark.sql import functions as F

from catalogkit.plans.stock import expand_window, merge_diagnostics, merge_stock

CODES, COPIES, TASKS = 40, 300, 4


def shuffled(df) -> int:
    """Rows that all shuffles of a finished plan wrote."""
    df.collect()
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        left += [children.apply(n) for n in range(children.size())]
    return total


@pytest.fixture()
def tables(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = F.col("id")
    feed = spark.range(0, CODES * COPIES, 1, TASKS).select(
        n.cast("string").alias("id"), n.cast("string").alias("code"), (n % CODES + 1000).cast("string").alias("ean"), F.lit("d").alias("description"),
        (n % 7).cast("double").alias("stock"), n.cast("double").alias("price"), F.lit(None).cast("double").alias("promo_price"),
        F.lit(None).cast("double").alias("discount_pct"), (-n).alias("place"),
    )
    # half of the results have a code that the feed has, some none
    results = spark.range(0, CODES, 1, 1).select(
        (n % 3).alias("query_id"), n.alias("doc_id"), F.when(n % 5 != 0, (2 * n + 1000).cast("string")).alias("ean"), F.lit("r").alias("description"),
        F.lit(0.5).alias("similarity"), F.lit(1).alias("overlap"), F.lit(0).alias("exact"), (n + 1).alias("rank"),
    )
    yield results, feed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_feed_is_cut_before_its_shuffle(tables):
    results, feed = tables
    assert shuffled(merge_stock(results, feed, ["place"], 2)) < CODES * TASKS + 4 * CODES < CODES * COPIES


def test_rows_are_those_of_plain_code(tables):
    results, feed = tables
    first = {}
    for r in feed.collect():
        if r["ean"] not in first or r["place"] < first[r["ean"]]["place"]:
            first[r["ean"]] = r
    met = [(r["query_id"], r["doc_id"], first[r["ean"]]) for r in results.collect() if r["ean"] in first]
    got = {(r["query_id"], r["doc_id"], r["feed_id"]) for r in merge_stock(results, feed, ["place"], 2).collect()}
    assert got == {(q, d, f["id"]) for q, d, f in met if f["stock"] >= 2} and got
    sums = {r["query_id"]: (r["matched"], r["low_stock"], r["merged"]) for r in merge_diagnostics(results, feed, ["place"], 2).collect()}
    for q in range(3):
        own = [f["stock"] < 2 for k, _, f in met if k == q]
        assert sums[q] == (len(own), sum(own), len(own) - sum(own))
    assert expand_window(results, feed, ["place"], 1, 50, 2).count() == 3
