"""Hot keys, blocks, plans and streams over several files."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from catalogkit.operators.aggregates import group_by_key
from catalogkit.operators.dedupe import first_per_key, mark_duplicates
from catalogkit.operators.fuzzy import match_token_pairs
from catalogkit.operators.ordering import nearest_rank_percentiles, page, with_row_number
from catalogkit.operators.taxonomy import taxonomy_candidates
from catalogkit.operators.topk import vector_topk
from catalogkit.plans.triage import triage
from catalogkit.streaming.cache import stock_cache_stream
from catalogkit.streaming.imports import dedupe_stream, import_stream, read_table_stream, start, write_epoch
from qsuite import views as v


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def hot(spark, rows=30_000):
    """A third of the rows share one key."""
    return spark.range(rows).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000))


def test_first_per_key_is_cut_before_the_shuffle(spark):
    df = first_per_key(hot(spark), ["k"], ["id"])
    text = plan(df)
    assert text.count("WindowGroupLimit") >= 2
    assert df.filter("k = 0").first()["id"] == 0
    assert df.count() == 5000


def test_mark_duplicates_on_a_hot_key(spark):
    rows = hot(spark).withColumn("ok", F.lit(True)).withColumn("b", F.lit(1))
    flagged = mark_duplicates(rows, ["b"], "k", "ok", ["id"], "id")
    assert flagged.filter("not is_duplicate").count() == 5000
    assert flagged.count() == 30_000


def test_row_numbers_on_a_hot_key(spark):
    numbered = with_row_number(hot(spark), ["k", "id"], partitions=8)
    want = hot(spark).toPandas().sort_values(["k", "id"])["id"].tolist()
    assert [r.id for r in numbered.orderBy("row_no").collect()] == want
    assert numbered.agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first()[:] == (1, 30_000, 30_000)


def test_percentiles_match_brute_force(spark):
    rows = hot(spark).withColumn("g", (F.col("id") % 3 == 0).cast("string")).withColumn("x", (F.col("id") * 7919 % 1013) / 8)
    got = {r.g: r for r in nearest_rank_percentiles(rows, ["g"], "x", {"p50": 0.5, "p99": 0.99, "p100": 1.0}, 8).collect()}
    for g, part in rows.toPandas().groupby("g"):
        ordered = np.sort(part["x"].to_numpy())
        for name, fraction in (("p50", 0.5), ("p99", 0.99), ("p100", 1.0)):
            assert got[g][name] == ordered[int(np.ceil(len(ordered) * fraction)) - 1]


def test_group_lists_stay_bounded(spark):
    lists = group_by_key(hot(spark), "k", "id", ["id"], size=100)
    sizes = lists.select("k", F.size("items").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == 30_000
    assert sizes.agg(F.max("n")).first()[0] < 200
    assert sizes.filter("k = 1").count() == 1


def test_page_bounds(spark):
    rows = spark.range(12)
    last = page(rows, ["id"], 5, 10).collect()
    assert [(r.id, r.position, r.returned, r.has_more, r.next_offset) for r in last] == [(10, 1, 2, False, None), (11, 2, 2, False, None)]
    assert page(rows, ["id"], 500).count() == 12 and page(rows, ["id"]).count() == 10
    assert page(spark.range(300), ["id"], 200).count() == 200 and page(spark.range(300), ["id"], 200, max_limit=50).count() == 50


def test_topk_blocks_match_brute_force(spark):
    rng = np.random.default_rng(7)
    docs, queries = rng.normal(size=(500, 16)), rng.normal(size=(40, 16))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(docs)], "doc_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, query_vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(queries) @ unit(docs).T), axis=1)[:, :7]
    for query_rows, corpus_rows in ((1024, 1024), (7, 60)):
        got = vector_topk(q, d, 7, query_rows=query_rows, corpus_rows=corpus_rows)
        rows = got.orderBy("query_id", "rank").collect()
        assert [r.doc_id for r in rows] == best.ravel().tolist()
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_taxonomy_blocks_agree(spark, sf_dir):
    rows = v.catalog(spark, sf_dir)
    entries = v.taxonomy(spark, sf_dir)
    numbers = lambda df: {r.p_partkey: [(c.entry_no, c.score) for c in r.candidates] for r in df.select("p_partkey", "candidates").collect()}
    whole = numbers(taxonomy_candidates(rows, entries, "description", 6))
    assert numbers(taxonomy_candidates(rows, entries, "description", 6, item_rows=40, entry_rows=30)) == whole
    assert all(len(c) == 6 for c in whole.values())


def test_token_pairs_match_brute_force(spark):
    from qsuite.check import connect  # the SQL engine's edit distance

    words = ["paracetamol", "paracetamo", "paracetmol", "xparacetamol", "dipirona", "dirpirona", "dipiron", "cafe", "cafes", "12345678", "ibuprofeno", "ibuprofen"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.query_token, r.token, r.distance) for r in match_token_pairs(df, df, "w", "w").collect()}
    con = connect("/root/testdata/sf0.001")
    want = set()
    for a in words:
        for b in words:
            bound = 2 if len(a) >= 10 else 1 if len(a) >= 5 else 0
            distance = con.execute("select levenshtein(?, ?)", [a, b]).fetchall()[0][0]
            if bound and distance <= bound and not a.isdigit() and not b.isdigit():
                want.add((a, b, distance))
    assert got == want


def test_no_cross_joins_in_any_query(spark, sf_dir):
    from __spark_entry__ import queries

    for name in ("import_triage", "taxonomy_candidates", "match_token_pairs", "merge_stock", "expand_window", "compare_sources"):
        text = plan(queries()[name](spark, sf_dir))
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_scan_reads_only_needed_columns(spark, sf_dir):
    from __spark_entry__ import queries

    text = plan(queries()["feed_predicate"](spark, sf_dir))
    assert "l_shipdate" not in text.split("ReadSchema")[1]
    assert "GreaterThan(l_quantity,10.0)" in text and "EqualTo(l_suppkey" not in text.split("ReadSchema")[1][:200]


def split_events(spark, sf_dir, folder, files=4):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = e.count() // files + 1
    for i in range(files):
        part = e.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        part.coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_matches_batch_over_many_micro_batches(spark, sf_dir, tmp_path):
    split_events(spark, sf_dir, tmp_path / "in")
    known = v.catalog(spark, sf_dir).filter("p_partkey % 3 = 0")
    stream = v.items_of(read_table_stream(spark, str(tmp_path / "in"), "*.parquet", 1))
    passed = []
    run = import_stream(stream, known, str(tmp_path / "out"), str(tmp_path / "check"), process=lambda df, epoch: passed.append(df.count()))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert got.select("epoch").distinct().count() == 4
    batch = triage(v.items(spark, sf_dir), known)
    count = lambda df: {(r.batch_id, r.triage): r["count"] for r in df.groupBy("batch_id", "triage").count().collect()}
    assert count(got) == count(batch)
    assert sum(passed) == batch.filter("triage in ('invalid', 'eligible')").count()


def test_stream_dedupe_over_many_micro_batches(spark, sf_dir, tmp_path):
    split_events(spark, sf_dir, tmp_path / "in")
    stream = v.items_of(read_table_stream(spark, str(tmp_path / "in"), "*.parquet", 1))
    out = str(tmp_path / "out")
    start(dedupe_stream(stream, unbounded=True), lambda df, n: write_epoch(df, out, n), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(out).select("batch_id", "valid_ean")
    batch = triage(v.items(spark, sf_dir), v.catalog(spark, sf_dir)).filter("triage in ('eligible', 'existing')")
    assert rows.count() == rows.distinct().count() == batch.count()


def test_stock_cache_stream(spark, tmp_path):
    """State over several micro-batches: newest per key, late rows count, expired keys leave the state."""
    import time

    from catalogkit.streaming.cache import cached_rows, cached_state, state_rows

    batches = [
        [("a", 100, 1), ("b", 100, 1), ("c", 110, 1)], [("a", 250, 2), ("c", 105, 9)], [("d", 450, 1), ("a", 240, 7)],
        [("d", 450, 3), ("e", 200, 1), ("f", 100, 1)],
    ]
    every = []
    for batch in batches:
        rows = [(k, t, n) for k, t, n in batch]
        df = spark.createDataFrame(rows, "k string, t long, stock int").select("k", F.timestamp_seconds("t").alias("ts"), "stock")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        every += batch
        time.sleep(0.02)
    stream = read_table_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    check = str(tmp_path / "check")
    run = stock_cache_stream(stream, check, ["k"], "ts", 300, ["stock"])
    run.awaitTermination()
    table = spark.createDataFrame(every, "k string, t long, stock int").select("k", F.timestamp_seconds("t").alias("ts"), "stock")
    want = cached_rows(table, ["k"], "ts", table.agg(F.max("ts")).scalar(), 300, tie=["stock"])
    kept = lambda df: sorted((r.k, r.stock) for r in df.collect())
    assert kept(cached_state(spark, check, "ts", 300)) == kept(want) == [("a", 2), ("d", 3), ("e", 1)]
    assert kept(cached_state(spark, check, "ts", 300, 1)) == [("d", 3)]
    assert state_rows(spark, check).count() == 3  # b, c and f have left
