"""Catalogue in buckets: what a batch leaves alone, what a lookup reads."""

import os
import shutil

from pyspark.sql import functions as F

from catalogkit.plans.bucketed import BUCKET, known_codes, possible_codes, upsert_bucketed, write_bucketed
from catalogkit.plans.catalog import upsert_catalog

def stamp():
    return F.expr("timestamp '2024-01-01 00:00:00'")


def catalog_of(spark, path, rows=4000, **sizes):
    df = spark.range(rows).select(
        F.lpad((F.col("id") * 2).cast("string"), 13, "0").alias("ean"), F.concat(F.lit("p"), "id").alias("description"),
        stamp().alias("created_at"), stamp().alias("updated_at"),
    )
    return df, write_bucketed(df, path, **sizes)


def files(path):
    return {folder: sorted(n for n in os.listdir(f"{path}/rows/{folder}") if n.endswith(".parquet")) for folder in os.listdir(f"{path}/rows") if "=" in folder}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "c")
    df, catalog = catalog_of(spark, path, buckets=16)
    before = files(path)
    new = spark.createDataFrame([("0000000000004", "changed"), ("0000000000005", "added"), ("0000000000004", "last")], "ean string, description string")
    new = new.withColumn("at", F.monotonically_increasing_id()).coalesce(1)
    want = sorted(upsert_catalog(df, new.coalesce(1), F.expr("timestamp '2024-06-01 00:00:00'"), position="at").collect())
    touched = upsert_bucketed(catalog, new, F.expr("timestamp '2024-06-01 00:00:00'"), "at")
    after = files(path)
    assert 1 <= len(touched) <= 2 and set(after) == set(before)
    assert {k for k in before if before[k] != after[k]} == {f"{BUCKET}={n}" for n in touched}
    assert sorted(catalog.rows().select("ean", "description", "created_at", "updated_at").collect()) == want
    assert [r[0] for r in known_codes(catalog, new, "ean").orderBy("ean").collect()] == ["0000000000004", "0000000000005"]


def test_lookups_read_only_possible_buckets(spark, tmp_path):
    path = str(tmp_path / "c")
    _, catalog = catalog_of(spark, path, buckets=16)
    absent = spark.range(2000).select(F.lpad((F.col("id") * 2 + 1).cast("string"), 13, "0").alias("code"))
    through = possible_codes(catalog, absent, "code").count()
    assert through < 40  # about one in a hundred
    asked = absent.limit(3).unionByName(spark.createDataFrame([("0000000000008",), (None,)], "code string"))
    held = catalog.touched(possible_codes(catalog, asked, "code"), "code")
    # the lookup does without every other bucket's rows
    for folder in files(path):
        if int(folder.split("=")[1]) not in held:
            shutil.rmtree(f"{path}/rows/{folder}")
    assert [r[0] for r in known_codes(catalog, asked, "code").collect()] == ["0000000000008"]


def test_small_filters_are_slow_not_wrong(spark, tmp_path):
    _, catalog = catalog_of(spark, str(tmp_path / "c"), buckets=2, words=1)
    codes = spark.range(50).select(F.lpad(F.col("id").cast("string"), 13, "0").alias("code"))
    assert known_codes(catalog, codes, "code").count() == 25
    assert known_codes(catalog, codes.limit(0), "code").count() == 0
    assert upsert_bucketed(catalog, catalog.rows().limit(0), stamp()) == []


def test_history_is_gathered(spark, tmp_path):
    from catalogkit.streaming import imports

    schema, path = "batch_id long, valid_ean string", str(tmp_path / "seen")
    for epoch in range(2 * imports.COMPACT + 3):
        df = spark.createDataFrame([(1, f"{epoch:013d}")], schema)
        imports._remember(df, path, epoch, schema)
    whole = imports._history(spark, path, 2 * imports.COMPACT + 3, None, schema)
    assert sorted(r.valid_ean for r in whole.collect()) == [f"{n:013d}" for n in range(2 * imports.COMPACT + 3)]
    assert len({f.split("seen/")[1].split("/")[0] for f in whole.inputFiles()}) == 4
    assert imports._history(spark, path, 0, [1], schema).count() == 0
