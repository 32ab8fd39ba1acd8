"""A catalogue in folders by code bucket: batches rewrite and read only the buckets they touch.

A bucket is a hash of the code. Beside the rows lies a Bloom filter per bucket, made once per version of the bucket. Codes that
the filters rule out are never looked up; the others are looked up in their own buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogkit.plans.catalog import upsert_catalog
from catalogkit.session import new_work_path

BUCKET = "code_bucket"
#: Buckets of a catalogue, and 64-bit words of a bucket's filter: 1,024 words hold 6,500 codes at one false hit in a hundred.
BUCKETS, WORDS = 64, 1024
#: Places that a code sets.
HASHES = 5
#: Touched buckets are named to the reader one by one.
MAX_BUCKETS = 65_536


@dataclass
class BucketedCatalog:
    """Where a bucketed catalogue lies, and how it is cut."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    words: int = WORDS
    key: str = "ean"

    def bucket_of(self, code: Column | str) -> Column:
        return F.pmod(F.xxhash64(code), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of the named buckets: other folders are not listed for reading."""
        return self._read("rows", buckets).drop(BUCKET)

    def filters(self, buckets: list[int] | None = None) -> DataFrame:
        """``code_bucket, word, bits`` of the buckets' Bloom filters."""
        return self._read("filters", buckets)

    def _read(self, part: str, buckets: list[int] | None) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/{part}")
        return found if buckets is None else found.filter(F.col(BUCKET).isin(buckets))

    def touched(self, codes: DataFrame, code: str) -> list[int]:
        """Buckets of the codes, ``buckets`` numbers at most."""
        return sorted(r[0] for r in codes.select(self.bucket_of(code)).distinct().collect())


def _places(catalog: BucketedCatalog, code: str) -> Column:
    """Places of a code in its bucket's filter, by double hashing."""
    size = F.lit(catalog.words * 64).cast("long")
    first, step = (F.pmod(F.xxhash64(F.lit(name), code), size) for name in ("first", "step"))
    return F.array(*[F.pmod(first + step * n, size) for n in range(HASHES)])


def _filter_rows(catalog: BucketedCatalog, rows: DataFrame) -> DataFrame:
    place = rows.select(BUCKET, F.explode(_places(catalog, catalog.key)).alias("place"))
    word = F.floor(F.col("place") / 64).cast("int")
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    return place.groupBy(BUCKET, word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def _write(df: DataFrame, path: str) -> None:
    """Replace the folders of the buckets in ``df`` and no others. A bucket's rows are sorted into few files."""
    dealt = df.repartition(BUCKET).sortWithinPartitions(BUCKET)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def write_bucketed(
    rows: DataFrame, path: str, buckets: int = BUCKETS, words: int = WORDS, key: str = "ean"
) -> BucketedCatalog:
    """Lay a catalogue out in ``buckets`` folders under ``path``, with their filters.

    Codes are unique, so buckets are of about equal size: take enough of them that ten bits a code fit ``words``. A filter that is too
    small makes more lookups, never a wrong answer.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"1 to {MAX_BUCKETS} buckets")
    catalog = BucketedCatalog(rows.sparkSession, path, buckets, words, key)
    _write(rows.withColumn(BUCKET, catalog.bucket_of(key)), f"{path}/rows")
    _write(_filter_rows(catalog, catalog._read("rows", None)), f"{path}/filters")
    return catalog


def upsert_bucketed(catalog: BucketedCatalog, new: DataFrame, now: Column, position: str | None = None) -> list[int]:
    """``upsert_catalog`` over the buckets that ``new`` touches; returns these. Files of all other buckets stay as they are.

    The merged rows are stored elsewhere first, then Spark's dynamic partition overwrite puts them in place. One writer at a
    time; a job that died between the two can be run again with the same batch, since an upsert of the same rows gives the same rows.
    """
    path = new_work_path(catalog.spark, "upsert")
    new.write.parquet(f"{path}/batch")
    batch = catalog.spark.read.parquet(f"{path}/batch")
    touched = catalog.touched(batch, catalog.key)
    if not touched:
        return []
    merged = upsert_catalog(catalog.rows(touched), batch, now, catalog.key, position)
    merged.withColumn(BUCKET, catalog.bucket_of(catalog.key)).write.parquet(f"{path}/merged")
    stored = catalog.spark.read.parquet(f"{path}/merged")
    _write(stored, f"{catalog.path}/rows")
    _write(_filter_rows(catalog, stored), f"{catalog.path}/filters")
    return touched


def possible_codes(catalog: BucketedCatalog, codes: DataFrame, code: str) -> DataFrame:
    """Distinct codes that the filters do not rule out. Filters of untouched buckets are not read."""
    asked = codes.select(F.col(code).alias(code)).filter(F.col(code).isNotNull()).distinct()
    spread = asked.select(code, catalog.bucket_of(code).alias(BUCKET), F.explode(_places(catalog, code)).alias("place"))
    spread = spread.withColumn("word", F.floor(F.col("place") / 64).cast("int"))
    words = catalog.filters(catalog.touched(asked, code))
    hit = F.expr("(bits & shiftleft(1L, cast(place % 64 as int))) != 0")
    met = spread.join(words, [BUCKET, "word"]).filter(hit)
    return met.groupBy(code).agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).select(code)


def known_codes(catalog: BucketedCatalog, codes: DataFrame, code: str) -> DataFrame:
    """Those of ``codes`` (distinct) that the catalogue has: filters first, then only buckets with a possible hit."""
    path = new_work_path(catalog.spark, "possible")
    possible_codes(catalog, codes, code).write.parquet(path)
    possible = catalog.spark.read.parquet(path)
    rows = catalog.rows(catalog.touched(possible, code)).select(F.col(catalog.key).alias(code))
    return possible.join(rows, code, "left_semi")
