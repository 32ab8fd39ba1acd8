"""Near copies by five-word shingles: pairs from SimHash rings and from bands of shingle minima, checked exactly.

A similarity of 0.8 leaves SimHash fingerprints some ten of 64 bits apart. A ring with so wide a budget has keys of
five bits, which pair nearly everything, so the ring finds the closest copies only (``BITS``), and the others come from
bands: minima of the shingles' hashes under several orders, of which near copies share runs. Pairs from the bands must first
keep a wide budget around the ring, which prunes those that met by chance; then shingle sets are compared.

Both miss some pairs. What they link is one group, and an exact pass finds the rest: with shingles in one order for all texts, rare
ones first, two texts of that similarity share one among the first fifth of each, so texts of different groups that meet there, and whose
sizes and places allow the similarity, are compared too. A large group of copies is one group by then, so it is not paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from catalogkit.llm.components import connected_components
from catalogkit.llm.simhash import BITS, BLOCK, Ring, SEGMENTS, fingerprint_links
from catalogkit.llm.suffix_buckets import _packed, _unpacked
from catalogkit.session import new_work_path

SIZE = 5
SIMILARITY = 0.8
#: Bands of so many minima each: a pair of similarity 0.8 shares one with a chance of 0.98.
BANDS, ROWS = 10, 5
#: Bits by which texts of similarity 0.8 may differ (expected 9.7, deviation 2.9), and segments of their ring.
WIDE_BITS, WIDE_SEGMENTS = 20, 32
#: Frequent shingles are counted in one text of so many, and so many of them are sent to every task (2 MB). They decide the order
#: of the shingles only: any order finds all pairs, a good one compares fewer.
COUNTED, FREQUENT, FREQUENT_FROM = 32, 100_000, 4


def shingle_hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; a shorter text is one shingle.

    A-Z is lower-cased and words are runs without ASCII white space; no words, no shingles.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.append(0, np.cumsum(lengths + 1)[:-1])
    width = min(size, len(words))
    ends, digest = (starts + lengths)[width - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends)), np.uint64, len(ends))


def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def _distinct_shingles(size: int) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(text.as_py(), size)).view(np.int64) for text in texts], pa.list_(pa.int64()))

    return run


def frequent_shingles(texts: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and their counts, from one text of ``COUNTED``; bounded by ``FREQUENT``."""
    some = texts.filter(F.pmod(F.xxhash64(text), F.lit(COUNTED)) == 0)
    counted = some.select(F.explode(F.arrow_udf(_distinct_shingles(size), "array<long>")(text)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    most = counted.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes, counts = most["h"].to_numpy().view(np.uint64), most["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefix(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """As many of a text's distinct shingles, the first in order, as a similar text must share one of."""
    if not len(own):
        return own
    known, counts = frequent
    rank = np.zeros(len(own), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        rank = np.where(known[at] == own, counts[at], 0)
    reach = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    return own[np.lexsort((own, rank))[:reach]]


def _parities(own: np.ndarray) -> bytes:
    """Of each of 2^k bits, at least two a distinct shingle, whether an odd number of shingles fall on it."""
    bits = 1 << max(8, (2 * len(own) - 1).bit_length())
    mixed = own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.packbits(np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _may_be_similar(similarity: float) -> Callable:
    """Whether two texts differ in few enough shingles, by their parities: each differing shingle turns one bit, so texts with more bits
    apart than shingles may differ are not similar. Of unequal lengths the longer is folded, which the low bits of the place allow."""

    def run(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for x, y, both in zip(a, b, n.to_numpy() + m.to_numpy()):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            apart = int(np.bitwise_count(x ^ y).sum())
            out.append(apart * (1 + similarity) <= (1 - similarity) * int(both) + 1e-9)
        return pa.array(out, pa.bool_())

    return run


def _described(size: int, bands: int, rows: int, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> Callable:
    factors, shifts = _orders(bands * rows)
    step = 1 << 12

    def run(texts: pa.Array) -> pa.Array:
        prints, values = np.zeros(len(texts), np.int64), np.zeros((len(texts), bands), np.uint64)
        sizes, prefixes, parities = [], [], []
        for n, text in enumerate(texts):
            hashes = shingle_hashes(text.as_py(), size)
            own = np.unique(hashes)
            sizes.append(len(own))
            prefixes.append(_prefix(own, frequent, similarity).view(np.int64))
            parities.append(_parities(own))
            if not len(hashes):
                continue
            ones, least = np.zeros(64, np.int64), np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(hashes), step):
                part = hashes[at : at + step]
                ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                moved = part[:, None] * factors + shifts
                least = np.minimum(least, (moved ^ (moved >> np.uint64(29))).min(axis=0))
            prints[n] = np.packbits(ones * 2 > len(hashes)).view(">i8")[0]
            mixed = least.reshape(bands, rows) * np.uint64(0x9E3779B97F4A7C15)
            value = np.arange(bands, dtype=np.uint64)
            for k in range(rows):
                value = (value ^ mixed[:, k]) * np.uint64(0xD6E8FEB86659FD93)
                value ^= value >> np.uint64(32)
            values[n] = value
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
        first = [pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
        return pa.StructArray.from_arrays([pa.array(prints), lists, *first], ["fp", "bands", "size", "prefix", "parities"])

    return run


def _in_ring(bits: int, segments: int) -> Callable:
    """Whether a pair keeps every budget along the ring from some segment on; the last budget is the full distance."""
    ring = Ring(bits, segments)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        difference = a.to_numpy().view(np.uint64) ^ b.to_numpy().view(np.uint64)
        out = np.zeros(len(difference), bool)
        for start in range(segments):
            left = np.flatnonzero(~out)
            out[left[ring.linked(start, difference[left])]] = True
        return pa.array(out)

    return run


def _similar(size: int, least: float) -> Callable:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, kept = [], None, None
        for x, y in zip(a, b):
            x, y = x.as_py(), _unpacked(y.as_py()).decode()
            if x != last:
                last, kept = x, np.unique(shingle_hashes(_unpacked(x).decode(), size))
            other = np.unique(shingle_hashes(y, size))
            shared = len(np.intersect1d(kept, other, assume_unique=True))
            either = len(kept) + len(other) - shared
            out.append(either > 0 and shared >= least * either)
        return pa.array(out)

    return run


def copy_links(
    known: DataFrame, texts_of, size: int = SIZE, similarity: float = SIMILARITY, bits: int = BITS, segments: int = SEGMENTS, block: int = BLOCK,
) -> DataFrame:
    """Links ``a, b`` between distinct texts of that Jaccard similarity of shingle sets or more.

    ``known``: ``t, fp, bands`` of each text, ``t`` naming it; ``texts_of`` gives ``t, packed`` for a table of ``t``.
    A band's texts are paired with its least and its greatest only, so a large group of copies gives two pairs a
    text, not all; a text is in ten bands. Pairs close by SimHash come from ``fingerprint_links``. Every pair is checked.
    """
    spark = known.sparkSession
    keyed = known.select("t", "fp", F.posexplode("bands").alias("band", "value"))
    one = F.struct("t", "fp")
    met = keyed.groupBy("band", "value").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("n")).filter("n > 1")
    joined = keyed.join(met.select("band", "value", "low", "high"), ["band", "value"])
    pairs = joined.select(
        F.col("t").alias("b"), F.col("fp").alias("fb"), F.explode(F.array("low", "high")).alias("o")
    ).select("b", "fb", F.col("o.t").alias("a"), F.col("o.fp").alias("fa")).filter("a <> b")
    near = pairs.filter(F.arrow_udf(_in_ring(WIDE_BITS, WIDE_SEGMENTS), "boolean")("fa", "fb"))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # texts of equal fingerprint meet the least of them; linked fingerprints meet by their least
    firsts = known.groupBy("fp").agg(F.min("t").alias("least"))
    equal = known.select("t", "fp").join(firsts, "fp").filter("t <> least").select(F.col("least").alias("a"), F.col("t").alias("b"))
    ring = fingerprint_links(firsts.select("fp"), bits, segments, block).distinct()
    ring = ring.join(firsts.select(F.col("fp").alias("a"), F.col("least").alias("ta")), "a")
    ring = ring.join(firsts.select(F.col("fp").alias("b"), F.col("least").alias("tb")), "b")
    ring = ring.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    path = new_work_path(spark, "pairs")
    near.unionByName(equal).unionByName(ring).distinct().write.parquet(path)
    return checked_links(spark.read.parquet(path), texts_of, size, similarity)


def checked_links(asked: DataFrame, texts_of, size: int, similarity: float) -> DataFrame:
    """Those of the stored pairs ``a, b`` that are similar; only texts of some pair are fetched, once."""
    spark = asked.sparkSession
    path = new_work_path(spark, "paired-texts")
    texts_of(asked.select(F.explode(F.array("a", "b")).alias("t")).distinct()).write.parquet(path)
    texts = spark.read.parquet(path)
    with_a = asked.join(texts.select(F.col("t").alias("a"), F.col("packed").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("t").alias("b"), F.col("packed").alias("text_b")), "b")
    return both.filter(F.arrow_udf(_similar(size, similarity), "boolean")("text_a", "text_b")).select("a", "b")


def meeting_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of texts of different groups that may be similar; none that is similar is missing.

    ``first``: ``t, group, size, prefix`` of each text, its shingles' number and the first of them in the common order.
    """
    spark = first.sparkSession
    # a group of one text is not written twice
    alone = F.when(F.col("group") != F.col("t"), F.col("group")).alias("group")
    met = first.select("t", alone, "size", F.posexplode("prefix").alias("place", "shingle"))
    # most shingles stand in one group alone: those go before anything is paired
    one, whole = Window.partitionBy("shingle"), F.coalesce("group", "t")
    mixed = met.repartition("shingle").withColumn("low", F.min(whole).over(one)).withColumn("high", F.max(whole).over(one)).filter("low < high")
    path = new_work_path(spark, "meeting")
    mixed.select("shingle", "t", whole.alias("group"), "size", "place").write.parquet(path)
    ends = ("t", "group", "size", "place")
    left, right = (spark.read.parquet(path).select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ends]) for side in "ab")
    n, m = F.col("size_a"), F.col("size_b")
    # the same bounds for both texts: shingles before the place where they met, it, and those after
    shared = F.least("place_a", "place_b") + 1 + F.least(n - F.col("place_a") - 1, m - F.col("place_b") - 1)
    enough = similarity * (n + m) - 1e-9
    fits = (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (shared * (1 + similarity) >= enough)
    pairs = left.join(right, "shingle").filter(F.col("group_a") < F.col("group_b")).filter(fits)
    # where they met last, all shingles before it that they share were met too
    counted = pairs.groupBy("t_a", "t_b", "size_a", "size_b").agg(
        F.count("*").alias("n_met"), F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"))
    shared = F.col("n_met") + F.least(n - F.col("place_a") - 1, m - F.col("place_b") - 1)
    likely = counted.filter(shared * (1 + similarity) >= enough)
    return likely.select(F.least("t_a", "t_b").alias("a"), F.greatest("t_a", "t_b").alias("b"))


def first_of_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest key, all columns kept.

    Texts are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more, and
    groups are what links reach; no such link is missed. Equal texts are one text, so copies cost no pairs. Texts without a word (null, empty or
    blank) are one group. Null keys come last; among equal keys the text's hash decides, and of equal rows one stays.
    Columns may have any names. An empty table gives no rows. Whole texts are compared, in memory of about ten times a text.

    Whole rows cross the network once, to be kept or not; texts once more, packed, to fetch those of some pair; and the first
    fifth of each text's shingles.
    """
    spark = docs.sparkSession
    blank = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    named = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), text), F.lit("-")))
    t = F.when(blank, F.unhex(F.lit("00"))).otherwise(F.unhex(F.md5(text)))
    row = F.unhex(F.md5(named))
    frequent = frequent_shingles(docs, text, size)
    describe = _described(size, BANDS, ROWS, frequent, similarity)
    described = F.arrow_udf(describe, "fp long, bands array<long>, size int, prefix array<long>, parities binary")(text)
    path = new_work_path(spark, "shingles")
    docs.select(F.col(key).alias("key"), row.alias("row"), t.alias("t"), (~blank).alias("words"), described.alias("d")).select(
        "key", "row", "t", "words", "d.fp", "d.bands", "d.size", "d.prefix", "d.parities"
    ).write.parquet(path)
    # one row stands for each text: the one that may stay
    best = F.min(F.struct(F.col("key").isNull().alias("no"), "key", "row")).alias("best")
    path_of_texts = new_work_path(spark, "texts")
    spark.read.parquet(path).groupBy("t").agg(best, F.first("words").alias("words"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).write.parquet(path_of_texts)
    firsts = spark.read.parquet(path_of_texts)

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = firsts.join(wanted, "t").select("t", F.col("best.row").alias("row"))
        packed = docs.filter(~blank).select(row.alias("row"), F.arrow_udf(_packed, "binary")(text).alias("packed"))
        # equal rows have one name
        return packed.join(rows, "row").dropDuplicates(["row"]).select("t", "packed")

    links = copy_links(firsts.filter("words").select("t", "fp", "bands"), texts_of, size, similarity)
    found = connected_components(links).withColumnRenamed("node", "t")
    path_of_groups = new_work_path(spark, "groups")
    grouped = firsts.join(found, "t", "left").select("t", "best", "words", F.coalesce("component", "t").alias("group"))
    grouped.write.parquet(path_of_groups)
    groups = spark.read.parquet(path_of_groups)
    prefixes = spark.read.parquet(path).select("row", "size", "prefix")
    # equal rows have one name; a text met twice is in one group
    standing = groups.filter("words").select("t", "group", F.col("best.row").alias("row")).join(prefixes, "row")
    path_of_pairs = new_work_path(spark, "meeting-pairs")
    kept = groups.filter("words").select("t", F.col("best.row").alias("row")).join(spark.read.parquet(path).select("row", "size", "parities"), "row")
    # equal rows have one name
    kept = kept.dropDuplicates(["t"])
    met = meeting_pairs(standing, similarity)
    for side in "ab":
        met = met.join(kept.select(F.col("t").alias(side), F.col("size").alias(f"n_{side}"), F.col("parities").alias(f"p_{side}")), side)
    met = met.filter(F.arrow_udf(_may_be_similar(similarity), "boolean")("p_a", "p_b", "n_a", "n_b"))
    met.select("a", "b").write.parquet(path_of_pairs)

    def texts_met(wanted: DataFrame) -> DataFrame:
        # few texts meet: small enough, their names are sent to the rows
        path_of_met = new_work_path(spark, "met")
        firsts.join(wanted, "t").select("t", F.col("best.row").alias("row")).write.parquet(path_of_met)
        rows = docs.filter(~blank).select(row.alias("row"), F.col(text).alias("text")).join(spark.read.parquet(path_of_met), "row")
        return rows.dropDuplicates(["row"]).select("t", F.arrow_udf(_packed, "binary")("text").alias("packed"))

    more = checked_links(spark.read.parquet(path_of_pairs), texts_met, size, similarity)
    named_a, named_b = (groups.select(F.col("t").alias(side), F.col("group").alias(f"group_{side}")) for side in "ab")
    between = more.join(named_a, "a").join(named_b, "b").select(F.least("group_a", "group_b").alias("a"), F.greatest("group_a", "group_b").alias("b"))
    joined = connected_components(between.distinct()).withColumnRenamed("node", "group")
    rooted = groups.join(joined, "group", "left").select("best", F.coalesce("component", "group").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    rows = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # equal rows have one name; both steps are by it, so rows are dealt out once
    return rows.join(stay, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
