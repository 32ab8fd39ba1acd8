"""Vector top-k through an inverted file: rows in lists by their nearest centre, and each query asks few lists.

Centres come from spherical k-means over a bounded sample; every row of the corpus gets a list. A query meets the
lists with the nearest centres, and the rows of those are ranked by their exact similarity. A list is cut into blocks
of a stated number of rows, so a large list is many groups, not one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.operators.dedupe import top_per_key
from catalogkit.operators.topk import CORPUS_ROWS, MERGE_SALTS, QUERY_ROWS, _matrix, _score_vectors
from catalogkit.session import new_work_path

#: Rows per list that k-means looks at, and rows at most.
SAMPLE_PER_LIST, SAMPLE_ROWS = 64, 200_000
#: Numbers of all centres together; they are sent to every task (128 MB).
MAX_CENTRE_NUMBERS = 1 << 24
ROUNDS = 12
#: Similarities of rows and centres that are held at a time.
_CELLS = 1 << 20
#: List of rows without a direction (missing, wrongly sized or zero vectors); every query asks it.
NO_DIRECTION = -1


@dataclass
class InvertedFile:
    """Unit-length centres, and a table of all rows: ``doc_id, vector, list``."""

    centres: np.ndarray
    rows: DataFrame
    #: Largest angle between a centre and a row of its list.
    radius: np.ndarray
    sizes: dict[int, int]


def fit_centres(corpus: DataFrame, lists: int, seed: int = 1, doc_id: str = "doc_id", vector: str = "vector") -> np.ndarray:
    """Unit-length centres by spherical k-means on ``SAMPLE_PER_LIST`` rows a list, ``SAMPLE_ROWS`` at most.

    The sample are the rows whose ids have the lowest hashes, so the same data give the same centres. A centre that loses
    all its rows takes the row furthest from its own. Fewer rows than lists make fewer centres.
    """
    wanted = min(SAMPLE_PER_LIST * lists, SAMPLE_ROWS)
    sample = corpus.filter(F.size(vector) > 0).select(vector, F.xxhash64(doc_id).alias("h")).orderBy("h").limit(wanted).toArrow()
    column = sample[vector].combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    dims = int(np.asarray(column.value_lengths()).max())
    if lists * dims > MAX_CENTRE_NUMBERS:
        raise ValueError(f"{lists} centres of {dims} numbers are too large to send to every task")
    x = _matrix(column, dims)
    x = x[(x != 0).any(axis=1)]
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(ROUNDS):
        parts = [(near.argmax(axis=1), near.max(axis=1)) for near in _near(x, centres)]
        own, top = (np.concatenate(c) for c in zip(*parts))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        lonely = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[lonely] = x[top.argsort()[: len(lonely)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), centres)
    return centres


def _near(x: np.ndarray, centres: np.ndarray) -> Iterator[np.ndarray]:
    """Similarities of rows and centres, some rows at a time: the more centres, the fewer."""
    step = max(1, _CELLS // len(centres))
    for low in range(0, len(x), step):
        yield x[low : low + step] @ centres.T


def _nearest(centres: np.ndarray):
    def run(vectors: pa.Array) -> pa.Array:
        if not len(centres):
            return pa.StructArray.from_arrays(
                [pa.array(np.full(len(vectors), NO_DIRECTION, np.int32)), pa.array(np.zeros(len(vectors)))], ["list", "angle"]
            )
        x = _matrix(vectors, centres.shape[1])
        parts = [(near.argmax(axis=1), near.max(axis=1)) for near in _near(x, centres)]
        own = np.concatenate([np.empty(0, np.int32), *(part[0].astype(np.int32) for part in parts)])
        angle = np.arccos(np.clip(np.concatenate([np.empty(0), *(part[1] for part in parts)]), -1, 1))
        none = ~(x != 0).any(axis=1)
        own[none], angle[none] = NO_DIRECTION, 0
        return pa.StructArray.from_arrays([pa.array(own), pa.array(angle)], ["list", "angle"])

    return run


def build_ivf(corpus: DataFrame, lists: int, seed: int = 1) -> InvertedFile:
    """Index of all rows of ``corpus`` (``doc_id, vector``), stored once in the shared folder, by list.

    Ids are taken as unique. The driver sees the sample and one row per list.
    """
    spark = corpus.sparkSession
    centres = fit_centres(corpus, lists, seed)
    placed = corpus.select("doc_id", "vector", F.arrow_udf(_nearest(centres), "list int, angle double")("vector").alias("p"))
    path = new_work_path(spark, "ivf")
    placed.select("doc_id", "vector", "p.list", "p.angle").write.parquet(path)
    rows = spark.read.parquet(path)
    known = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    radius = np.zeros(len(centres))
    for r in known:
        if r["list"] >= 0:
            radius[r["list"]] = r["radius"]
    return InvertedFile(centres, rows.select("doc_id", "vector", "list"), radius, {r["list"]: r["n"] for r in known})


def _probed(index: InvertedFile, probes: int | None, floor: bool):
    """Lists for each query: the ``probes`` nearest, or with ``floor`` all others that may hold a row as similar as it."""
    centres, radius = index.centres, index.radius
    used = np.array([n in index.sizes for n in range(len(centres))], bool)

    def run(vectors: pa.Array, floors: pa.Array) -> pa.Array:
        out, lists = [], [np.empty(0, np.int32)]
        if not len(centres):
            return pa.array([[NO_DIRECTION]] * len(vectors), pa.list_(pa.int32()))
        values = floors.to_pylist()
        for near in _near(_matrix(vectors, centres.shape[1]), centres):
            near[:, ~used] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, int(used.sum()))].astype(np.int32)
            best = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0)) if floor else None
            for n in range(len(near)):
                value = values[len(out)]
                if floor:
                    may = used if value is None else used & (best[n] >= value - 1e-6)
                    own = np.setdiff1d(np.flatnonzero(may), order[n]).astype(np.int32)
                else:
                    own = np.append(order[n], np.int32(NO_DIRECTION))
                out.append(len(own))
                lists.append(own)
        ends = np.cumsum([0, *out]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))

    return run


def _parts(sizes: dict[int, int], rows: int) -> Column:
    """Number of blocks of the row's list."""
    split = {n: -(-size // rows) for n, size in sizes.items() if size > rows}
    if not split:
        return F.lit(1)
    return F.coalesce(F.get(F.lit([split.get(n, 1) for n in range(NO_DIRECTION, max(sizes) + 1)]), F.col("list") - NO_DIRECTION), F.lit(1))


def _rank_in_lists(asked: DataFrame, index: InvertedFile, k: int, min_score: float | None, digits: int, corpus_rows: int, query_rows: int) -> DataFrame:
    """Best ``k`` rows per query and block. ``asked``: ``query_id, query_vector, list``."""
    # queries of one list are dealt over blocks too: the count per list is at most one row per list
    counted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts, q_parts = _parts(index.sizes, corpus_rows), _parts(counted, query_rows)
    left = asked.withColumn("q_part", F.pmod(F.xxhash64("query_id"), q_parts).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = index.rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    right = right.withColumn("q_part", F.explode(F.sequence(F.lit(0), q_parts - 1))).withColumn("recency", F.lit(0.0))
    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((asked, "query_id"), (index.rows, "doc_id"))]
    schema = f"{kinds[0]}, is_short boolean, {kinds[1]}, recency double, similarity double, overlap bigint, exact bigint"
    by = ("list", "part", "q_part")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_score_vectors(k, min_score, digits, query_rows, corpus_rows), schema)


def vector_topk_ivf(
    queries: DataFrame, index: InvertedFile, k: int, probes: int, exact: bool = False, min_score: float | None = None,
    digits: int = 9, corpus_rows: int = CORPUS_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Cosine top-k of ``queries`` (``query_id, query_vector``) by an inverted file: ``query_id, doc_id, similarity, rank``.

    Similarities are exact, and ties are broken by the lowest id, as in ``vector_topk``; rows in lists that are not asked
    are missed. With ``exact`` nothing is: after the ``probes`` nearest lists, a query asks every other list that could hold a
    row as similar as its ``k``-th so far, by the angle to the list's centre less the list's largest angle. Query ids are taken as unique.
    """
    asked = queries.select("query_id", "query_vector")
    order = [F.desc("similarity"), F.asc("doc_id")]

    def search(of: DataFrame, floor: bool) -> DataFrame:
        value = F.col("floor") if floor else F.lit(None).cast("double")
        lists = F.arrow_udf(_probed(index, probes, floor), "array<int>")("query_vector", value)
        rows = of.select("query_id", "query_vector", F.explode(lists).alias("list"))
        return _rank_in_lists(rows, index, k, min_score, digits, corpus_rows, query_rows).select("query_id", "doc_id", "similarity")

    def best(rows: DataFrame, rank: str = "rank") -> DataFrame:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
        thinned = top_per_key(salted, ["query_id", "_salt"], order, k)
        return top_per_key(thinned, ["query_id"], order, k, rank).drop("_salt")

    found = search(asked, False)
    if exact:
        spark = queries.sparkSession
        path = new_work_path(spark, "probed")
        best(found).write.parquet(path)
        first = spark.read.parquet(path)
        floors = first.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
        more = search(asked.join(floors, "query_id", "left"), True)
        found = first.select("query_id", "doc_id", "similarity").unionByName(more)
    return best(found).select("query_id", "doc_id", "similarity", "rank")


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``queries, wanted, hits, recall``: how many of the true ``k`` best rows were found. Both: ``query_id, doc_id, rank``."""
    true = truth.filter(F.col("rank") <= k).select("query_id", "doc_id")
    got = found.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return true.join(got, ["query_id", "doc_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"),
        F.round(F.count("hit") / F.count("*"), 4).alias("recall"),
    )
