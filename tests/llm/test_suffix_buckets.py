"""Repeated byte strings against a table of every string of the texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import suffix_buckets as sb
from catalogkit.llm.queries import QUERIES, read


def plain(rows, length):
    """``key, n_bytes, removed spans, kept`` by counting every string."""
    texts = [(key, (text or "").encode()) for key, text in rows]
    seen = collections.Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.append(np.cumsum(gone)[:-1] > 0, False)
        edges = np.flatnonzero(np.diff(np.append(False, gone).astype(int)))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((key, len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return collections.Counter(out)


def got(df):
    return collections.Counter(
        (r["doc_id"], r["n_bytes"], tuple((s["s"], s["e"]) for s in r["spans"]), bytes(r["kept"])) for r in df.collect()
    )


def short(awkward):
    """The awkward rows with long texts cut, since the plain count takes every string."""
    return [(k, t[:3000] if t else t) for k, t, *_ in awkward]


@pytest.mark.parametrize("bucket,length", [(2048, 400), (1, 400), (2048, 40), (1, 40)])
def test_awkward_rows(spark, awkward, clashing, none, bucket, length):
    rows = short(awkward)
    size = dict(length=length, qgram=64 if length == 400 else 12, bucket=bucket, cell=16 if length == 400 else 5)
    table = clashing.withColumn("text", F.substring("text", 1, 3000))
    assert got(sb.remove_repeats(table, **size)) == plain(rows, length)
    empty = sb.remove_repeats(none, **size)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "spans", "kept"]


@pytest.mark.parametrize("bucket", [2, 2048])
def test_shared_passages_with_unlike_surroundings(spark, bucket):
    """One passage in most texts, cut differently, beside copies, near copies and runs of one byte."""
    rng = random.Random(bucket)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, other = word(160), word(300)
    rows = []
    for n in range(160):
        a, b = sorted(rng.sample(range(160), 2))
        kind = n % 4
        text = word(rng.randint(0, 90)) + (passage if kind == 0 else passage[a:b] if kind == 1 else "") + word(rng.randint(0, 90))
        if kind == 2:
            at = rng.randrange(300)
            text = other[:at] + "#" + other[at:]
        if kind == 3:
            text = "z" * rng.randint(30, 200) + word(20)
        rows.append((n, text))
    rows += [(200 + n, other) for n in range(30)] + [(300, word(500) * 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(sb.remove_repeats(table, length=40, qgram=12, bucket=bucket, cell=5)) == plain(rows, 40)


def test_refinement_alone():
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 99, n).astype(np.uint8) for n in rng.integers(0, 90, 60)]
    data, offsets = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    for length in (8, 9, 13, 16, 30):
        texts = [p.tobytes() for p in parts]
        seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
        want = [len(t) - p >= length and seen[t[p : p + length]] > 1 for t in texts for p in range(len(t))]
        assert sb.repeated_starts(data, offsets, length).tolist() == want


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in read(spark, folder, "documents").select("doc_id", "text").collect()]
    want = collections.Counter(
        (k, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in plain(rows, 400)
    )
    found = QUERIES["op11_bucket_refinement"](spark, folder)
    assert collections.Counter(tuple(r[c] for c in "doc_id n_bytes n_removed n_spans kept_sha256".split()) for r in found.collect()) == want
