"""Near-duplicates, components, shards and the pipeline."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from catalogkit.llm import shard_table, simhash
from catalogkit.llm.components import connected_components
from catalogkit.llm.queries import ORACLES, QUERIES
from qsuite.check import compare, connect


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits=4):
    """Smallest position reachable from each position."""
    values, root = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits) + k + 1:
            a, b = find(k), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def test_fingerprints_and_components(docs, clashing, none, awkward):
    prints = [brute_print(t) for _, t, *_ in awkward]
    roots = brute_components(prints)
    least = {}
    for (key, *_), r in zip(awkward, roots):
        least[r] = min((x for x in (least.get(r), key) if x is not None), default=None)
    want = collections.Counter((key, f"{p:016x}", least[r]) for (key, *_), p, r in zip(awkward, prints, roots))
    for table in (docs, clashing):
        assert collections.Counter(tuple(r) for r in simhash.near_duplicates(table).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.first_of_each_group(clashing)
    assert kept.columns == clashing.columns
    groups = collections.defaultdict(list)
    for (key, *_), r in zip(awkward, roots):
        groups[r].append(key)
    want = sorted(min((k for k in g if k is not None), default=-1) for g in groups.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want


def dense_prints(seed, groups=30, n=60):
    """Random fingerprints, chains of links, and dense groups of several hundred."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(500)}
    for _ in range(groups):
        at = rng.getrandbits(64)
        for _ in range(n):
            out.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    for _ in range(700):
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    return sorted(out)


@pytest.mark.parametrize("segments,block", [(9, 2048), (9, 16), (13, 64), (17, 2048), (5, 100)])
def test_links_keep_every_component(spark, segments, block):
    values = dense_prints(segments)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4)
    links = simhash.fingerprint_links(distinct, segments=segments, block=block)
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    at, root = {v: k for k, v in enumerate(values)}, list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(values))] == brute_components(values)
    # a dense group of n gives no n * n / 2 pairs
    assert len(pairs) < 40 * len(values)


def test_ring_rejects_bad_shapes():
    for bits, segments in ((4, 4), (0, 9), (4, 65)):
        with pytest.raises(ValueError):
            simhash.Ring(bits, segments)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    names = list(range(400))
    rng.shuffle(names)
    pairs = [(names[k], names[k + 1]) for k in range(150)]  # a chain in random order
    pairs += [(names[200], names[k]) for k in range(201, 300)]  # a star
    pairs += [(names[310 + k], names[310 + (k + 1) % 20]) for k in range(20)] + [(5, 5), (None, 3)] + [(names[0], names[1])] * 3
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {}
    for group in (names[:151], names[200:300], names[310:330]):
        want |= {n: min(group) for n in group}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- shards --------------------------------------------------------------------------------

def brute_table(shards, slots):
    """Claims in turns, from whole preference lists."""
    import hashlib

    lists = {}
    for s in shards:
        d = hashlib.blake2b(s.encode(), digest_size=16).digest()
        offset, skip = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:], "little") % (slots - 1) + 1
        lists[s] = [(offset + k * skip) % slots for k in range(slots)]
        assert sorted(lists[s]) == list(range(slots))
    table = {}
    while len(table) < slots:
        for s in sorted(shards):
            slot = next((x for x in lists[s] if x not in table), None)
            if slot is not None:
                table[slot] = s
    return [table[k] for k in range(slots)]


def test_table_by_brute_force():
    shards = [f"s{n}" for n in range(7)]
    table = shard_table.fill_table(shards, 211)
    assert [shards[n] for n in table] == brute_table(shards, 211)
    counts = collections.Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    # the order of listing does not matter, and losing one shard moves few other slots
    other = shard_table.fill_table(shards[::-1], 211)
    assert [shards[::-1][n] for n in other] == [shards[n] for n in table]
    fewer = shard_table.fill_table(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(table.tolist(), fewer.tolist()) if a != 6)
    assert moved < 211 * 0.35
    weighted = collections.Counter(shard_table.fill_table(shards, 211, {"s0": 3}).tolist())
    assert 2.5 < weighted[0] / weighted[1] < 3.5
    for bad in (([], 211), (["a", "a"], 211), (["a"], 210), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            shard_table.fill_table(*bad)


def test_rows_are_placed(spark, docs, clashing, none, tmp_path):
    shards = ["x", "y", "z"]
    table = shard_table.fill_table(shards, 101)
    for rows in (docs, clashing):
        placed = shard_table.place_rows(rows, ["doc_id"], shards, 101, without_key=["text"])
        assert placed.count() == rows.count()
        hashes = placed.select("slot", "shard", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(101)).alias("h"))
        assert all(r.slot == r.h and shards[table[r.slot]] == r.shard for r in hashes.collect())
        assert placed.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).filter("doc_id is not null and n > 1").count() == 0
    assert shard_table.place_rows(none, ["doc_id"], shards, 101).count() == 0
    shard_table.write_shards(docs, str(tmp_path / "out"), ["doc_id"], shards, slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# -- queries and pipeline ------------------------------------------------------------------

@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    ok, message = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert ok, message


def test_all_operators_and_the_pipeline_are_registered():
    names = set(queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(oracle_sql()) <= names


def test_pipeline_stages(spark, sf_dir):
    from test_near_copies import kept_by
    from test_text_scans import brute_contamination, brute_windows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted(tuple(r) for r in docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "pack"]

    def run(name, rows):
        table = spark.createDataFrame(rows, docs.schema)
        out = stages[name](spark, table, sf_dir)
        return out.columns, sorted(tuple(r) for r in out.collect())

    columns, kept = run("language", rows + [(10**6, None, None, None, None), (10**6 + 1, "123 !", "en", "s", 5)])
    assert columns == docs.columns and kept == rows
    windows = brute_windows([(r[0], r[1]) for r in rows])
    want = []
    for r in rows:
        _, removed, text = windows[r[0], r[1]]
        if not removed or text.strip():
            want.append((r[0], text, r[2], r[3], len(text) if removed else r[4]))
    columns, kept = run("line_dedup", rows)
    assert columns == docs.columns and kept == want
    columns, kept = run("near_dedup", rows)
    assert columns == docs.columns and [r[0] for r in kept] == [k for k, _ in kept_by(rows)]
    columns, kept = run("decontaminate", rows)
    bad = {k[0] for k in brute_contamination(rows, items, 13) if k[-1]}
    assert columns == docs.columns and kept == [r for r in rows if r[0] not in bad] and bad


def test_line_stage_keeps_user_columns(spark, sf_dir, docs):
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    table = docs.drop("n_chars").withColumns({"_n_lines": F.lit("mine"), "_n_removed": F.lit("mine")})
    out = stage(spark, table, sf_dir)
    assert out.columns == table.columns
    assert {(r["_n_lines"], r["_n_removed"]) for r in out.collect()} == {("mine", "mine")}


def test_pipeline_runs_through(spark, sf_dir, awkward, docs):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(packed.columns)
    table = docs
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf_dir)
    assert table.count() > 0
    table = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf_dir)
    assert table.count() == 0
