"""Removal of byte strings that occur twice, by suffix buckets refined through the buckets of later offsets.

Two equal strings of ``length`` bytes have the same q-gram of least hash at the same place. So each text gives a few
anchors (about one in 170 bytes), each with the strings that it is the least q-gram of, one after the
other: its context. An anchor's q-gram is its first bucket. A bucket of one place holds no repeat; equal contexts are repeats
throughout. What is left, buckets of unlike contexts, is refined down to strings of ``length`` bytes: positions start in
buckets of 8 bytes and are sorted by their bucket and the bucket of a later offset, which doubles the depth; the new
buckets serve the next sort, and positions alone in theirs drop out. Buckets too large for one task are first refined on
Spark, by cells of neighbouring strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.llm.textbytes import chunks, span_hashes
from catalogkit.session import new_work_path

LENGTH = 400
QGRAM = 64
#: Contexts of one bucket that are refined in one task; larger buckets are refined on Spark.
BUCKET = 2048
#: Bytes of contexts refined together.
REFINE_BYTES = 1 << 20
#: Neighbouring strings per cell of a large bucket.
CELL = 16


def _identity(key: str, text: str) -> list[Column]:
    """128 bits that name a row; rows equal in key and text have the same name, and the same result."""
    named = [F.col(key), F.col(text)]
    return [F.xxhash64(*named).alias("r1"), F.xxhash64(F.lit("row"), *named).alias("r2")]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, qgram: int) -> tuple[np.ndarray, ...]:
    """``row, at, start, end, h, c`` of each anchor: its text, place and context, hashes of its q-gram and context."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return (empty,) * 4 + (np.empty(0, np.uint64),) * 2
    places = np.arange(len(data) - qgram + 1)
    hashes = span_hashes(data, places, places + qgram)
    bits = np.uint64(max(1, int(len(places)).bit_length()))
    # the place breaks ties of the hash: of equal q-grams the first is taken
    packed = (hashes >> bits << bits) | places.astype(np.uint64)
    first = _least(packed, length - qgram + 1)
    at = (first & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(at))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[row + 1]
    at, starts, row = at[inside], starts[inside], row[inside]
    if not len(at):
        return (empty,) * 4 + (np.empty(0, np.uint64),) * 2
    new = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(at)) - 1
    at, row, start, end = at[low], row[low], starts[low], starts[high] + length
    c = span_hashes(data, start, end) ^ ((at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, at, start, end, hashes[at], c


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, in order; touching ones become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > upto[:-1])
    return start[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)]


_ANCHOR = pa.struct([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("w", pa.int32())])
_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
_ANCHOR_SQL = "array<struct<h:long,c:long,at:int,s:int,e:int,w:int>>"
_SPAN_SQL = "array<struct<s:int,e:int>>"


def _find(length: int, qgram: int) -> Callable:
    """Anchors of each text. Contexts met twice in a chunk are known repeats; one of them stands for two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end_row, data, offsets in chunks(batch["text"]):
                row, at, s, e, h, c = anchors(data, offsets, length, qgram)
                if not len(row):
                    continue
                order = np.lexsort((c, h))
                new = np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))
                lows = np.flatnonzero(new)
                sizes = np.diff(np.append(lows, len(order)))
                twice = np.zeros(len(row), bool)
                twice[order[np.repeat(sizes > 1, sizes)]] = True
                kept = np.sort(order[lows])  # one of each
                spans_of, anchors_of = [], []
                base = offsets[row]
                rows = np.unique(row)
                a_cut = np.searchsorted(row[kept], np.append(rows, len(offsets)))
                all_cut = np.searchsorted(row, np.append(rows, len(offsets)))
                parts = []
                for n in range(len(rows)):
                    own = np.arange(all_cut[n], all_cut[n + 1])
                    own = own[twice[own]]
                    parts.append(_merged(s[own] - base[own], e[own] - base[own]))
                spans_of = np.append(0, np.cumsum([len(p[0]) for p in parts])).astype(np.int32)
                starts, ends = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (0, 1))
                place = [x[kept] - base[kept] for x in (at, s, e)]
                fields = [h[kept].view(np.int64), c[kept].view(np.int64), *[p.astype(np.int32) for p in place], (1 + twice[kept]).astype(np.int32)]
                found = pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(_ANCHOR))
                spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], fields=list(_SPAN))
                taken = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["r1"].take(taken), batch["r2"].take(taken),
                        pa.ListArray.from_arrays(pa.array(a_cut.astype(np.int32)), found),
                        pa.ListArray.from_arrays(pa.array(spans_of), spans),
                    ],
                    ["r1", "r2", "anchors", "spans"],
                )

    return run


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of ``length`` bytes, within their text, that another position starts too.

    Bucket refinement: first by eight bytes, then by a position's bucket and that of a later offset.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n < length or length < 8:
        return out
    ends = np.repeat(offsets[1:], np.diff(offsets))
    words = np.zeros(n - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | data[k : n - 7 + k]
    bucket = np.zeros(n, np.int64)
    at = np.flatnonzero(np.arange(n - 7) + 8 <= ends[: n - 7])
    keys, depth, fresh = words[at], 8, 0
    while True:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(at) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        sizes = np.bincount(number, minlength=1) if len(at) else np.zeros(1, np.int64)
        bucket[at[order]] = fresh + number
        fresh += int(number[-1]) + 1 if len(at) else 0
        shared = np.zeros(len(at), bool)
        shared[order] = sizes[number] > 1 if len(at) else False
        at = at[shared]
        if depth == length or not len(at):
            out[at] = depth == length
            return out
        ahead = min(depth, length - depth)
        depth += ahead
        at = at[at + depth <= ends[at]]
        keys = bucket[at].astype(np.uint64) << np.uint64(32) | bucket[at + ahead].astype(np.uint64)


def _refine(length: int, most: int) -> Callable:
    """Contexts sorted by bucket to the spans of the repeats in those that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def solved(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            column = part["bytes"].combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            hit = repeated_starts(data, offsets, length)
            row = np.repeat(np.arange(len(column)), np.diff(offsets))
            hit &= ~part["known"].to_numpy()[row]
            places = np.flatnonzero(hit)
            own = row[places]
            # neighbouring starts make one span
            new = np.append(True, (np.diff(places) > 1) | (np.diff(own) > 0)) if len(places) else np.zeros(0, bool)
            last = np.append(new[1:], True) if len(places) else new
            s = places[new] - offsets[own[new]] + part["s"].to_numpy()[own[new]]
            e = places[last] - offsets[own[last]] + part["s"].to_numpy()[own[last]] + length
            taken = pa.array(own[new])
            arrays = [part["r1"].combine_chunks().take(taken), part["r2"].combine_chunks().take(taken)]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["r1", "r2", "s", "e"])

        for batch in batches:
            at = 0
            h = batch["h"].to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)) if len(h) else np.zeros(1, np.int64)
            bytes_upto = np.append(0, np.cumsum(pa.compute.binary_length(batch["bytes"]).to_numpy()))
            for low in cuts[:-1].tolist():
                # a bucket may start only where no other is cut
                more = bytes_upto[low] - bytes_upto[at]
                starts_new = low > 0 or not kept or kept[-1]["h"][-1].as_py() != int(h[0])
                if size + more >= most and starts_new:
                    if low > at:
                        kept.append(batch.slice(at, low - at))
                    if kept:
                        yield solved(pa.Table.from_batches(kept))
                    kept, size, at = [], 0, low
            if len(h) > at:
                kept.append(batch.slice(at))
                size += int(bytes_upto[-1] - bytes_upto[at])
        if kept:
            yield solved(pa.Table.from_batches(kept))

    return run


def _cells(length: int, cell: int) -> Callable:
    """Each context cut into cells of ``cell`` neighbouring strings, on a grid around its anchor.

    ``core`` names the bytes that all strings of a whole cell share, ``whole`` those of the cell's own strings here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                data = np.frombuffer(batch["bytes"][r].as_py(), np.uint8)
                at, s = batch["at"][r].as_py(), batch["s"][r].as_py()
                low, high = s - at, s - at + len(data) - length  # offsets of the strings from the anchor
                number = np.arange(low // cell, high // cell + 1)
                a, b = np.maximum(number * cell, low), np.minimum(number * cell + cell - 1, high)
                core = span_hashes(data, number * cell + cell - 1 - low, number * cell + length - low)
                whole = span_hashes(data, a - low, b - low + length) ^ (a - number * cell).astype(np.uint64)
                n = len(number)
                once = lambda name: batch[name].slice(r, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        once("h"), pa.array(number.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)),
                        once("known"), once("r1"), once("r2"), once("at"), pa.array((at + a).astype(np.int32)), pa.array((at + b).astype(np.int32)),
                    ],
                    ["h", "cell", "core", "whole", "known", "r1", "r2", "at", "a", "b"],
                )

    return run


def _strings(length: int) -> Callable:
    """128-bit hash of each string of the cells asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                data, s = np.frombuffer(batch["bytes"][r].as_py(), np.uint8), batch["s"][r].as_py()
                asked = batch["asked"][r].as_py()
                p = np.concatenate([np.arange(x["a"], x["b"] + 1) for x in asked])
                x1 = span_hashes(data, p - s, p - s + length)
                # another base: the bytes turned round
                turned = data[::-1]
                x2 = span_hashes(turned, len(data) - (p - s) - length, len(data) - (p - s))
                n = len(p)
                once = lambda name: batch[name].slice(r, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [once("h"), pa.array(x1.view(np.int64)), pa.array(x2.view(np.int64)), once("known"), once("r1"), once("r2"), pa.array(p.astype(np.int32))],
                    ["h", "x1", "x2", "known", "r1", "r2", "p"],
                )

    return run


def _large_buckets(contexts: DataFrame, length: int, cell: int) -> DataFrame:
    """Spans ``r1, r2, s, e`` of the repeats in buckets of any size: refined by cells, then by single strings, counted by key."""
    kinds = "h long, cell int, core long, whole long, known boolean, r1 long, r2 long, at int, a int, b int"
    cells = contexts.select("h", "at", "s", "bytes", "known", "r1", "r2").mapInArrow(_cells(length, cell), kinds)
    weight = F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n")
    met = cells.groupBy("h", "cell", "core").agg(weight, F.min("whole").alias("w1"), F.max("whole").alias("w2")).filter("n > 1")
    shared = cells.join(met.select("h", "cell", "core", (F.col("w1") != F.col("w2")).alias("unlike")), ["h", "cell", "core"])
    path = new_work_path(contexts.sparkSession, "cells")
    shared.select("h", "known", "unlike", "r1", "r2", "at", "a", "b").write.parquet(path)
    shared = contexts.sparkSession.read.parquet(path)
    alike = shared.filter("not unlike and not known").select("r1", "r2", F.col("a").alias("s"), (F.col("b") + length).alias("e"))
    asked = shared.filter("unlike").groupBy("r1", "r2", "at").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    joined = contexts.join(asked, ["r1", "r2", "at"]).select("h", "s", "bytes", "known", "r1", "r2", "asked")
    strings = joined.mapInArrow(_strings(length), "h long, x1 long, x2 long, known boolean, r1 long, r2 long, p int")
    twice = strings.groupBy("h", "x1", "x2").agg(weight).filter("n > 1").drop("n")
    single = strings.filter("not known").join(twice, ["h", "x1", "x2"]).select("r1", "r2", F.col("p").alias("s"), (F.col("p") + length).alias("e"))
    return alike.unionByName(single)


def _packed(texts: pa.Array) -> pa.Array:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())


def _unpacked(data: bytes | None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data is not None else b""


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h", "k", "known", "at", "s"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
    for batch in batches:
        for r in range(len(batch)):
            text, asked = _unpacked(batch["packed"][r].as_py()), batch["asked"][r].as_py()
            columns = [pa.array([x[n] for x in asked], k) for n, k in zip(names, kinds)]
            parts = pa.array([text[x["s"] : x["e"]] for x in asked], pa.binary())
            same = [batch[n].slice(r, 1).take(pa.array(np.zeros(len(asked), np.int64))) for n in ("r1", "r2")]
            yield pa.RecordBatch.from_arrays([*columns, *same, parts], [*names, "r1", "r2", "bytes"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, spans, kept = [], [], []
        for packed, own in zip(batch["packed"], batch["own"].to_pylist()):
            text = _unpacked(packed.as_py())
            pairs = [x for part in own or [] for x in part]
            s, e = _merged(np.array([x["s"] for x in pairs], np.int64), np.array([x["e"] for x in pairs], np.int64))
            view, before, out = memoryview(text), 0, []
            for a, b in zip(s.tolist(), e.tolist()):
                out.append(view[before:a])
                before = b
            out.append(view[before:])
            sizes.append(len(text))
            spans.append([{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())])
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays(
            [batch["key"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())],
            ["key", "n_bytes", "spans", "kept"],
        )


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, qgram: int = QGRAM, bucket: int = BUCKET, cell: int = CELL
) -> DataFrame:
    """``r1, r2, own``: per row name the lists of spans ``(s, e)`` that repeats of ``length`` bytes cover."""
    if not 8 <= qgram < length - cell:
        raise ValueError("q-grams have 8 bytes at least and are shorter than what is looked for")
    spark = docs.sparkSession
    named = docs.select(*_identity(key, text), F.col(text).alias("text"))
    path = new_work_path(spark, "anchors")
    rows = named.filter(F.octet_length("text") >= length)
    rows.mapInArrow(_find(length, qgram), f"r1 long, r2 long, anchors {_ANCHOR_SQL}, spans {_SPAN_SQL}").write.parquet(path)
    found = spark.read.parquet(path)
    every = found.select("r1", "r2", F.explode("anchors").alias("x")).select("r1", "r2", "x.*")
    met = every.groupBy("h").agg(F.sum("w").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("n > 1")
    path = new_work_path(spark, "shared")
    every.join(met.select("h", (F.col("c1") != F.col("c2")).alias("unlike")), "h").write.parquet(path)
    shared = spark.read.parquet(path)
    alike = shared.filter("not unlike and w = 1").select("r1", "r2", "s", "e")
    unlike = shared.filter("unlike")
    place = F.struct("r1", "r2", "at", "s", "e").alias("one")
    kinds = unlike.groupBy("h", "c").agg(F.sum("w").alias("n"), F.min(place).alias("one"))
    alike = alike.unionByName(unlike.join(kinds.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("r1", "r2", "s", "e"))
    # one context of each kind goes on
    per_bucket = kinds.groupBy("h").agg(F.count("*").alias("k"))
    asked = kinds.join(per_bucket, "h").select("one.*", "h", "k", (F.col("n") > 1).alias("known"))
    asked = asked.groupBy("r1", "r2").agg(F.collect_list(F.struct("h", "k", "known", "at", "s", "e")).alias("asked"))
    packed = rows.select("r1", "r2", F.arrow_udf(_packed, "binary")("text").alias("packed"))
    contexts = packed.join(asked, ["r1", "r2"]).mapInArrow(
        _contexts, "h long, k long, known boolean, at int, s int, r1 long, r2 long, bytes binary"
    )
    path = new_work_path(spark, "contexts")
    contexts.write.option("compression", "zstd").parquet(path)
    contexts = spark.read.parquet(path)
    small = contexts.filter(F.col("k") <= bucket).select("h", "known", "s", "r1", "r2", "bytes")
    small = small.repartition("h").sortWithinPartitions("h").mapInArrow(_refine(length, REFINE_BYTES), "r1 long, r2 long, s int, e int")
    large = _large_buckets(contexts.filter(F.col("k") > bucket), length, cell)
    lists = alike.unionByName(small).unionByName(large).groupBy("r1", "r2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    both = lists.unionByName(found.filter(F.size("spans") > 0).select("r1", "r2", "spans"))
    return both.groupBy("r1", "r2").agg(F.collect_list("spans").alias("own"))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, qgram: int = QGRAM, bucket: int = BUCKET, cell: int = CELL
) -> DataFrame:
    """``key, n_bytes, spans, kept``: the bytes of each text outside all strings of ``length`` bytes that also start elsewhere.

    Texts are UTF-8 bytes, null is empty. A string counts as repeated wherever else it starts, also in the same text and
    overlapping itself; it is judged on the texts as they came, so all its places go, also the first. ``kept`` is
    binary, since a cut may fall inside a character. Texts shorter than ``length`` stay whole. Repeated rows
    are repeats of each other; null keys are kept; an empty table gives no rows. A text of any length is one row, in
    memory some fifty times its length. Only ``key`` and ``text`` are read, whatever other columns are named.

    Texts cross the network packed, twice: to cut contexts out of those that share a bucket with unlike ones, and to be cut.
    """
    own = repeated_spans(docs, key, text, length, qgram, bucket, cell)
    packed = docs.select(F.col(key).alias("key"), *_identity(key, text), F.arrow_udf(_packed, "binary")(F.col(text)).alias("packed"))
    kind = packed.schema["key"].dataType.simpleString()
    joined = packed.join(own, ["r1", "r2"], "left").select("key", "packed", "own")
    return joined.mapInArrow(_cut, f"key {kind}, n_bytes long, spans {_SPAN_SQL}, kept binary").withColumnRenamed("key", key)
