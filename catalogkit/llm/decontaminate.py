"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The benchmark's windows of ``size`` words are held in bounded blocks, as hashes and stretches of the items' words. A block is
broadcast and the corpus scanned for its window hashes, whose hits are then verified word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalogkit.llm.textbytes import chunks, lower_table, runs, span_hashes, window_hashes, word_table
from catalogkit.session import new_work_path

WINDOW = 13
BLOCK_BYTES = 32 << 20
HITS = "n_words long, spans array<struct<low long, high long, start long, end long>>, items array<string>"
# a word: ASCII letters and digits, and every byte of other characters
_LETTERS = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts and ends of the words."""
    starts, ends = runs(word_table(_LETTERS)[data], offsets)
    return lower_table()[data], starts, ends


class Entries(NamedTuple):
    """Windows of one word count: sorted hashes, and where each hash's entries begin among ``item, start, end``."""

    width: int
    known: np.ndarray
    first: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray


# item ids, their words joined by spaces, and the fields of Entries per word count: plain values, since broadcasts
# are read where this package may be absent
Windows = tuple[list[str], bytes, list[tuple]]


def _windows(items: list[tuple[object, str]], size: int) -> Windows:
    """Windows of whole items, held as stretches of the items' own words: about 20 bytes a word beside the text."""
    ids: list[str] = []
    joined: list[bytes] = []
    parts: dict[int, list[tuple]] = {}
    at = 0
    for item, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        lowered, starts, ends = _words(data, np.array([0, len(data)]))
        if not len(starts):
            continue
        width = min(size, len(starts))
        first = at + np.concatenate([[0], np.cumsum(ends - starts + 1)[:-1]])
        last = first + (ends - starts)
        hashes = window_hashes(span_hashes(lowered, starts, ends), width)
        n = len(hashes)
        parts.setdefault(width, []).append((hashes, np.full(n, len(ids), np.int32), first[:n], last[width - 1 :]))
        joined.append(b" ".join([lowered[s:e].tobytes() for s, e in zip(starts, ends)]))
        at += len(joined[-1]) + 1
        ids.append(str(item))
    sets = []
    for width, found in sorted(parts.items()):
        hashes, item, start, end = (np.concatenate(column) for column in zip(*found))
        order = np.argsort(hashes, kind="stable")
        known, first = np.unique(hashes[order], return_index=True)
        sets.append((width, known, np.append(first, len(order)), item[order], start[order], end[order]))
    return ids, b" ".join(joined), sets


def _filters(windows: Windows) -> list[np.ndarray]:
    """Per word count, which low hash bits occur: most corpus windows end here."""
    out = []
    for entries in map(Entries._make, windows[2]):
        maybe = np.zeros(1 << 20, bool)
        maybe[(entries.known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        out.append(maybe)
    return out


def _occurrences(
    windows: Windows, filters: list[np.ndarray], lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray
) -> Iterator[tuple[int, int, frozenset[str]]]:
    """``(first word, words, item ids)`` of each verified occurrence; ``upto`` are the documents' last words."""
    if not len(starts):
        return
    ids, text, sets = windows
    hashes = span_hashes(lowered, starts, ends)
    for entries, maybe in zip(map(Entries._make, sets), filters):
        width, known = entries.width, entries.known
        found = window_hashes(hashes, width)
        if not len(found):
            continue
        at = np.flatnonzero(maybe[(found & np.uint64(0xFFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
        same = known[slot] == found[at]
        at, slot = at[same], slot[same]
        inside = at + width <= upto[np.searchsorted(upto, at, "right")]  # not on into the next document
        verified: dict[bytes, frozenset[str]] = {}
        for k, row in zip(at[inside].tolist(), slot[inside].tolist()):
            words = b" ".join([lowered[s:e].tobytes() for s, e in zip(starts[k : k + width], ends[k : k + width])])
            if words not in verified:
                low, high = entries.first[row], entries.first[row + 1]
                spans = zip(entries.item[low:high].tolist(), entries.start[low:high].tolist(), entries.end[low:high].tolist())
                verified[words] = frozenset(ids[item] for item, start, end in spans if text[start:end] == words)
            if verified[words]:
                yield k, width, verified[words]


def _scan(block: Broadcast) -> Callable:
    """Texts to their word count, hit stretches (in words and in bytes) and the items found."""
    span = pa.struct([(name, pa.int64()) for name in ("low", "high", "start", "end")])

    @F.arrow_udf(HITS)
    def hits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows: Windows = block.value
        filters = _filters(windows)
        for column in columns:
            n_words, spans, items = [], [], []
            for row, end, data, offsets in chunks(column):
                lowered, starts, ends = _words(data, offsets)
                first = np.searchsorted(starts, offsets)
                found: dict[int, tuple[list, set]] = {}
                for k, width, owners in _occurrences(windows, filters, lowered, starts, ends, first[1:]):
                    doc = int(np.searchsorted(first, k, "right")) - 1
                    at, ids = found.setdefault(doc, ([], set()))
                    ids.update(owners)
                    if at and at[-1][0] <= k <= at[-1][1]:
                        at[-1][1] = max(at[-1][1], k + width)
                    else:
                        at.append([k, k + width])
                n_words.append(np.diff(first))
                for doc in range(end - row):
                    at, ids = found.get(doc, ((), ()))
                    spans.append([
                        (low - int(first[doc]), high - int(first[doc]),
                         int(starts[low] - offsets[doc]), int(ends[high - 1] - offsets[doc]))
                        for low, high in at
                    ])
                    items.append(sorted(ids))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                    pa.array([[dict(zip(("low", "high", "start", "end"), x)) for x in one] for one in spans], pa.list_(span)),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["n_words", "spans", "items"],
            )

    return hits


def _fresh(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _with_hits(
    docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, size: int, block_bytes: int
) -> tuple[DataFrame, str]:
    """``docs`` with a column of ``n_words, spans, items`` and its name; spans are sorted and may overlap, items are sorted.

    A benchmark of one block is scanned for in one pass without a shuffle. A larger one is cut into blocks of about
    ``block_bytes`` of text by hash, and the stored documents are scanned once a block, so the driver and
    a worker hold one block at a time, whatever the benchmark's size; what the passes found meets by row, at most one piece a block.
    Copies of an item (id and text) are one row first. A single item has to fit a block's memory.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    hits = _fresh(docs.columns, "_hits")

    def block(part: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(_windows([(r[0], r[1]) for r in part.select("item", "text").collect()], size))

    if n == 1:
        found = _scan(block(items))(F.col(text))
        return docs.withColumn(hits, found.withField("spans", F.array_sort(found["spans"]))), hits
    dealt = new_work_path(spark, "benchmark-blocks")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).write.partitionBy("block").parquet(dealt)
    parts = spark.read.schema("item string, text string, block long").parquet(dealt)
    row = _fresh(docs.columns, "_row")
    path = new_work_path(spark, "benchmark-docs")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.schema(T.StructType([*docs.schema.fields, T.StructField(row, T.LongType())])).parquet(path)
    out = new_work_path(spark, "benchmark-hits")
    for b in range(n):
        held = block(parts.filter(F.col("block") == b))
        found = stored.select(F.col(row).alias("row"), _scan(held)(F.col(text)).alias("found")).select("row", "found.*")
        # the first pass counts the words of every row
        found.filter(F.lit(b == 0) | (F.size("spans") > 0)).write.mode("append").parquet(out)
        held.destroy()
    passes = spark.read.schema(f"row long, {HITS}").parquet(out)
    united = passes.groupBy("row").agg(
        F.struct(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).alias(hits)
    )
    return stored.join(united.withColumnRenamed("row", row), row).select(*[f"`{c}`" for c in docs.columns], hits), hits


def _n_hit(spans: Column) -> Column:
    """Words in the union of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, span: Column) -> Column:
        new = F.greatest(span["high"] - F.greatest(span["low"], seen["upto"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(seen["upto"], span["high"]).alias("upto"), (seen["n"] + new).alias("n"))

    return F.aggregate(spans, start, add, lambda seen: seen["n"])


def _bad(hits: Column) -> Column:
    n_hit = _n_hit(hits["spans"])
    return (n_hit > 0) & (n_hit * 20 >= hits["n_words"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans``.

    A word inside any occurrence of an item's window of ``size`` words is hit; an item of fewer words is
    one window. A document is contaminated if at least a twentieth of its words are hit. ``spans``
    holds the hit stretches, counted in words and in bytes of the UTF-8 text. Null and empty texts have no words and are clean; items
    without words match nothing; an empty benchmark marks nothing; a null item id is written ``None``.
    Repeated rows count separately, but an item id counts once. Long texts are scanned whole, a chunk of whole texts at a time.
    Only the named columns are read.
    """
    found, name = _with_hits(docs.select(key, text), benchmark, text, item, item_text, size, block_bytes)
    hits = F.col(name)
    return found.select(
        key,
        hits["n_words"].alias("n_words"),
        _n_hit(hits["spans"]).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ",").cast("binary"), 256).alias("items_sha256"),
        _bad(hits).alias("contaminated"),
        hits["items"].alias("items"),
        hits["spans"].alias("spans"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the contaminated documents, by the rule of ``contamination``; all columns stay."""
    found, hits = _with_hits(docs, benchmark, text, item, item_text, size, block_bytes)
    return found.filter(~_bad(F.col(hits))).drop(hits)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the given byte spans."""
    out = []
    for text, cuts in zip(texts, spans):
        if text.is_valid and len(cuts):
            data, kept, at = text.as_buffer().to_pybytes(), [], 0
            for cut in cuts.as_py():
                kept.append(data[at : max(at, cut["start"])])
                at = max(at, cut["end"])
            out.append(b"".join([*kept, data[at:]]).decode())
        else:
            out.append(text.as_py())
    return pa.array(out, pa.string())


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with every hit stretch cut out of the text, whatever its share; null texts stay null."""
    found, hits = _with_hits(docs, benchmark, text, item, item_text, size, block_bytes)
    return found.withColumn(text, F.arrow_udf(_cut, "string")(F.col(text), F.col(hits)["spans"])).drop(hits)
