"""Packing documents into training sequences by minimum bin slack.

How full a sequence can be made depends on piece lengths alone, and there are at most ``capacity`` of
those. So the pieces are counted by length, the packing is found for the counts, and each piece then
looks its place up by its rank among the pieces of its length. The driver sees one count per length,
whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from catalogkit.llm.textbytes import CHUNK_BYTES, chunks
from catalogkit.llm.tokens import MAX_PIECES, worker_tokens
from catalogkit.session import new_work_path

CAPACITY = 4096

Fill = tuple[list[tuple[int, int]], int]  # [(length, copies)], how often


def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The fullest multiset of available lengths within ``room``.

    Bit ``s`` of ``reach`` tells that some choice sums to ``s``. Copies of a length are added in powers of
    two. Longest first, and stopped once the room can be filled exactly.
    """
    reach, within = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << (length * copies) & within
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + copies
            target -= length * copies
    return list(chosen.items())


def minimum_slack(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Sequences for these piece counts, each with how often it is made.

    The longest piece left opens a sequence, the rest of it gets the fullest feasible combination of the
    pieces left, and the combination is removed as often as the counts allow.
    """
    counts = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    fills: list[Fill] = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = dict(_fullest(lengths, counts, capacity - first))
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[length] // copies for length, copies in chosen.items())
        for length, copies in chosen.items():
            counts[length] -= copies * times
        fills.append((sorted(chosen.items(), reverse=True), times))
        lengths = [length for length in lengths if counts[length] > 0]
    return fills


def places_of(fills: list[Fill]) -> np.ndarray:
    """Runs of ranks as rows ``length << 44 | low, low, base, copies, offset``, sorted.

    The piece with rank ``r`` in a run goes to sequence ``base + (r - low) // copies``.
    """
    taken: dict[int, int] = {}
    rows, sequences = [], 0
    for pieces, times in fills:
        at = 0
        for length, copies in pieces:
            low = taken.get(length, 0)
            rows.append((length << 44 | low, low, sequences, copies, at))
            taken[length] = low + copies * times
            at += length * copies
        sequences += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def find_places(places: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    keys, low, base, copies, offset = places.T
    run = np.searchsorted(keys, length << 44 | rank, "right") - 1
    after = rank - low[run]
    return base[run] + after // copies[run], offset[run] + after % copies[run] * length


def _cut(
    tokenizer: str, end_id: int, capacity: int, with_ids: bool, max_pieces: int = MAX_PIECES, slice_bytes: int = CHUNK_BYTES
) -> Callable:
    """Documents to pieces, each with its rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = worker_tokens(tokenizer, max_pieces=max_pieces), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(1), slice_bytes):
                ids, offsets = tokens.ids(batch.column(1).slice(first, end - first).to_pylist())
                row, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for k in range(end - first):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                        rank.append(seen[len(cut)])
                        seen[len(cut)] += 1
                        if with_ids:
                            kept.append(cut.astype(np.int32))
                keys = batch.column(0).slice(first, end - first).take(pa.array(row, pa.int64()))
                columns = [keys, pa.array(piece, pa.int32())]
                columns += [pa.array(values, pa.int64()) for values in (start, length, crc)]
                columns += [pa.array([part] * len(row), pa.int64()), pa.array(rank, pa.int64())]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                names = ["_key", "piece", "start", "length", "ids_crc32", "_part", "_rank"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    with_ids: bool = False,
    max_pieces: int = MAX_PIECES,
    slice_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked, ``ids``.

    A document is its token ids and then ``end_id``. Documents longer than ``capacity`` are cut into pieces
    of that length, the last of which may be shorter; pieces never share a document's place. Null and
    empty texts are one piece of ``end_id`` alone. Repeated rows and null keys are documents of their own.
    An empty table gives no rows. Columns other than ``key`` and ``text`` are not read.

    Pieces are stored once under the shared folder, so that ranks stay the same when a task is run again. A worker keeps about
    ``max_pieces`` words with their ids and encodes ``slice_bytes`` of text at once; neither changes a result.
    """
    spark = docs.sparkSession
    extra = ", ids array<int>" if with_ids else ""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, piece int, start long, length long, ids_crc32 long, _part long, _rank long{extra}"
    path = new_work_path(spark, "pieces")
    docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        _cut(tokenizer, end_id, capacity, with_ids, max_pieces, slice_bytes), schema
    ).write.parquet(path)
    pieces = spark.read.parquet(path)

    per_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(places_of(minimum_slack(counts, capacity)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_rank"))
    columns = ["_key", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_places(places.value, batch["length"].to_numpy(), batch["_rank"].to_numpy())
            arrays = [batch[c] for c in columns] + [pa.array(x, pa.int64()) for x in found]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    kept = f"_key {kind}, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long"
    placed = ranked.select(*columns, "_rank").mapInArrow(place, kept)
    return placed.withColumnRenamed("_key", key)
