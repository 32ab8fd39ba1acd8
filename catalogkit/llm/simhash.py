"""SimHash near-duplicates; candidate pairs come from the pigeonring principle.

Cut a 64-bit difference of at most ``bits`` ones into a ring of ``segments``. From some segment on, every chain of
``l`` consecutive segments has at most ``l * bits / segments`` ones, or the whole ring would have more. So
a chain starts with segments that agree outright, followed by some that may differ in one bit in
total; these segments make the join key. Pairs that share a key must then keep the budget along the
whole ring before their full distance is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalogkit.llm.components import connected_components
from catalogkit.session import cut_lineage

SHINGLE = 4
BITS = 4
SEGMENTS = 9
#: Fingerprints of one key that are compared within one group; larger keys are split into pairs of blocks.
BLOCK = 2048
_SMALL = 8


def _fingerprints(size: int) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            words = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
            if not words:
                continue
            joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
            starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            width = min(size, len(words))
            ends = (starts + lengths)[width - 1 :].tolist()
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends)]
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 14):
                block = np.array(hashes[at : at + (1 << 14)], ">u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
            out[row] = np.packbits(ones * 2 > len(hashes)).view(">i8")[0]
        return pa.array(out)

    return run


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, *more: str
) -> DataFrame:
    """``key``, ``more`` and the 64-bit ``fp`` of each document's word shingles (see ``near_duplicates``)."""
    return docs.select(F.col(key), *more, F.arrow_udf(_fingerprints(size), "long")(F.col(text)).alias("fp"))


class Ring:
    """Masks and budgets of a ring of segments for differences of at most ``bits`` ones."""

    def __init__(self, bits: int, segments: int):
        if not 0 < bits < segments <= 64:
            raise ValueError("the ring needs more segments than differing bits, and at most 64")
        cuts = [64 * k // segments for k in range(segments + 1)]
        boxes = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(segments)]
        self.budget = [length * bits // segments for length in range(segments + 1)]
        # per start: the masks of its chains of length 1, 2, ...
        self.chains = []
        #: Per start and, if one of the segments that share a one may differ, per segment left out.
        self.keys: list[tuple[int, int]] = []
        equal = max(n for n in range(1, segments) if self.budget[n] == 0)
        shared = max(n for n in range(1, segments + 1) if self.budget[n] <= 1) - equal
        for start in range(segments):
            ring = [boxes[(start + k) % segments] for k in range(segments)]
            chain = [0]
            for box in ring:
                chain.append(chain[-1] | box)
            self.chains.append(chain)
            for left_out in range(shared):
                self.keys.append((start, chain[equal + shared] & ~ring[equal + left_out]))

    def linked(self, start: int, difference: np.ndarray) -> np.ndarray:
        """Places of the differences that keep every budget along the ring, and so are within ``bits``."""
        at = np.arange(len(difference))
        for length, budget in enumerate(self.budget[1:], 1):
            mask = np.uint64(self.chains[start][length])
            at = at[np.bitwise_count(difference[at] & mask) <= budget]
        return at


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _group_links(ring: Ring, start: int, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of one group's links: each fingerprint is reached at most once."""
    unreached = np.unique(fps)
    while len(unreached):
        frontier, unreached = [unreached[0]], unreached[1:]
        while frontier and len(unreached):
            one = frontier.pop()
            near = ring.linked(start, unreached ^ one)
            if len(near):
                found = unreached[near]
                yield one, found
                frontier.extend(found)
                unreached = np.delete(unreached, near)


def _links(ring: Ring) -> Callable:
    """Rows sorted by group to links; a group's fingerprints all link within the group or not at all."""
    kinds = [start for start, _ in ring.keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def solved(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            kind, value, pair, fps = part
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])
            lows = np.flatnonzero(new)
            sizes = np.diff(np.append(lows, len(kind)))
            left, right = [], []
            small = sizes <= _SMALL
            # groups of a few rows side by side: each row against the following ones of its group
            left_in_group = np.repeat(lows + sizes, sizes) - np.arange(len(kind)) - 1
            left_in_group[~np.repeat(small, sizes)] = 0
            for ahead in range(1, _SMALL):
                at = np.flatnonzero(left_in_group >= ahead)
                for start in np.unique(starts_of[kind[at]]):
                    own = at[starts_of[kind[at]] == start]
                    hit = own[ring.linked(int(start), fps[own] ^ fps[own + ahead])]
                    left.append(fps[hit])
                    right.append(fps[hit + ahead])
            for low, size in zip(lows[~small].tolist(), sizes[~small].tolist()):
                for one, found in _group_links(ring, kinds[kind[low]], fps[low : low + size]):
                    left.append(np.full(len(found), one, np.uint64))
                    right.append(found)
            ends = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (left, right)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        starts_of = np.array(kinds)
        for batch in batches:
            part = tuple(batch[c].to_numpy() for c in ("kind", "value", "pair"))
            part += (batch["fp"].to_numpy().view(np.uint64),)
            if rest is not None:
                part = tuple(np.concatenate(x) for x in zip(rest, part))
            if not len(part[0]):
                continue
            # the last group may go on in the next batch; groups have two blocks at most
            same = (part[0] == part[0][-1]) & (part[1] == part[1][-1]) & (part[2] == part[2][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = tuple(x[last:] for x in part)
            if last:
                yield solved(tuple(x[:last] for x in part))
        if rest is not None and len(rest[0]):
            yield solved(rest)

    return run


def fingerprint_links(distinct: DataFrame, bits: int = BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that keep all components of the full link set.

    A key shared by one fingerprint alone is dropped. One shared by more than ``block`` is split: its
    fingerprints get block numbers, and each pair of blocks is a group of its own. A group gives at most
    a spanning forest of its links (all of them where it has only a few rows), never all pairs of a dense group.
    """
    ring = Ring(bits, segments)
    rows = [
        F.struct(F.lit(n).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for n, (_, mask) in enumerate(ring.keys)
    ]
    keyed = distinct.select("fp", F.explode(F.array(*rows)).alias("k")).select("k.kind", "k.value", "fp")
    shared = keyed.groupBy("kind", "value").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(shared, ["kind", "value"])
    n = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1), lambda other: F.least(own, other) * n + F.greatest(own, other)
    )
    grouped = keyed.select("kind", "value", "fp", F.explode(pairs).alias("pair"))
    grouped = grouped.repartition("kind", "value", "pair").sortWithinPartitions("kind", "value", "pair", "fp")
    return grouped.mapInArrow(_links(ring), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    bits: int = BITS,
    segments: int = SEGMENTS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``key, fingerprint`` (16 hex digits) and ``component_id``.

    A-Z is lower-cased, words are runs without ASCII white space, shingles are ``size`` words joined by a
    space, repeats included; shorter texts are one shingle. A fingerprint bit is set if it is set in over
    half of the shingles' XXH64 (seed 42). Null and blank texts have fingerprint zero and are linked like any
    other. Documents with fingerprints ``bits`` or fewer apart are linked; ``component_id`` is the smallest
    key reachable, null if the component has only null keys. Repeated rows and keys each keep their row;
    an empty table gives none. Long texts are taken whole, in memory of some ten times the longest. Only ``key`` and ``text`` are read.

    Equal fingerprints are brought together first, so copies cost one row. More ``segments`` make more
    keys that are each shared by fewer: 9 suit up to some hundred million texts, 13 or 17 more.
    """
    prints = cut_lineage(fingerprints(docs, key, text, size).select(F.col(key).alias("key"), "fp"))
    return prints.join(_components(prints, bits, segments, block), "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(prints: DataFrame, bits: int, segments: int, block: int) -> DataFrame:
    """``fp, root, component_id`` of each fingerprint in ``prints`` (``key, fp``)."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("least")))
    found = connected_components(fingerprint_links(distinct, bits, segments, block))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def first_of_each_group(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, bits: int = BITS,
    segments: int = SEGMENTS, block: int = BLOCK,
) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``: that with the smallest key.

    Null keys come last; among equal keys the text's hash decides, and of equal rows one stays. All columns
    are kept.
    """
    # the columns travel as one, so that names of ``docs`` meet none used here
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
    )
    prints = cut_lineage(fingerprints(rows, "key", "text", size, "row"))
    named = prints.join(_components(prints, bits, segments, block).select("fp", "root"), "fp")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "row")).alias("f"))
    kept = first.select(F.col("f.key").alias("kept_key"), F.col("f.row").alias("kept_row"))
    own = F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("row") == F.col("kept_row"))
    return rows.join(kept, own, "left_semi").dropDuplicates(["key", "row"]).select("doc.*")
