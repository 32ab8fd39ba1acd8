"""Alignment of two tokenizers over the same bytes, by merging all texts of a batch in lockstep.

Both tokenizers cut a text's bytes, one at the ends ``ea``, the other at ``eb``. One state vector holds a pointer
into each for every text of a batch; a step moves the pointer whose token ends first, or both where the ends
agree, which is a cut and a link, and texts that are through leave the vector.

Two linked tokens end together, so one's bytes end with the other's. Hence the id pairs that can ever be linked
follow from the two vocabularies alone (some hundred thousand), and corpus-wide counts fit an array of that length.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalogkit.llm.textbytes import chunks
from catalogkit.llm.tokens import _byte_letters, _with_room
from catalogkit.session import new_work_path

#: Texts of more first-side tokens go through the merge as several lanes of about this many.
LANE = 2048
#: Pieces kept per worker; 150,000 with their ids take about 60 MB.
MAX_PIECES = 150_000
# Fixed value: how the public byte-level vocabulary splits text before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

Tokens = tuple[np.ndarray, np.ndarray]  # ids and offsets of each text


class _Pool:
    """Ids of numbered pieces, kept in one array."""

    def __init__(self) -> None:
        self.ids = np.empty(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, upto = self.n + len(found), self.used + int(sizes.sum())
        self.ids = _with_room(self.ids, upto)
        self.starts, self.sizes = _with_room(self.starts, n), _with_room(self.sizes, n)
        self.ids[self.used : upto] = np.fromiter(chain.from_iterable(found), np.int32, upto - self.used)
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, upto

    def take(self, at: np.ndarray, ends: np.ndarray) -> Tokens:
        sizes = self.sizes[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        where = np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])
        return self.ids[where], upto[ends]


class TwoTokenizers:
    """Ids of both sides for whole texts with one space before them.

    Neither vocabulary has a token that goes from other signs on into a space, tab or line end (checked here), so
    the ids of a text are those of its pieces, each a run of such space with what follows. A piece is encoded
    once per worker. Texts with other white space, or with a piece that one side does not give back byte
    for byte, are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str, max_pieces: int = MAX_PIECES):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte = {letter: b for b, letter in _byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): n for t, n in vocab.items() if all(c in byte for c in t)}
        core = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.encode_a = core._core_bpe.encode_ordinary
        self.a = [b""] * (max(vocab.values()) + 1)
        for token, n in ranks.items():
            self.a[n] = token
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = lambda texts: model.encode(texts, num_threads=1)
        pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        self.b = [
            bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)
        ]
        self.space = model.piece_to_id("▁")
        gap = re.compile(r"[^ ] |[\n\t]")
        if any(gap.search(p.replace("▁", " ")) for n, p in enumerate(pieces) if not model.is_byte(n)):
            raise ValueError("a token of the second vocabulary goes on over white space")
        self.pieces = re.compile(r"[ \n\t]+[^ \n\t]*").findall
        # white space of either side's rules that is not cut at
        self.odd = re.compile(r"[^\S \n\t]").search
        self.max_pieces = max_pieces
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.pools = (_Pool(), _Pool())
        self.bad = np.zeros(1 << 14, bool)

    def _b_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The model puts a space before what it gets: pieces with one give it up, others lose the added token."""
        found = self.encode_b([p[1:] if p[0] == " " else p for p in pieces])
        for n, (piece, ids) in enumerate(zip(pieces, found)):
            if piece == " ":
                found[n] = [self.space]
            elif piece[0] != " ":
                found[n] = ids[1:] if ids[0] == self.space else []
        return found

    def _learn(self, pieces: list[str]) -> None:
        first, n = len(self.code), len(self.code) + len(pieces)
        sides = [self.encode_a(p) for p in pieces], self._b_pieces(pieces)
        self.bad = _with_room(self.bad, n)
        for pool, names, found in zip(self.pools, (self.a, self.b), sides):
            pool.add(found)
            for k, (piece, ids) in enumerate(zip(pieces, found), first):
                if b"".join([names[i] for i in ids]) != piece.encode():
                    self.bad[k] = True
        self.code.update(zip(pieces, range(first, n)))

    def _whole(self, text: str) -> tuple[list[int], list[int]]:
        sides = self.encode_a(" " + text), self.encode_b([text])[0]
        want = (" " + text).encode()
        return sides if all(b"".join([t[i] for i in ids]) == want for t, ids in zip((self.a, self.b), sides)) else ([], [])

    def ids(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """Both sides' ids; null, empty and not exactly covered texts have none."""
        if len(self.code) > self.max_pieces:
            self._reset()
        words: list[str] = []
        ends, whole = [0], {}
        for row, text in enumerate(texts):
            if text and self.odd(text):
                whole[row] = self._whole(text)
            elif text:
                words += self.pieces(" " + text)
            ends.append(len(words))
        get = self.code.get
        codes = list(map(get, words))
        if None in codes:
            self._learn(list({w for w, c in zip(words, codes) if c is None}))
            codes = list(map(self.code.__getitem__, words))
        at, upto = np.fromiter(codes, np.int64, len(codes)), np.array(ends)
        for place in np.flatnonzero(self.bad[at]).tolist():
            row = int(np.searchsorted(upto, place, "right")) - 1
            if row not in whole:
                whole[row] = self._whole(texts[row])
        sides = tuple(pool.take(at, upto) for pool in self.pools)
        if not whole:
            return sides
        return tuple(_replaced(*side, {row: found[k] for row, found in whole.items()}) for k, side in enumerate(sides))


def _replaced(ids: np.ndarray, offsets: np.ndarray, own: dict[int, list[int]]) -> Tokens:
    parts, sizes = [], np.diff(offsets)
    before = 0
    for row, found in sorted(own.items()):
        parts += [ids[offsets[before] : offsets[row]], np.array(found, ids.dtype)]
        sizes[row], before = len(found), row + 1
    parts.append(ids[offsets[before] :])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def _lanes(ea: np.ndarray, a_off: np.ndarray, eb: np.ndarray, b_off: np.ndarray, lane: int) -> tuple[np.ndarray, ...]:
    """Starts on both sides and the first side's ends of the lanes: whole texts, or parts of long ones between common ends."""
    sizes = np.diff(a_off)
    short = (sizes > 0) & (sizes <= lane)
    i, j, stop = [a_off[:-1][short]], [b_off[:-1][short]], [a_off[1:][short]]
    for row in np.flatnonzero(sizes > lane).tolist():
        low, high, other = a_off[row], a_off[row + 1], eb[b_off[row] : b_off[row + 1]]
        # near each multiple of the lane's length, the first end that the other side has too
        near = np.minimum(np.arange(low + lane, high, lane)[:, None] + np.arange(32), high - 1)
        place = np.searchsorted(other, ea[near])
        both = other[place] == ea[near]
        first, some = both.argmax(axis=1), both.any(axis=1)
        at = np.arange(len(near))[some]
        cut_a, cut_b = near[at, first[some]] + 1, place[at, first[some]] + b_off[row] + 1
        cut_a, own = np.unique(cut_a, return_index=True)
        inside = cut_a < high
        i.append(np.append(low, cut_a[inside]))
        j.append(np.append(b_off[row], cut_b[own][inside]))
        stop.append(np.append(cut_a[inside], high))
    return np.concatenate(i), np.concatenate(j), np.concatenate(stop)


def lockstep(ea: np.ndarray, a_off: np.ndarray, eb: np.ndarray, b_off: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` of the tokens that end together, in order, for the ends of all texts in a row.

    A text's tokens are not empty and cover the same bytes on both sides, so both pointers run out together.
    """
    i, j, stop = _lanes(ea, a_off, eb, b_off, lane)
    link = np.full(len(ea), -1, np.int64)
    while len(i):
        ahead = ea[i] - eb[j]
        same = ahead == 0
        link[i[same]] = j[same]
        i = i + (ahead <= 0)
        j = j + (ahead >= 0)
        running = i < stop
        if not running.all():
            i, j, stop = i[running], j[running], stop[running]
    at = np.flatnonzero(link >= 0)
    return at, link[at]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes ``a_id * len(b) + b_id`` of the pairs of which one's bytes end with the other's."""
    of_a: dict[bytes, list[int]] = {}
    of_b: dict[bytes, list[int]] = {}
    for tokens, table in ((a, of_a), (b, of_b)):
        for n, token in enumerate(tokens):
            if token:
                table.setdefault(token, []).append(n)
    found = set()
    for longer, other, swap in ((of_a, of_b, False), (of_b, of_a, True)):
        for token, own in longer.items():
            for k in range(len(token)):
                for m in other.get(token[k:], ()):
                    found.update(m * len(b) + n if swap else n * len(b) + m for n in own)
    return np.sort(np.fromiter(found, np.int64, len(found)))


class Aligner:
    """Aligned batches of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.tokens = TwoTokenizers(a_path, b_path)
        a, b = self.tokens.a, self.tokens.b
        self.a_size, self.b_size = (np.array([len(t) for t in tokens], np.int64) for tokens in (a, b))
        self.pairs = possible_pairs(a, b)
        # every id with the sign that follows it: inside a group, and at its end
        self.signs = [f"{n}{s}" for side, ends in ((a, ",|"), (b, ",;")) for s in ends for n in range(len(side))]

    def align(self, texts: list[str | None]) -> tuple:
        """Per text: token counts, groups, the number of its links, and their pair numbers in a row."""
        (a, a_off), (b, b_off) = self.tokens.ids(texts)
        ea, eb = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        i, j = lockstep(ea, a_off, eb, b_off)
        links = np.searchsorted(i, a_off)
        pair = np.searchsorted(self.pairs, a[i].astype(np.int64) * len(self.b_size) + b[j]).astype(np.int32)
        # each token's place among all of both sides, group by group
        a_group, b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_ends, b_ends = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_ends[i] = b_ends[j] = True
        a_group[1:], b_group[1:] = np.cumsum(a_ends)[:-1], np.cumsum(b_ends)[:-1]
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.append(0, j + 1)[a_group]] = a + len(self.a_size) * a_ends
        row[np.arange(len(b)) + np.append(i + 1, 0)[b_group]] = 2 * len(self.a_size) + b + len(self.b_size) * b_ends
        sign, at = self.signs, (a_off + b_off).tolist()
        codes = row.tolist()
        groups = ["".join([sign[c] for c in codes[s:e]])[:-1] for s, e in zip(at[:-1], at[1:])]
        return np.diff(a_off), np.diff(b_off), groups, links, pair


def worker_aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker."""
    kept = sys.__dict__.setdefault("_catalogkit_aligners", {})
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Aligner(a_path, b_path)
    return kept[a_path, b_path]


def _aligned(a_path: str, b_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_path, b_path)
        for batch in batches:
            for row, end, _, _ in chunks(batch["text"]):
                n_a, n_b, groups, links, pair = aligner.align(batch["text"][row:end].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"][row:end], pa.array(n_a), pa.array(n_b), pa.array(np.diff(links)),
                        pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(links.astype(np.int32)), pa.array(pair)),
                    ],
                    ["key", "n_a", "n_b", "n_links", "groups", "links"],
                )

    return run


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_links, groups, links`` of each document.

    Both sides encode a space and the text, special tokens' names as plain text. ``groups`` reads
    ``a1,a2|b1;a3|b2,b3``: the ids between two common ends, in order. ``links`` holds for each common end the number of
    its id pair in ``possible_pairs``. Null and empty texts, and texts that either side's tokens do not give back byte for
    byte, have no tokens: zeros and empty values. Long texts are handled whole, in memory of some forty times
    their length. Every row gives one row, so repeated rows and null keys stay; an empty table gives none. Only ``key`` and
    ``text`` are read, whatever other columns are named.
    """
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(
        _aligned(a_path, b_path), f"key {kind}, n_a long, n_b long, n_links long, groups string, links array<int>"
    )
    return out.withColumnRenamed("key", key)


def _sums(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(batch["links"].flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    return run


def count_links(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each possible pair is linked in all documents: partial counts per task, then one sum per pair.

    The driver gets ``n_pairs`` rows at most, which the vocabularies bound.
    """
    partial = aligned.select("links").mapInArrow(_sums(n_pairs), "pair int, n long")
    table = partial.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out


def _rated(shared) -> Callable:
    def run(links: pa.Array) -> pa.Array:
        counts, best = shared.value
        flat, offsets = links.flatten().to_numpy(), np.append(0, np.cumsum(links.value_lengths().fill_null(0).to_numpy()))
        sums = [np.append(0, np.cumsum(table[flat], dtype=np.int64)) for table in (best, counts)]
        return pa.StructArray.from_arrays([pa.array(s[offsets[1:]] - s[offsets[:-1]]) for s in sums], ["n_best", "count_sum"])

    return run


def rate_links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document (see ``align``).

    An id pair's count is how many links of all documents hold it. ``n_best`` is the number of a document's links whose
    count no other pair of the same second-side id exceeds, ``count_sum`` the sum of the counts over its links. The alignment is
    stored once, with links as pair numbers; counts of all possible pairs, some hundred thousand, are broadcast.
    ``groups_sha256`` is empty where there are no tokens.
    """
    spark = docs.sparkSession
    path = new_work_path(spark, "aligned")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = align(docs, a_path, b_path, key, text)
    found.select(F.col(key).alias("key"), "n_a", "n_b", "n_links", digest.alias("groups_sha256"), "links").write.parquet(path)
    stored = spark.read.parquet(path)
    aligner = worker_aligner(a_path, b_path)
    counts = count_links(stored, len(aligner.pairs))
    second = aligner.pairs % len(aligner.b_size)
    highest = np.zeros(len(aligner.b_size), np.int64)
    np.maximum.at(highest, second, counts)
    shared = spark.sparkContext.broadcast((counts, counts == highest[second]))
    rated = F.arrow_udf(_rated(shared), "n_best long, count_sum long")(F.col("links"))
    return stored.withColumn("rated", rated).select(
        F.col("key").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "rated.n_best",
        "rated.count_sum", "groups_sha256",
    )
