"""Token hashing, vectors and relevance scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from catalogkit.functions.text import Col, _c

# 32-bit FNV-1a start value and prime.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
_MASK32 = 0xFFFFFFFF

DEFAULT_DIMENSIONS = 512


def fnv1a32(token: Col) -> Column:
    """Unsigned 32-bit FNV-1a over the characters of a token."""
    token = _c(token)
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.aggregate(
        chars,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_MASK32)),
    )


def external_id(source: Col, text: Col) -> Column:
    """SHA-256 of ``source:text``."""
    return F.sha2(F.concat(_c(source), F.lit(":"), _c(text)), 256)


def _hash_tokens(tokens: pa.Array) -> np.ndarray:
    """FNV-1a of each string, one vectorised step per character position.

    The 16-bit encoding makes positions agree with character codes beyond ASCII.
    """
    encoded = [t.encode("utf-16-le") for t in tokens.to_pylist()]
    lengths = np.array([len(e) // 2 for e in encoded], dtype=np.int64)
    units = np.frombuffer(b"".join(encoded), dtype="<u2").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(encoded) else lengths
    hashes = np.full(len(encoded), FNV_OFFSET, dtype=np.uint64)
    for position in range(int(lengths.max()) if len(encoded) else 0):
        live = np.nonzero(lengths > position)[0]
        mixed = hashes[live] ^ units[starts[live] + position]
        hashes[live] = (mixed * np.uint64(FNV_PRIME)) & np.uint64(_MASK32)
    return hashes


def _slot_weights(column: pa.ListArray, dims: int, signed: bool):
    """(row, slot, weight) of every non-empty slot in a batch of token lists, plus the row count."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    row_of = np.repeat(np.arange(rows), counts)
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
    row_of, codes = row_of[codes >= 0], codes[codes >= 0]
    hashes = _hash_tokens(coded.dictionary)
    distinct = max(len(hashes), 1)
    if signed:
        pairs, seen = np.unique(row_of * distinct + codes, return_counts=True)
        row, token = pairs // distinct, pairs % distinct
        value = np.where(hashes[token] & np.uint64(1), -1.0, 1.0) * (1.0 + np.log(seen))
        slot = (hashes % np.uint64(dims)).astype(np.int64)[token]
    else:
        row, value = row_of, np.ones(len(row_of))
        signed32 = hashes.astype(np.uint32).view(np.int32).astype(np.int64)
        slot = (np.abs(signed32) % dims)[codes]
    keys, inverse = np.unique(row * dims + slot, return_inverse=True)
    weight = np.bincount(inverse, weights=value, minlength=len(keys))
    row, slot = keys // dims, keys % dims
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=rows))
    scale = np.where(norm[row] == 0, 1.0, norm[row])
    return rows, row, slot, weight / scale


#: Tokens that are hashed at a time: an Arrow batch of long texts is worked through in slices of rows.
_SLICE_TOKENS = 1 << 18


def token_slices(column: pa.ListArray) -> Iterator[pa.ListArray]:
    """Runs of rows of about ``_SLICE_TOKENS`` tokens, one row at least."""
    ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0)).astype(np.int64))
    low = 0
    while low < len(column):
        before = ends[low - 1] if low else 0
        end = max(int(np.searchsorted(ends, before + _SLICE_TOKENS, "right")), low + 1)
        yield column.slice(low, end - low)
        low = end


def _dense_udf(dims: int, signed: bool, digits: int):
    @F.arrow_udf("array<double>")
    def dense(tokens: pa.Array) -> pa.Array:
        rows, low = len(tokens), 0
        grid = np.zeros(rows * dims)
        for part in token_slices(tokens):
            count, row, slot, weight = _slot_weights(part, dims, signed)
            grid[(low + row) * dims + slot] = np.round(weight, digits)
            low += count
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dims, pa.int32()), pa.array(grid))

    return dense


def _sparse_udf(dims: int, signed: bool, digits: int):
    @F.arrow_udf("array<struct<slot:int,weight:double>>")
    def sparse(tokens: pa.Array) -> pa.Array:
        rows, found = len(tokens), []
        for part in token_slices(tokens):
            count, row, slot, weight = _slot_weights(part, dims, signed)
            weight = np.round(weight, digits)
            kept = weight != 0
            low = found[-1][0] if found else 0
            found.append((low + count, low + row[kept], slot[kept].astype(np.int32), weight[kept]))
        row, slot, weight = (np.concatenate([part[n] for part in found]) if found else np.empty(0, np.int64) for n in (1, 2, 3))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
        cells = pa.StructArray.from_arrays([pa.array(slot, pa.int32()), pa.array(weight)], ["slot", "weight"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    return sparse


def hash_vector(tokens: Col, dims: int = DEFAULT_DIMENSIONS, sparse: bool = False) -> Column:
    """Signed feature hashing with weight 1+ln(count), unit length, 12 decimals.

    Works inside the row's own task, one Arrow batch at a time, so no token is shuffled.
    ``sparse`` returns only the non-zero slots.
    """
    return (_sparse_udf if sparse else _dense_udf)(dims, True, 12)(_c(tokens))


def hash_vector_unsigned(tokens: Col, dims: int = DEFAULT_DIMENSIONS, sparse: bool = False) -> Column:
    """Plain counting at the absolute signed hash, unit length, 8 decimals."""
    return (_sparse_udf if sparse else _dense_udf)(dims, False, 8)(_c(tokens))


def cosine_similarity(left: Col, right: Col) -> Column:
    """Cosine of two vectors; null when either has no length."""
    def dot(a, b):
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    left, right = _c(left), _c(right)
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def token_overlap(tokens: Col, query_tokens: Col) -> Column:
    """How many token occurrences are query tokens; repeats count. The time is in proportion to both lists."""

    @F.arrow_udf("int")
    def count(lists: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for own, query in zip(lists, asked):
            if not own.is_valid:
                out.append(None)
            else:
                known = query.values.drop_null() if query.is_valid else pa.array([], own.values.type)
                out.append(pc.sum(pc.is_in(own.values, value_set=known), min_count=0).as_py())
        return pa.array(out, pa.int32())

    return count(_c(tokens), _c(query_tokens))


def ranking_score(similarity: Col, overlap: Col, exact: Col) -> Column:
    """Ten times the similarity plus overlap plus one for an exact code, three decimals."""
    total = (
        F.coalesce(_c(similarity), F.lit(0.0)) * 10
        + F.coalesce(_c(overlap), F.lit(0))
        + F.coalesce(_c(exact).cast("int"), F.lit(0))
    )
    return F.round(total, 3)
