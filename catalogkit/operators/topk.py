"""Exact scored top-k of a whole corpus for a batch of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.operators.blocks import block_pairs
from catalogkit.operators.dedupe import top_per_key

_CELLS = 2_000_000
#: Cells that are scored one by one at a time.
_DOTS = 1 << 14
#: Rows that the first bound of a tile is taken from, at least.
_FIRST = 256
MERGE_SALTS = 32
#: Rows of a block of queries and of the corpus: with 512 numbers a vector, 4 MB each.
QUERY_ROWS, CORPUS_ROWS = 1024, 1024
#: Vectors meet in tiles of many blocks, of so many numbers a side (16 MB), so that a row is sent to few of them. Smaller tables are cut
#: into more tiles, for the cores, but not below ``TILE_ROWS`` rows.
TILE_NUMBERS, TILE_ROWS = 1 << 21, 512
QUERY_TILES, CORPUS_TILES = 16, 8


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Unit-length rows; a missing or wrongly sized vector becomes a zero row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten().cast(pa.float64()))
    good = lengths == dims
    grid = np.zeros((len(column), dims))
    grid[good] = flat[np.repeat(good, lengths)].reshape(-1, dims)
    norm = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    return grid / np.where(norm == 0, 1.0, norm)


class _Overlap:
    """Counts, per (row, query), the row's token occurrences that are tokens of the query."""

    def __init__(self, query_tokens: list):
        self.queries = len(query_tokens)
        sets = [sorted(set(t)) if t is not None else [] for t in query_tokens]
        flat = [t for s in sets for t in s]
        codes, words = pd.factorize(pd.Series(flat, dtype=object))
        owner = np.repeat(np.arange(self.queries), [len(s) for s in sets])
        order = np.argsort(codes, kind="stable")
        self.owner = owner[order]
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words)))]).astype(np.int64)
        self.words = pa.array(list(words), pa.string())

    def count(self, tokens: pa.ListArray) -> np.ndarray:
        rows = len(tokens)
        row = np.repeat(np.arange(rows), np.asarray(tokens.value_lengths().fill_null(0)))
        word = np.asarray(pc.index_in(tokens.flatten(), value_set=self.words).fill_null(-1))
        row, word = row[word >= 0], word[word >= 0]
        length = self.begins[word + 1] - self.begins[word]
        total = int(length.sum())
        shift = np.repeat(self.begins[word] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        owner = self.owner[(shift + np.arange(total)).astype(np.int64)] if total else np.empty(0, np.int64)
        cell = np.repeat(row, length) * self.queries + owner
        return np.bincount(cell, minlength=rows * self.queries).reshape(rows, self.queries)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """First ``k`` rows per query in rank order."""
    ordered = rows.sort_values(
        ["_q", "exact", "_lead", "similarity", "_tail", "recency", "doc_id"],
        ascending=[True, False, False, False, False, False, True],
        kind="stable",
    )
    return ordered[ordered.groupby("_q").cumcount() < k]


def _score_blocks(k: int, min_score: float | None, digits: int, lexical: bool):
    """Function of a block of queries and a block of the corpus to the block's best rows per query."""

    def best(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        count = queries.num_rows
        if not count or not corpus.num_rows:
            return _result_schema(queries.schema.field("query_id").type, corpus.schema.field("doc_id").type).empty_table()
        dims = int(np.asarray(queries["query_vector"].combine_chunks().value_lengths().fill_null(0)).max())
        vectors = _matrix(queries["query_vector"], dims).T
        overlap = _Overlap(queries["query_tokens"].to_pylist()) if lexical else None
        short = np.asarray(queries["is_short"].fill_null(False)) if lexical else np.zeros(count, bool)
        eans = queries["query_ean"].to_pandas() if lexical else None
        ean_owner = eans.dropna().groupby(eans).groups if lexical else {}
        kept, floor_lead, floor_sim = None, np.full(count, -1.0), np.full(count, -np.inf)
        step = max(1, _CELLS // count)
        for low in range(0, corpus.num_rows, step):
            batch = corpus.slice(low, step)
            sim = np.round(_matrix(batch["vector"], dims) @ vectors, digits) + 0.0
            shape = sim.shape
            hits = overlap.count(batch["tokens"].combine_chunks()) if lexical else np.zeros(shape, np.int64)
            exact = np.zeros(shape, np.int64)
            if len(ean_owner):
                known = pa.array(list(ean_owner), pa.string())
                found = np.asarray(pc.index_in(batch["ean"], value_set=known).combine_chunks().fill_null(-1))
                for r in np.flatnonzero(found >= 0):
                    exact[r, ean_owner[known[int(found[r])].as_py()]] = 1
            lead = np.where(short, hits, 0)
            ahead = exact * float(1 << 40) + lead
            live = (ahead > floor_lead) | ((ahead == floor_lead) & (sim >= floor_sim))
            if min_score is not None:
                live &= (sim >= min_score) | (short & (hits > 0))
            row, query = np.nonzero(live)
            if not len(row):
                continue
            found = pd.DataFrame(
                {
                    "_q": query,
                    "doc_id": batch["doc_id"].to_numpy()[row],
                    "recency": batch["recency"].to_numpy()[row],
                    "similarity": sim[row, query],
                    "overlap": hits[row, query],
                    "exact": exact[row, query],
                    "_lead": lead[row, query],
                    "_tail": np.where(short[query], 0, hits[row, query]),
                }
            )
            kept = _best(found if kept is None else pd.concat([kept, found]), k)
            # a query with k rows already needs nothing below its last one
            sizes = kept.groupby("_q").size()
            last = kept.groupby("_q").last()
            full = sizes.index[sizes.to_numpy() >= k].to_numpy()
            if len(full):
                tail = last.loc[full]
                floor_lead[full] = tail["exact"].to_numpy() * float(1 << 40) + tail["_lead"].to_numpy()
                floor_sim[full] = tail["similarity"].to_numpy()
        schema = _result_schema(queries.schema.field("query_id").type, corpus.schema.field("doc_id").type)
        if kept is None:
            return schema.empty_table()
        own = kept["_q"].to_numpy()
        columns = [queries["query_id"].take(pa.array(own)), pa.array(short[own])]
        columns += [pa.array(kept[c], schema.field(c).type) for c in schema.names[2:]]
        return pa.Table.from_arrays(columns, schema=schema)

    return best


class _BestOf:
    """The best ``k`` rows of each query so far, by similarity and then by place; candidates are gathered and sorted now and then."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        #: similarity of each query's ``k``-th row: only rows above it can enter, as rows come by place
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, sim: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((query, sim, place))
        self.waiting += len(query)
        if self.waiting > 2 * self.queries * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, sim, place = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        order = np.lexsort((place, -sim, query))
        query, sim, place = query[order], sim[order], place[order]
        begins = np.searchsorted(query, np.arange(self.queries))
        nth = np.arange(len(query)) - begins[query]
        last = nth == self.k - 1
        self.floor[query[last]] = sim[last]
        kept = nth < self.k
        self.parts, self.waiting = [(query[kept], sim[kept], place[kept])], 0
        return self.parts[0]


def _score_vectors(k: int, min_score: float | None, digits: int, query_rows: int, corpus_rows: int):
    """Function of a tile of queries and a tile of the corpus to the tile's best rows per query, by vectors alone.

    Blocks are scored with short numbers first. Only cells that may be among the best, by a bound of the error, are scored in full, so the result is
    that of full numbers. Where most cells may (copies of one vector), the block is scored in full at once.
    """

    def best(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        schema = _result_schema(queries.schema.field("query_id").type, corpus.schema.field("doc_id").type)
        if not queries.num_rows or not corpus.num_rows:
            return schema.empty_table()
        # rows in the order that decides ties
        corpus = corpus.take(pc.sort_indices(corpus["doc_id"]))
        dims = int(np.asarray(queries["query_vector"].combine_chunks().value_lengths().fill_null(0)).max())
        every, rows = _matrix(queries["query_vector"], dims), _matrix(corpus["vector"], dims)
        plain = not (np.isnan(every).any() or np.isnan(rows).any())
        short_rows = rows.astype(np.float32)
        # of sums of products of unit vectors in short numbers, and of rounding; twice what it can be
        error = (dims + 8) * 2.0**-23 + 10.0**-digits
        found = []
        for low in range(0, len(every), query_rows):
            own = every[low : low + query_rows]
            short_own, bests = own.astype(np.float32), _BestOf(len(own), k)
            for at in range(0, len(rows), corpus_rows):
                block = rows[at : at + corpus_rows]
                cells = len(own) * len(block)
                few = None
                if plain:
                    near = short_own @ short_rows[at : at + corpus_rows].T
                    # what k rows of this very block reach bounds the first block, where nothing is known yet
                    some = min(len(block), max(_FIRST, 4 * k))
                    if not bests.parts and some > k:
                        reach = np.partition(near[:, :some], some - k, axis=1)[:, some - k] - 2 * error
                    else:
                        reach = bests.floor - error
                    least = reach if min_score is None else np.maximum(reach, min_score - error)
                    may = np.flatnonzero(near >= least.astype(np.float32)[:, None])
                    few = may if len(may) * 8 <= cells else None
                if few is not None:
                    query, place = np.divmod(few, len(block))
                    sim = np.empty(len(few))
                    for n in range(0, len(few), _DOTS):
                        part = slice(n, n + _DOTS)
                        sim[part] = np.einsum("ij,ij->i", own[query[part]], block[place[part]])
                    sim = np.round(sim, digits) + 0.0
                else:
                    bests.cut()
                    whole = np.round(own @ block.T, digits) + 0.0
                    query, place = np.nonzero(~(whole <= bests.floor[:, None]))
                    sim = whole[query, place]
                kept = ~(sim <= bests.floor[query])
                if min_score is not None:
                    kept &= sim >= min_score
                if kept.any():
                    bests.add(query[kept], sim[kept], place[kept] + at)
            query, sim, place = bests.cut()
            found.append((query + low, sim, place))
        query, sim, place = (np.concatenate(c) for c in zip(*found))
        none = np.zeros(len(query), np.int64)
        columns = [queries["query_id"].take(pa.array(query)), pa.array(none.astype(bool)), corpus["doc_id"].take(pa.array(place))]
        columns += [pa.array(none.astype(np.float64)), pa.array(sim), pa.array(none), pa.array(none)]
        return pa.Table.from_arrays(columns, schema=schema)

    return best


def _tiles(df: DataFrame, vector: str, rows: int) -> Column:
    """How many tiles a table of vectors is cut into: by its numbers, and more where it is small, for blocks of up to ``rows`` rows."""
    count, numbers = df.agg(F.count("*")).scalar(), df.agg(F.sum(F.greatest(F.size(vector), F.lit(0)))).scalar()
    by_size = F.ceil(F.coalesce(numbers, F.lit(0)) / TILE_NUMBERS)
    return F.greatest(by_size, F.least(F.ceil(count / TILE_ROWS), F.lit(rows)), F.lit(1)).cast("int")


def _result_schema(query_type: pa.DataType, doc_type: pa.DataType) -> pa.Schema:
    names = [("query_id", query_type), ("is_short", pa.bool_()), ("doc_id", doc_type), ("recency", pa.float64())]
    names += [("similarity", pa.float64()), ("overlap", pa.int64()), ("exact", pa.int64())]
    return pa.schema(names)


def scored_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    min_score: float | None = None,
    lexical: bool = True,
    digits: int = 9,
    query_rows: int = QUERY_ROWS,
    corpus_rows: int = CORPUS_ROWS,
) -> DataFrame:
    """Best ``k`` corpus rows per query: ``query_id, doc_id, similarity, overlap, exact, is_short, rank``.

    ``queries``: ``query_id, query_vector`` and, for ``lexical`` ranking, ``query_tokens, query_ean,
    is_short``. ``corpus``: ``doc_id, vector`` and for lexical ranking ``tokens, ean, recency`` (any
    ordered number; higher is newer). Order: exact code, then overlap for short queries, similarity,
    overlap for long queries, recency, lowest id. Similarities are compared after rounding to
    ``digits``, so that the order of summation does not decide ties.

    Blocks of ``query_rows`` queries meet blocks of ``corpus_rows`` rows; a pair of blocks sends on
    ``k`` rows per query. Without ``lexical``, blocks meet within tiles of ``TILE_NUMBERS`` numbers a side, and a pair of tiles sends
    on ``k`` rows per query. Nothing goes through the driver, whatever the number of queries.
    """
    width = ["doc_id", "vector"]
    if lexical:
        source = corpus.select(*width, "tokens", "ean", F.col("recency").cast("double"))
        asked = queries.select("query_id", "query_vector", "query_tokens", "query_ean", "is_short")
    else:
        source = corpus.select(*width, F.lit(0.0).alias("recency"))
        asked = queries.select("query_id", "query_vector")
    id_type = queries.schema["query_id"].dataType.simpleString()
    doc_type = corpus.schema["doc_id"].dataType.simpleString()
    schema = (
        f"query_id {id_type}, is_short boolean, doc_id {doc_type}, recency double, similarity double, overlap bigint, "
        "exact bigint"
    )
    order = rank_order()
    if not lexical:
        tiles = _tiles(asked, "query_vector", QUERY_TILES), _tiles(source, "vector", CORPUS_TILES)
        pairs = block_pairs(asked, source, "query_id", "doc_id", query_rows, corpus_rows, counts=tiles)
        best = pairs.applyInArrow(_score_vectors(k, min_score, digits, query_rows, corpus_rows), schema)
        # a query has k rows of each tile, which are few
        return top_per_key(best, ["query_id"], order, k, "rank").drop("recency")
    pairs = block_pairs(asked, source, "query_id", "doc_id", query_rows, corpus_rows)
    best = pairs.applyInArrow(_score_blocks(k, min_score, digits, lexical), schema)
    # every pair of blocks sent k rows per query: thin them in salted groups before one task ranks a query
    salted = best.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
    thinned = top_per_key(salted, ["query_id", "_salt"], order, k)
    return top_per_key(thinned, ["query_id"], order, k, "rank").drop("_salt", "recency")


def rank_order(overlap: str = "overlap", similarity: str = "similarity", exact: str = "exact",
               short: str = "is_short", recency: str = "recency", doc: str = "doc_id") -> list:
    """Search order as sort columns."""
    lead = F.when(F.col(short), F.col(overlap)).otherwise(0)
    tail = F.when(F.col(short), 0).otherwise(F.col(overlap))
    return [F.desc(exact), lead.desc(), F.desc(similarity), tail.desc(), F.desc(recency), F.asc(doc)]


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int, min_score: float | None = None, digits: int = 9,
    query_rows: int = QUERY_ROWS, corpus_rows: int = CORPUS_ROWS,
) -> DataFrame:
    """Exact cosine top-k: ``query_id, doc_id, similarity, rank``."""
    found = scored_topk(queries, corpus, k, min_score, lexical=False, digits=digits, query_rows=query_rows, corpus_rows=corpus_rows)
    return found.select("query_id", "doc_id", "similarity", "rank")
