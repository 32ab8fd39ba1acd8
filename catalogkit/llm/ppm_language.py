"""Language identification by prediction with partial matching over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes. A byte costs its share of the context
it follows; a byte not seen there costs an escape to the context one byte shorter, down to equal shares of all
256 bytes. The statistics are frozen after fitting, so every cost is a number looked up: tables by
byte string hold the costs for all languages side by side, and a text is scored by array lookups alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from catalogkit.llm.sampling import bounded_sample
from catalogkit.llm.textbytes import chunks
from catalogkit.llm.tokens import drop_worker_tokens

ORDER = 4
#: The fit reads at most so many rows and characters of whole texts per language.
FIT_ROWS, FIT_CHARS = 2000, 4_000_000
#: And about so many characters for all languages together, which bounds the model however many languages there are.
FIT_TOTAL_CHARS = 16_000_000
#: So many languages share a table of costs; strings of one group take no room in the others.
GROUP = 4
UNKNOWN = "und"

Model = dict  # languages, order, and per group of languages and order ``k``: keys, costs, contexts, escapes


def _padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``order`` zero bytes before each text, which texts these are of, and where texts' bytes stand."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) + (doc + 1) * order
    out = np.zeros(len(data) + order * len(sizes), np.uint64)
    out[at] = data
    return out, doc, at


def _gram(padded: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each place, as one integer."""
    gram = padded[at].copy()
    for back in range(1, size):
        gram |= padded[at - back] << np.uint64(8 * back)
    return gram


def count_grams(order: int):
    """Task function: rows of language and text to counts of byte strings of up to ``order + 1`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tokens()
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for low, end, data, offsets in chunks(batch["text"]):
                padded, doc, at = _padded(data, offsets, order)
                own = langs[low:end][doc]
                for lang in sorted(set(langs[low:end])):
                    mine = at[own == lang]
                    for size in range(1, order + 2):
                        grams, counts = np.unique(_gram(padded, mine, size), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(grams)),
                                pa.array([size] * len(grams), pa.int32()),
                                pa.array(grams.view(np.int64)),
                                pa.array(counts),
                            ],
                            ["lang", "size", "gram", "n"],
                        )

    return run


def _costs(counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, order: int) -> dict:
    """Cost tables in bits of ``width`` languages from ``size -> (language numbers, grams, counts)``."""
    model: dict = {"keys": [], "costs": [], "contexts": [], "escapes": []}
    below = np.full((256, width), 8.0)  # equal shares
    below_keys = np.arange(256, dtype=np.uint64)
    for size in range(1, order + 2):
        which, grams, n = counts[size]
        keys, row = np.unique(grams, return_inverse=True)
        table = np.zeros((len(keys), width))
        table[row, which] = n
        mask = np.uint64((1 << 8 * (size - 1)) - 1)
        contexts, ctx = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.zeros((len(contexts), width))
        np.add.at(total, ctx, table)
        kinds = np.zeros((len(contexts), width))
        np.add.at(kinds, ctx, table > 0)
        # escapes count as often as there are different bytes; an unseen context passes on at no cost
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            own = np.log2((total + kinds)[ctx] / table)
        shorter = below[np.searchsorted(below_keys, keys & mask)] if size > 1 else below[keys.astype(np.int64)]
        costs = np.where(table > 0, own, escapes[ctx] + shorter)
        model["keys"].append(keys)
        model["costs"].append(costs.astype(np.float32))
        model["contexts"].append(contexts)
        model["escapes"].append(escapes.astype(np.float32))
        below, below_keys = costs, keys
    return model


def fit_languages(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
    rows: int = FIT_ROWS, chars: int = FIT_CHARS, total_chars: int = FIT_TOTAL_CHARS, group: int = GROUP,
) -> Model:
    """Frozen statistics from a bounded sample of whole labelled texts.

    Rows with a null text or language teach nothing. The sample has at most ``chars`` characters per language and about ``total_chars``
    in all, so neither the table nor the number of languages makes the model larger. Languages are held ``group`` at a time; their
    costs do not depend on the others in the group.
    """
    if order > 7:
        raise ValueError("contexts of up to seven bytes fit a 64-bit key")
    rows_ = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows_ = rows_.filter("text is not null and lang is not null")
    sample = bounded_sample(rows_, "key", "text", "lang", rows, chars, None, total_chars)
    counted = sample.select("lang", "text").mapInArrow(count_grams(order), "lang string, size int, gram long, n long")
    table = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = table["lang"].unique().sort().to_pylist() if len(table) else []
    number = pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy()
    sizes, n = table["size"].to_numpy(), table["n"].to_numpy()
    grams = table["gram"].to_numpy().view(np.uint64)
    groups = []
    for low in range(0, len(langs), group):
        mine = (number >= low) & (number < low + group)
        counts = {}
        for size in range(1, order + 2):
            at = mine & (sizes == size)
            counts[size] = ((number[at] - low).astype(np.int64), grams[at], n[at])
        groups.append(_costs(counts, min(group, len(langs) - low), order))
    return {"langs": langs, "order": order, "groups": groups}


class Scorer:
    """Code lengths of texts under every language of a model."""

    def __init__(self, model: Model):
        self.langs, self.order = model["langs"], model["order"]
        self.groups = [
            ([_slots(k) for k in g["keys"]], g["costs"], [_slots(k) for k in g["contexts"]], g["escapes"]) for g in model["groups"]
        ]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts by languages."""
        padded, doc, at = _padded(data, offsets, self.order)
        return np.concatenate([self._group_bits(g, padded, doc, at, len(offsets) - 1) for g in self.groups], axis=1)

    def _group_bits(self, group: tuple, padded: np.ndarray, doc: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
        tables, costs, contexts, escapes = group
        width = costs[0].shape[1]
        out = np.zeros((texts, width))
        for low in range(0, len(at), 1 << 16):
            own, places = doc[low : low + (1 << 16)], at[low : low + (1 << 16)]
            cost = np.zeros((len(places), width), np.float32)
            left = np.arange(len(places))
            for k in range(self.order, -1, -1):
                gram = _gram(padded, places[left], k + 1)
                row = _lookup(tables[k], gram)
                hit = row >= 0
                cost[left[hit]] += costs[k][row[hit]]
                left, gram = left[~hit], gram[~hit]
                if not len(left):
                    break
                if k:
                    ctx = _lookup(contexts[k], gram >> np.uint64(8))
                    cost[left[ctx >= 0]] += escapes[k][ctx[ctx >= 0]]
                else:  # a byte never seen in fitting
                    cost[left] += escapes[0][0] + np.float32(8)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        return out


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open-addressed table of ``keys``: slot keys, rows (-1 where free), and the shift to a slot."""
    size = max(16, 1 << int(2 * len(keys) + 1).bit_length())
    shift = 64 - (size.bit_length() - 1)
    held, rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    left = np.arange(len(keys))
    slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64)
    while len(left):
        free = rows[slot] < 0
        rows[slot[free]] = left[free]  # of several for one slot, the last stays
        held[slot[free]] = keys[left[free]]
        stay = rows[slot] != left
        left, slot = left[stay], (slot[stay] + 1) & (size - 1)
    held[rows >= 0] = keys[rows[rows >= 0]]
    return held, rows, shift


def _lookup(table: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """Row of each key, or -1."""
    held, rows, shift = table
    slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64)
    found = rows[slot]
    left = np.flatnonzero((found >= 0) & (held[slot] != keys))
    slot = slot[left]
    while len(left):
        slot = (slot + 1) & (len(held) - 1)
        found[left] = rows[slot]
        wrong = (rows[slot] >= 0) & (held[slot] != keys[left])
        left, slot = left[wrong], slot[wrong]
    return found


def languages(docs: DataFrame, model: Model, text: str = "text") -> tuple[F.Column, F.Column, F.Column]:
    """Columns ``lang_pred``, ``score`` and ``bits`` for ``docs``.

    The language with the shortest code is predicted, the first in order if two are equal; the score is its
    share of probability among the languages. ``bits`` is that code's length per byte. Null texts and texts
    without a letter are ``und`` with score 0 and null bits, and so is all text if nothing was fitted.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_worker_tokens()
        scorer = Scorer(held.value)
        for column in columns:
            names, scores, bits = [], [], []
            for low, end, data, offsets in chunks(column):
                if not scorer.langs:
                    names += [UNKNOWN] * (end - low)
                    scores.append(np.zeros(end - low))
                    bits.append(np.full(end - low, np.nan))
                    continue
                cost = scorer.bits(data, offsets)
                best = cost.argmin(axis=1)
                least = cost.min(axis=1)
                names += [scorer.langs[b] for b in best]
                scores.append(1 / np.exp2(least[:, None] - cost).sum(axis=1))
                bits.append(least / np.maximum(np.diff(offsets), 1))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                    pa.array(np.concatenate(bits) if bits else [], pa.float64()),
                ],
                ["lang", "score", "bits"],
            )

    # the annotation of a function defined here is not resolved by Spark, so the kind is told by the hints above
    found = F.arrow_udf(score, "lang string, score double, bits double")(F.col(text))
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        F.when(known, found["lang"]).otherwise(UNKNOWN),
        F.when(known, found["score"]).otherwise(0.0),
        F.when(known & (found["lang"] != UNKNOWN), found["bits"]),
    )


def predict_languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, bits_per_byte`` for each row; see ``languages``. Only two columns are read.

    Null texts and texts without a letter are ``und``. Long texts are scored whole, in memory that follows the longest. Repeated rows are
    scored alike; other columns may have any names; an empty table gives no rows.
    """
    lang, score, bits = languages(docs, model, text)
    return docs.select(F.col(key), lang.alias("lang_pred"), score.alias("score"), bits.alias("bits_per_byte"))


def keep_known_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` whose text some fitted language explains, with all columns.

    Rejected are ``und`` texts and those that the best language codes in no fewer bits than their plain bytes have.
    """
    _, _, bits = languages(docs, model, text)
    return docs.filter(F.coalesce(bits < 8, F.lit(False)))
