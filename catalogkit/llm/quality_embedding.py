"""Document quality from supervised subword embeddings.

Words and the character n-grams inside them are hashed to vectors, a document is the mean of its vectors,
and a softmax over that mean tells the label. Vectors and softmax are learned together by
stochastic gradient descent. As mean and product commute, the learned vectors are multiplied with
the softmax weights once, and scoring a text is a mean of looked-up numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.llm.sampling import bounded_sample
from catalogkit.llm.textbytes import chunks, runs, span_hashes, word_table

BUCKET_BITS = 18
SIZES = (3, 4, 5)
LAGS = 4
DIMENSIONS, EPOCHS, RATE = 16, 8, 0.5
#: The fit reads at most so many rows and characters of whole texts per label.
FIT_ROWS, FIT_CHARS = 1500, 5_000_000
_STEP, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_END = 0  # bucket of the mark that ends every document, so that an empty text has a feature too

Features = tuple[np.ndarray, np.ndarray]  # buckets, and where each document's begin and end


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per character (its UTF-8 bytes), and the offsets counted in characters."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    values = data[lead].astype(np.uint64)
    follows = np.ones(len(lead), bool)
    for k in range(1, 4):
        at = np.minimum(lead + k, len(data) - 1)
        follows &= (lead + k < len(data)) & ((data[at] & 0xC0) == 0x80)
        values |= np.where(follows, data[at].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    return values, np.searchsorted(lead, offsets)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> Iterator[Features]:
    """Buckets of words, pairs of neighbours, repetitions, and each size of n-grams, document by document.

    Character n-grams may begin or end with the white space beside a word, but have none inside.
    """
    values, offsets = _characters(data, offsets)
    shift = np.uint64(64 - bits)
    blank = np.isin(values, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    values[blank] = 32
    starts, ends = runs(~blank, offsets)
    words, bounds = span_hashes(values, starts, ends), np.searchsorted(starts, offsets)
    yield (words >> shift).astype(np.int64), bounds
    first = np.repeat(bounds[:-1], np.diff(bounds))  # where each word's document begins
    for lag in range(1, 1 + LAGS):
        if len(words) <= lag:
            break
        at = np.arange(lag, len(words))
        at = at[at - lag >= first[lag:]]
        pair = words[at - lag] * _STEP + words[at]
        same = words[at - lag] == words[at]
        if lag > 1:  # beyond neighbours, only the word that comes again
            at, pair, same = at[same], pair[same], same[same]
        # a repeated word is written as its distance, so that all repetitions share a vector
        yield (np.where(same, np.uint64(lag), pair) * _SPREAD >> shift).astype(np.int64), np.searchsorted(at, bounds)
    blanks = np.zeros(len(values) + 1, np.int64)
    np.cumsum(blank, out=blanks[1:])
    last = np.repeat(offsets[1:], np.diff(offsets))  # where each character's document ends
    h = values.copy()
    for size in range(2, max(SIZES) + 1):
        n = len(values) - size + 1
        if n <= 0:
            break
        h = h[:n] * _STEP + values[size - 1 :]
        if size in SIZES:
            inner = blanks[size - 1 : size - 1 + n] - blanks[1 : n + 1]
            at = np.flatnonzero((inner == 0) & (np.arange(n) + size <= last[:n]))
            yield ((h[at] + np.uint64(size)) * _SPREAD >> shift).astype(np.int64), np.searchsorted(at, offsets)


def train(
    texts: list[str], labels: list[int], bits: int = BUCKET_BITS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
    rate: float = RATE, seed: int = 1,
) -> tuple[list[int], np.ndarray]:
    """Classes, and per bucket its weight for each class (vector times softmax weights)."""
    classes = sorted(set(labels))
    random = np.random.default_rng(seed)
    vectors = ((random.random((1 << bits, dimensions)) - 0.5) / dimensions).astype(np.float32)
    weights = np.zeros((len(classes), dimensions), np.float32)
    rows = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found = [b for b, _ in features(data, np.array([0, len(data)]), bits)] if len(data) else []
        buckets, counts = np.unique(np.concatenate([*found, [_END]]), return_counts=True)
        rows.append((buckets.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
    targets = np.eye(len(classes), dtype=np.float32)[[classes.index(x) for x in labels]] if texts else []
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for row in random.permutation(len(rows)):
            buckets, share = rows[row]
            own = vectors[buckets]
            mean = share @ own
            logits = weights @ mean
            odds = np.exp(logits - logits.max())
            slope = odds / odds.sum() - targets[row]
            now = np.float32(rate * (1 - done / steps))
            back = slope @ weights
            weights -= now * np.outer(slope, mean)
            # a bucket stands once in ``buckets``, so this adds up no lost updates
            vectors[buckets] = own - (now * share * len(share))[:, None] * back
            done += 1
    return classes, (vectors @ weights.T).astype(np.float32)


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = FIT_ROWS, chars: int = FIT_CHARS,
) -> tuple[list[int], np.ndarray]:
    """Train on a bounded sample of labelled documents, taken in hash order of the key per label.

    Null labels teach nothing; a null text teaches as an empty one. A document labelled twice with
    different labels may teach both.
    """
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    named = named.filter("label is not null and key is not null").distinct()
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = bounded_sample(texts, "key", "text", "label", rows, chars, named).collect()
    sample.sort(key=lambda r: (r["key"], r["label"], r["text"]))
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def quality_score(docs: DataFrame, model: tuple[list[int], np.ndarray], text: str = "text", positive: int = 1) -> Column:
    """Probability of the label ``positive`` for each text; null counts as the empty text.

    One half if nothing was learned, and 0 or 1 if only one label was.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, weights = held.value
        bits = int(len(weights)).bit_length() - 1
        for column in columns:
            out = []
            for low, end, data, offsets in chunks(column):
                if not classes:
                    out.append(np.full(end - low, 0.5))
                    continue
                total = np.repeat(weights[_END][None].astype(np.float64), end - low, axis=0)
                n = np.ones(end - low)
                for buckets, bounds in features(data, offsets, bits) if len(data) else ():
                    n += np.diff(bounds)
                    for k in range(len(classes)):
                        sums = np.zeros(len(buckets) + 1)
                        np.cumsum(weights[:, k][buckets], dtype=np.float64, out=sums[1:])
                        total[:, k] += sums[bounds[1:]] - sums[bounds[:-1]]
                logits = total / n[:, None]
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                share = odds / odds.sum(axis=1, keepdims=True)
                out.append(share[:, classes.index(positive)] if positive in classes else np.zeros(end - low))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return F.arrow_udf(score, "double")(F.col(text))


def score_quality(
    docs: DataFrame, model: tuple[list[int], np.ndarray], key: str = "doc_id", text: str = "text", positive: int = 1
) -> DataFrame:
    """``key, score, predicted`` (1 from a score of one half) per row of ``docs``; an empty table gives none.

    Null and empty texts are scored as texts without a word. Long texts are scored whole, in memory of some ten times the longest.
    Repeated rows and null keys each keep their row. Only ``key`` and ``text`` are read, whatever other columns are named.
    """
    scored = docs.select(F.col(key), quality_score(docs, model, text, positive).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
