"""Quality rules with line labels: a linear-chain conditional random field marks content or boilerplate.

Every line is described by yes/no features of its bytes. The field's weights are trained on labelled documents,
whose lines take the document's label; transitions let a line lean on its neighbours. Viterbi decoding
labels the lines, and the share of words in content lines decides whether a document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalogkit.llm.sampling import bounded_sample
from catalogkit.llm.textbytes import chunks, runs, span_hashes, sums_between, window_hashes, word_table

#: The fit reads at most so many rows and characters of whole texts per label.
FIT_ROWS, FIT_CHARS = 1000, 4_000_000
EPOCHS, RATE, SHRINK = 60, 0.5, 1e-4
CONTENT_SHARE = 0.5
WINDOW, MIN_WORDS, MAX_REPEAT = 3, 50, 0.5

# features: (name, upper bounds of its bins); a bin is one yes/no feature
_BINS: list[tuple[str, tuple[float, ...]]] = [
    ("words", (0, 2, 5, 10)),
    ("word_length", (3, 4, 6, 8, 12)),
    ("symbols", (0, 0.02, 0.1, 0.3)),
    ("capitals", (0, 0.05, 0.2, 0.6)),
    ("digits", (0, 0.05, 0.2, 0.5)),
    ("marks", (0, 0.02, 0.06, 0.12)),
    ("bars", (0, 0.02, 0.1)),
    ("bangs", (0, 0.02, 0.1)),
    ("again", (0, 0.1, 0.3, 0.6)),
    ("echo", (0, 0.1, 0.3)),
    ("full_stop", (0,)),
    ("repeated", (0,)),
]
N_FEATURES = 1 + sum(len(bounds) + 1 for _, bounds in _BINS)


class Lines:
    """Lines of a chunk of texts with their features, and the texts' counts for the base rules."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = word_table()[data]
        starts, ends = runs(word, offsets)
        hashes = span_hashes(data, starts, ends)
        first = np.searchsorted(starts, offsets)  # each text's words
        self.n_words = np.diff(first)
        lead = word & ((data & 0xC0) != 0x80)
        self.word_chars = sums_between(lead, offsets[:-1], offsets[1:])
        symbol = _table(b"#*$%&|<>")[data]
        self.n_symbols = sums_between(symbol, offsets[:-1], offsets[1:])
        self.n_repeat_words = _repeated(hashes, first)

        # a line ends before its \n or with its text; every text has one line at least
        breaks = np.flatnonzero(data == 10)
        line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        text_of = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]))
        line_ends = np.append(line_starts[1:], len(data))
        line_ends = line_ends - (np.append(text_of[1:] == text_of[:-1], False)).astype(np.int64)
        self.text_of, n = text_of, len(text_of)
        self.bounds = np.searchsorted(text_of, np.arange(len(offsets)))
        low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        self.words = high - low
        again = _seen(span_hashes(data, line_starts, line_ends), text_of, self.words > 0)
        self.n_dup_lines = np.diff(np.searchsorted(np.flatnonzero(again), self.bounds))

        size = np.maximum(sums_between(word, line_starts, line_ends), 1)

        def share(of: bytes) -> np.ndarray:
            return sums_between(_table(of)[data], line_starts, line_ends) / size

        letters = bytes(range(65, 91))
        figures = {
            "words": self.words,
            "word_length": size / np.maximum(self.words, 1),
            "symbols": sums_between(symbol, line_starts, line_ends) / size,
            "capitals": share(letters),
            "digits": share(bytes(range(48, 58))),
            "marks": share(b".,;:?"),
            "bars": share(b"|"),
            "bangs": share(b"!"),
            "again": _lagged(hashes, first, 1)(low, high),
            "echo": _lagged(hashes, first, 2)(low, high),
            "full_stop": (self.words > 0) & np.isin(data[np.maximum(ends[np.maximum(high, 1) - 1], 1) - 1], list(b".?!"))
            if len(ends)
            else np.zeros(n),
            "repeated": again,
        }
        columns, at = [np.zeros(n, np.int64)], 1
        for name, bounds in _BINS:
            columns.append(at + np.searchsorted(bounds, figures[name], "left"))
            at += len(bounds) + 1
        #: Numbers of the features that hold, one column per kind.
        self.features = np.stack(columns, axis=1)


def _table(of: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


def _seen(hashes: np.ndarray, group: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which counted entries equal an earlier counted one of their group."""
    at = np.flatnonzero(counts)
    order = at[np.lexsort((at, hashes[at], group[at]))]
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    return out


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text inside windows that the text has more than once."""
    windows = window_hashes(hashes, WINDOW)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(windows)]
    at = np.flatnonzero(np.arange(len(windows)) + WINDOW <= first[1:][text])
    order = at[np.lexsort((windows[at], text[at]))]
    same = (windows[order[1:]] == windows[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + WINDOW, -1)
    return sums_between(np.cumsum(cover[:-1]) > 0, first[:-1], first[1:])


def _lagged(hashes: np.ndarray, first: np.ndarray, lag: int):
    """Share of a span's words that equal the word ``lag`` before, within the text."""
    same = np.zeros(len(hashes), bool)
    same[lag:] = hashes[lag:] == hashes[:-lag] if len(hashes) > lag else False
    inner = first[:-1][np.diff(first) > 0]
    for k in range(lag):
        same[np.minimum(inner + k, len(same) - 1)] = False
    return lambda low, high: sums_between(same, low, high) / np.maximum(high - low, 1)


class Field:
    """Weights of the chain: per feature and label, first label, and label to label (0 content, 1 boilerplate)."""

    def __init__(self, emit: np.ndarray, first: np.ndarray, move: np.ndarray):
        self.emit, self.first, self.move = emit, first, move

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros((N_FEATURES, 2)), np.zeros(2), np.zeros((2, 2)))

    def viterbi(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every line; content wins ties. All texts advance together, line by line."""
        score = self.emit[features].sum(axis=1)
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        starts, lengths = bounds[:-1][order], sizes[order]
        back = np.zeros((len(features), 2), np.int8)
        best = np.zeros((len(order), 2))
        live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        for t, n in enumerate(live):
            at = starts[:n] + t
            if t == 0:
                best[:n] = self.first + score[at]
                continue
            paths = best[:n, :, None] + self.move
            back[at] = paths.argmax(axis=1)
            best[:n] = paths.max(axis=1) + score[at]
        labels = np.zeros(len(features), np.int8)
        current = best.argmax(axis=1).astype(np.int8)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = starts[:n] + t
            labels[at] = current[:n]
            current[:n] = back[at, current[:n]]
        return labels

    def slope(self, features: np.ndarray, bounds: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gradient of the mean log-likelihood per line: observed less expected counts."""
        score = self.emit[features].sum(axis=1)
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        starts, lengths = bounds[:-1][order], sizes[order]
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        ahead, behind = np.zeros((len(features), 2)), np.zeros((len(features), 2))
        for t, n in enumerate(live):
            at = starts[:n] + t
            ahead[at] = score[at] + (self.first if t == 0 else _log_sum(ahead[at - 1][:, :, None] + self.move, 1))
        for t in range(len(live) - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            behind[at] = _log_sum(self.move + (score[at + 1] + behind[at + 1])[:, None, :], 2)
        whole = np.zeros(len(features))
        total = _log_sum(ahead[bounds[1:] - 1], 1)
        whole = np.repeat(total, sizes)
        each = np.exp(ahead + behind - whole[:, None])
        wanted = np.eye(2)[target]
        emit = np.zeros_like(self.emit)
        for column in range(features.shape[1]):
            np.add.at(emit, features[:, column], wanted - each)
        first = (wanted - each)[bounds[:-1]].sum(axis=0)
        inner = np.setdiff1d(np.arange(len(features)), bounds[:-1])
        pair = np.exp(
            ahead[inner - 1][:, :, None] + self.move + (score[inner] + behind[inner])[:, None, :]
            - whole[inner][:, None, None]
        )
        move = np.einsum("ni,nj->ij", wanted[inner - 1], wanted[inner]) - pair.sum(axis=0)
        n = len(features)
        return emit / n, first / n, move / n


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(texts: list[str], bad: list[bool], epochs: int = EPOCHS, rate: float = RATE, shrink: float = SHRINK) -> Field:
    """A field from whole texts, every line labelled as its text. Adam steps over the full gradient."""
    field = Field.blank()
    if len(set(bad)) < 2:
        return field
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    lines = Lines(np.frombuffer(b"".join(data), np.uint8), offsets)
    target = np.array(bad, np.int64)[lines.text_of]
    parts = [field.emit, field.first, field.move]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, epochs + 1):
        for k, slope in enumerate(field.slope(lines.features, lines.bounds, target)):
            slope = slope - shrink * parts[k]
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            size = np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8
            parts[k] += rate * (1 - step / (epochs + 1)) * mean[k] / (1 - 0.9**step) / size
    return field


def fit_lines(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = FIT_ROWS, chars: int = FIT_CHARS,
) -> Field:
    """Train on a bounded sample of labelled documents; label 0 is bad. Null labels, keys and texts teach nothing."""
    named = labels.select(F.col(key).alias("key"), (F.col(label) == 0).alias("bad"))
    named = named.filter("bad is not null and key is not null").distinct()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    sample = bounded_sample(texts, "key", "text", "bad", rows, chars, named).collect()
    sample.sort(key=lambda r: (r["key"], r["bad"], r["text"]))
    return train([r["text"] for r in sample], [r["bad"] for r in sample])


def line_quality(
    docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", content_share: float = CONTENT_SHARE
) -> DataFrame:
    """Counts, base rule, share of words in content lines and verdict per row of ``docs``.

    Words are runs without ASCII white space. ``base_failed``: fewer than 50 words, or more than half of them
    inside three-word windows that the text repeats. ``kept``: base rule passed and ``content_share`` of the
    words or more in content lines. Null and empty texts have no words and fail; an untrained field calls every
    line content. Repeated rows are judged alike; an empty table gives none. Long texts are labelled whole, in memory that
    follows the longest text. Only the named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast((field.emit, field.first, field.move))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "content_words"]

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Field(*held.value)
        for column in columns:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for _, _, data, offsets in chunks(column):
                lines = Lines(data, offsets)
                content = own.viterbi(lines.features, lines.bounds) == 0
                found = [getattr(lines, n) for n in names[:5]]
                found += [np.diff(lines.bounds), sums_between(lines.words * content, lines.bounds[:-1], lines.bounds[1:])]
                for part, values in zip(parts, found):
                    part.append(values)
            arrays = [pa.array(np.concatenate(p) if p else [], pa.int64()) for p in parts]
            yield pa.StructArray.from_arrays(arrays, names)

    found = F.arrow_udf(judge, ", ".join(f"{n} long" for n in names))(F.col(text))
    counted = docs.select(F.col(key), found.alias("_f")).select(key, "_f.*")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0)
    return counted.select(
        "*", failed.alias("base_failed"), share.alias("content_share"), (~failed & (share >= content_share)).alias("kept")
    )
