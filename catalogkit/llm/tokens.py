"""Token ids of whole texts, equal to those of the ``tokenizers`` library, at dictionary speed.

The word vocabulary drops white space and never merges over it, so the ids of a text are those of
its white-space-separated pieces in turn. Pieces repeat, so each is encoded once per worker and looked up
afterwards. Pieces of Latin letters, digits and signs go through byte-pair merging in ``tiktoken`` with the same
merges; all others go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import sys
from itertools import chain

import numpy as np

# pieces kept per worker: 500,000 pieces with their ids take about 100 MB
MAX_PIECES = 500_000
END = "\0"  # marks the end of a word; no piece that is merged here contains it


class WordTokens:
    """``ids(texts)`` gives ids and offsets. ``special="text"`` reads the names of special tokens as text."""

    def __init__(self, path: str, special: str = "parse", max_pieces: int = MAX_PIECES):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special == "text"
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocab = described["model"]["vocab"]
        letters = _byte_letters()
        as_byte = {letter: bytes([b]) for b, letter in letters.items()}
        suffix = described["model"]["end_of_word_suffix"]
        end = END.encode()
        ranks: dict[bytes, int] = {}
        self.id_of_rank = np.zeros(512 + len(described["model"]["merges"]), np.uint32)
        self.ends_word = np.zeros(len(self.id_of_rank), bool)
        for b, letter in letters.items():
            ranks[bytes([b])] = b
            self.id_of_rank[b] = vocab[letter]
            if b:
                # the end mark joins the byte before it before all other merges
                ranks[bytes([b]) + end] = 256 + b
                self.id_of_rank[256 + b] = vocab[letter + suffix]
                self.ends_word[256 + b] = True
        for n, merge in enumerate(described["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            word = left + right
            ends = word.endswith(suffix)
            body = word[: -len(suffix)] if ends else word
            ranks.setdefault(b"".join(as_byte[c] for c in body) + (end if ends else b""), 512 + n)
            self.id_of_rank[512 + n] = vocab[word]
            self.ends_word[512 + n] = ends
        split = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.core = split._core_bpe
        pattern = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.mark = regex.compile(pattern).sub
        # Latin letters that normalisation only lower-cases one by one
        self.simple = regex.compile(r"[\x21-\x7eÀ-įı-ňŊ-ſ]+").fullmatch
        self.simple_text = regex.compile(r"[\t-\r\x20-\x7eÀ-įı-ňŊ-ſ]+").fullmatch
        self.max_pieces = max_pieces
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths, self.seen = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.used = self.n = 0

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of simple pieces, all in one call: every word gets its end mark first."""
        marked = self.mark("\\g<0>" + END, "\n".join(pieces).lower())
        words = np.fromiter((p.count(END) for p in marked.split("\n")), np.int64, len(pieces))
        ranks = np.array(self.core.encode_ordinary(marked), np.int64)
        # a word ends with the only kind of rank that has the mark
        word_ends = np.flatnonzero(self.ends_word[ranks]) + 1
        ends = np.append(0, word_ends)[np.cumsum(words)]
        return self.id_of_rank[ranks], np.diff(ends, prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        simple = [p for p in pieces if self.simple(p)] if not self.simple("".join(pieces)) else pieces
        plain = [p for p in simple if "<|" not in p]
        parts = [self._encode(plain)] if plain else []
        if len(plain) < len(pieces):
            known = set(plain)
            others = [p for p in pieces if p not in known]
            found = [self.whole.encode(p, add_special_tokens=False).ids for p in others]
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            parts.append((ids, np.fromiter(map(len, found), np.int64, len(found))))
            plain = plain + others
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        self._keep(plain, ids.astype(np.uint32), sizes)

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, upto = self.n + len(pieces), self.used + len(ids)
        self.pool = _with_room(self.pool, upto)
        self.starts, self.lengths, self.seen = (_with_room(x, n) for x in (self.starts, self.lengths, self.seen))
        self.pool[self.used : upto] = ids
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.n : n] = sizes
        self.seen[self.n : n] = 0
        self.code.update(zip(pieces, range(self.n, n)))
        self.n, self.used = n, upto

    def _forget(self) -> None:
        """Drop the pieces met only once since the last time."""
        often = np.flatnonzero(self.seen[: self.n] > 1)
        names = list(self.code)  # in the order of their codes
        starts, sizes, pool = self.starts[often], self.lengths[often], self.pool
        upto = np.cumsum(sizes)
        where = np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        self._reset()
        if 2 * len(often) < self.max_pieces:
            self._keep([names[k] for k in often.tolist()], pool[where], sizes)

    def _split(self, text: str) -> list[str]:
        """Parts whose ids, one after the other, are the ids of the text."""
        if self.simple_text(text) and "<|" not in text:
            return text.lower().split()
        return _pieces(text)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each; null has none."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += self._split(text)
            ends.append(len(words))
        if self.n > self.max_pieces:
            self._forget()
        get = self.code.get
        codes = list(map(get, words))
        if None in codes:
            self._learn(list({w for w, c in zip(words, codes) if c is None}))
            codes = list(map(self.code.__getitem__, words))
        at = np.fromiter(codes, np.int64, len(codes))
        self.seen[: self.n] += np.bincount(at, minlength=self.n)
        sizes = self.lengths[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        where = np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])
        return self.pool[where], upto[np.array(ends)]


def _pieces(text: str) -> list[str]:
    # str.split also cuts at four control characters that the vocabulary keeps
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        for c in "\t\n\r":
            text = text.replace(c, " ")
        return [p for p in text.split(" ") if p]
    return text.split()


def _with_room(values: np.ndarray, size: int) -> np.ndarray:
    return values if size <= len(values) else np.concatenate([values, np.zeros(size, values.dtype)])


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def worker_tokens(path: str, special: str = "parse", max_pieces: int = MAX_PIECES) -> WordTokens:
    """One tokenizer per Python worker: task functions travel by value, so it is kept on ``sys``."""
    kept = sys.__dict__.setdefault("_catalogkit_tokens", {})
    if (path, special, max_pieces) not in kept:
        kept[path, special, max_pieces] = WordTokens(path, special, max_pieces)
    return kept[path, special, max_pieces]


def drop_worker_tokens() -> None:
    """Let go of the tokenizers that former tasks left in this worker, for tasks that hold other large tables."""
    sys.__dict__.pop("_catalogkit_tokens", None)
