"""Alignment of two tokenizers against a plain pass over each text."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from catalogkit.llm import lockstep_align as la

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


class Plain:
    """The contract read word by word, with the libraries' own encoders."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in plain)}

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_bytes = [bytes(self.letters[c] for c in self.a.id_to_token(n)) for n in a]
        b_bytes = []
        for n in b:
            p = self.b.id_to_piece(n)
            b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode())
        want = (" " + text).encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            return [], []
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        return list(zip(ends[0], a)), list(zip(ends[1], b))

    def rows(self, docs):
        found, counts = [], collections.Counter()
        for key, text in docs:
            a, b = self.tokens(text)
            cuts = {e for e, _ in a} & {e for e, _ in b}
            at_a, at_b = dict(a), dict(b)
            links = [(at_a[e], at_b[e]) for e in sorted(cuts)]
            groups, parts = [], ([], [])
            for e in sorted({*at_a, *at_b}):
                for ids, at in zip(parts, (at_a, at_b)):
                    ids += [str(at[e])] if e in at else []
                if e in cuts:
                    groups.append("|".join(map(",".join, parts)))
                    parts = ([], [])
            counts.update(links)
            found.append((key, len(a), len(b), len(cuts), links, ";".join(groups)))
        best = collections.defaultdict(int)
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return collections.Counter(
            (key, n_a, n_b, n_cuts, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if n_a else "")
            for key, n_a, n_b, n_cuts, links, g in found
        )


NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = [
    "a  b   c", " lead", "\n\nab\n  cd \t x", "tail  ", " ", "\t", "x y z", "line;\r\nnext", "a▁b", "café naïve",
    "<|endoftext|> plain </s> <s>", "　wide", "A\x00B \x1c c", "\U0001f600\U0001f468‍\U0001f469 done", "don't we'll 12345 ...",
    "e﻿ f", "  sep", "<0x41> [x]", "    deep\n\tindent", "ends\n",
]


def test_rows_equal_a_plain_pass(spark, docs, clashing, none, awkward):
    want = Plain().rows([(r[0], r[1]) for r in awkward])
    for table in (docs, clashing):
        assert collections.Counter(tuple(r[n] for n in NAMES) for r in la.rate_links(table, A, B).collect()) == want
    assert la.rate_links(none, A, B).count() == 0
    assert la.rate_links(none, A, B).columns == NAMES


def test_odd_texts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["the ", "\n", "  ", "ing", "é", "中", ".", "\t", "Z9", "'s", "\r"]) for _ in range(n)) for n in range(40)]
    rows = list(enumerate(texts))
    got = la.rate_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), A, B)
    assert collections.Counter(tuple(r[n] for n in NAMES) for r in got.collect()) == Plain().rows(rows)


@pytest.mark.parametrize("lane", [3, 50, 2048])
def test_lanes_and_compaction(lane):
    rng = np.random.default_rng(lane)
    ends_a, ends_b, a_off, b_off, want, base = [], [], [0], [0], [], 0
    for _ in range(60):
        n = int(rng.integers(0, 400))
        if n:
            a, b = (np.unique(np.append(rng.integers(1, n + 1, max(1, n // 3)), n)) for _ in range(2))
            want += (np.intersect1d(a, b) + base).tolist()
            ends_a.append(a + base)
            ends_b.append(b + base)
            base += n
        a_off.append(sum(map(len, ends_a)))
        b_off.append(sum(map(len, ends_b)))
    ea, eb = np.concatenate(ends_a), np.concatenate(ends_b)
    i, j = la.lockstep(ea, np.array(a_off), eb, np.array(b_off), lane)
    assert ea[i].tolist() == want and eb[j].tolist() == want


def test_every_link_is_a_possible_pair():
    aligner = la.worker_aligner(A, B)
    assert len(aligner.pairs) < 400_000 and (np.diff(aligner.pairs) > 0).all()
    for text in ODD:
        (a, a_off), (b, b_off) = aligner.tokens.ids([text])
        i, j = la.lockstep(np.cumsum(aligner.a_size[a]), a_off, np.cumsum(aligner.b_size[b]), b_off)
        assert np.isin(a[i].astype(np.int64) * len(aligner.b_size) + b[j], aligner.pairs).all()


def test_query_over_documents(spark):
    from catalogkit.llm.queries import QUERIES, read

    rows = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_lockstep_align"](spark, "/root/testdata/sf0.001")
    assert collections.Counter(tuple(r[n] for n in NAMES) for r in got.collect()) == Plain().rows(rows)
