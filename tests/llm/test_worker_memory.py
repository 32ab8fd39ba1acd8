"""What the pipeline's task functions leave in a worker, or hold there at once, is bounded."""

import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

import corpus_pipeline
from catalogkit.llm import slack_packing
from catalogkit.llm.ppm_language import count_grams
from catalogkit.llm.tokens import MAX_PIECES, worker_tokens


def test_the_pipeline_packs_small_slices_with_a_small_dictionary(monkeypatch):
    asked, sizes, passed = [], [], {}

    class Tokens:
        def ids(self, texts):
            sizes.append(sum(map(len, texts)))
            return np.zeros(len(texts), np.uint32), np.arange(len(texts) + 1)

    monkeypatch.setattr(slack_packing, "worker_tokens", lambda path, special="parse", max_pieces=MAX_PIECES: asked.append(max_pieces) or Tokens())
    monkeypatch.setattr(slack_packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(["x" * 1000] * 900)], ["_key", "_text"])
    monkeypatch.setattr(slack_packing, "pack_documents", lambda docs, path, **more: passed.update(more))
    monkeypatch.setattr(corpus_pipeline, "bounded_batches", lambda spark: None)
    corpus_pipeline.pack(None, None, "")
    made = list(slack_packing._cut("", 1, 4096, False, **passed)(iter([batch])))
    assert sum(b.num_rows for b in made) == 900 and sum(sizes) == 900_000
    assert max(sizes) <= 1 << 18
    assert max(asked) <= 150_000


def test_language_tasks_let_go_of_tokenizers():
    sys._catalogkit_tokens = {("somewhere", "parse", 1): object()}
    assert list(count_grams(1)(iter([]))) == []
    assert not hasattr(sys, "_catalogkit_tokens")


def test_tokenizers_of_other_sizes_are_other_tokenizers():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = worker_tokens(path, max_pieces=40), worker_tokens(path)
    assert few is worker_tokens(path, max_pieces=40) and few is not many
    texts = [f"word{n} and other words {n % 7}" for n in range(200)]
    for at in range(0, 200, 20):
        (a, b), (c, d) = few.ids(texts[at : at + 20]), many.ids(texts[at : at + 20])
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
