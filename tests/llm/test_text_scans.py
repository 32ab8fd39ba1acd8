"""Decontamination, line windows, line labels, tokens, packing and flat files against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from catalogkit.llm import line_crf, slack_packing, token_scan
from catalogkit.llm.decontaminate import _windows, contamination, remove_contaminated, remove_spans
from catalogkit.llm.line_windows import remove_repeated_lines
from catalogkit.llm.tokens import WordTokens
from catalogkit.session import new_work_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def reference_tokenizer(special=False):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = special
    return whole


@pytest.fixture(scope="module")
def word_tokens():
    return WordTokens(VOCABULARY, max_pieces=50), reference_tokenizer()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aAbB'é ſŉĲ1²\x1c\x85 \n<|endoftext|>.!-", max_size=60)), max_size=5))
def test_ids_equal_the_library(word_tokens, texts):
    ours, whole = word_tokens
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offsets = ours.ids(texts)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


# -- packing -------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=8))
def test_packing_is_complete_and_within_capacity(counts):
    fills = slack_packing.minimum_slack(counts, 40)
    used = collections.Counter()
    for pieces, times in fills:
        assert sum(length * copies for length, copies in pieces) <= 40
        for length, copies in pieces:
            used[length] += copies * times
    assert used == collections.Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 60))
def test_fullest_combination_by_brute_force(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1) if r + k * length <= room}
    chosen = slack_packing._fullest(sorted(counts, reverse=True), counts, room)
    assert sum(length * copies for length, copies in chosen) == max(reach)
    assert all(copies <= counts[length] for length, copies in chosen)


def check_packing(packed, awkward, capacity):
    whole = reference_tokenizer()
    want = collections.Counter()
    for key, text, *_ in awkward:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[(key, n, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    rows = packed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    bins: list[int] = []  # first fit, longest first
    for r in sorted(rows, key=lambda r: -r.length):
        k = next((k for k, used in enumerate(bins) if used + r.length <= capacity), len(bins))
        bins[k : k + 1] = [(bins[k] if k < len(bins) else 0) + r.length]
    assert len(places) <= len(bins)


def test_packed_pieces(docs, clashing, none, awkward):
    check_packing(slack_packing.pack_documents(docs, VOCABULARY, capacity=256), awkward, 256)
    check_packing(slack_packing.pack_documents(clashing, VOCABULARY), awkward, 4096)
    assert slack_packing.pack_documents(none, VOCABULARY).count() == 0


def test_packed_ids_round_trip(docs, awkward):
    packed = slack_packing.pack_documents(docs.filter("doc_id = 24"), VOCABULARY, capacity=512, with_ids=True).collect()
    ids = [i for r in sorted(packed, key=lambda r: r.piece) for i in r.ids]
    text = next(t for k, t, *_ in awkward if k == 24)
    assert ids == reference_tokenizer().encode(text, add_special_tokens=False).ids + [1]


# -- flat token files ----------------------------------------------------------------------

def test_flat_files_round_trip(spark, docs, none, awkward):
    path = new_work_path(spark, "flat")
    token_scan.write_token_files(docs, path, VOCABULARY, 49407, documents=4)
    whole = reference_tokenizer(special=True)
    want = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in awkward)
    for block in (7, 1000, 1 << 19):  # documents over many blocks, and blocks of many documents
        rows = token_scan.token_counts(spark, path, 49407, block_tokens=block, glob="part-*").collect()
        assert sorted(r.n_tokens for r in rows) == want and all(r.ended for r in rows)
        by_file = collections.defaultdict(list)
        for r in rows:
            by_file[r.file].append((r.doc_no, r.start, r.n_tokens))
        for own in by_file.values():
            assert [n for n, _, _ in sorted(own)] == list(range(len(own)))
            assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(sorted(own), sorted(own)[1:]))
    path = new_work_path(spark, "flat")
    token_scan.write_token_files(none, path, VOCABULARY, 49407)
    assert token_scan.token_counts(spark, path, 49407, glob="part-*").count() == 0


def test_scan_of_hand_made_files(spark, tmp_path):
    files = {"a": [5, 0, 0, 7, 8], "b": [], "c": [0], "d": [1, 2, 3], "e": [0, 9] * 50}
    for name, ids in files.items():
        np.array(ids, "<u4").tofile(tmp_path / f"{name}.bin")
    (tmp_path / "f.bin").write_bytes(np.array([4, 0], "<u4").tobytes() + b"\x01\x02")  # half an id at the end
    for block in (1, 2, 3, 64):
        rows = token_scan.token_counts(spark, str(tmp_path), 0, "<u4", block).collect()
        got = {n: [(r.n_tokens, r.ended) for r in sorted(rows, key=lambda r: r.doc_no) if r.file == f"{n}.bin"] for n in "abcdef"}
        assert got["a"] == [(1, True), (0, True), (2, False)]
        assert got["b"] == [] and got["c"] == [(0, True)] and got["d"] == [(3, False)] and got["f"] == [(1, True)]
        assert got["e"] == [(0, True)] + [(1, True)] * 49 + [(1, False)]


def test_file_over_two_gigabytes(spark, tmp_path):
    places = [0, 7, (1 << 19) + 3, 600_000_000, (1 << 30) + 100]  # in ids of two bytes: the last is beyond 2 GB
    with open(tmp_path / "a b%20.bin", "wb") as file:
        for place in places:
            file.seek(2 * place)
            file.write((49407).to_bytes(2, "little"))
        file.truncate(2 * ((1 << 30) + 400))
    rows = token_scan.token_counts(spark, str(tmp_path), 49407).orderBy("doc_no").collect()
    begins = [0] + [p + 1 for p in places]
    assert [r.start for r in rows] == begins and [r.ended for r in rows] == [True] * 5 + [False]
    assert [r.n_tokens for r in rows] == [p - b for p, b in zip(places, begins)] + [299]


def test_store_that_only_spark_reads(spark, tmp_path):
    np.array([5, 9, 0, 7, 0, 3], "<u2").tofile(tmp_path / "a.bin")
    spark.conf.set("fs.viewfs.mounttable.flat.link./in", f"file://{tmp_path}")
    rows = token_scan.token_counts(spark, "viewfs://flat/in", 0, block_tokens=2).orderBy("doc_no").collect()
    assert [(r.n_tokens, r.ended) for r in rows] == [(2, True), (1, True), (1, False)]


# -- decontamination -----------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, size):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").encode().lower())
        width = min(size, len(words))
        for k in range(len(words) - width + 1 if words else 0):
            windows[tuple(words[k : k + width])].add(str(item))
    out = collections.Counter()
    for key, text, *_ in docs:
        words, hit, found = WORD.findall((text or "").encode().lower()), set(), set()
        for width in {len(w) for w in windows}:
            for k in range(len(words) - width + 1):
                if owners := windows.get(tuple(words[k : k + width])):
                    hit |= set(range(k, k + width))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(key, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words))] += 1
    return out


@pytest.fixture(scope="module")
def items(awkward):
    texts = {k: t for k, t, *_ in awkward}
    part = " ".join(texts[1].split()[3:30])
    return [(1, part), (2, part.upper()), (10, "STONE, cloud"), (3, None), (4, ""), (5, "?!"), (6, "日本語の文章"), (None, texts[4]),
            (7, " ".join(texts[2].split()[:13])), (8, " ".join(texts[24].split()[5000:5020])), (1, "river river river river")]


@pytest.mark.parametrize("block_bytes", [1 << 25, 150])
def test_contamination(spark, docs, clashing, none, awkward, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(awkward, items, 13)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for table in (docs, clashing):
        got = contamination(table, benchmark, block_bytes=block_bytes).select(*columns).collect()
        assert collections.Counter(tuple(r) for r in got) == want
    bad = collections.Counter(k[0] for k in want.elements() if k[-1])
    assert sum(bad.values()) > 0
    left = remove_contaminated(clashing, benchmark, block_bytes=block_bytes)
    assert left.columns == clashing.columns and left.count() == len(awkward) - sum(bad.values())
    assert contamination(none, benchmark).count() == 0
    assert contamination(docs, benchmark.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_windows_of_many_items_and_blocks(spark, docs, awkward):
    # one item under many ids, an item that repeats itself, and blocks of which each is held alone
    texts = {k: t for k, t, *_ in awkward}
    part = " ".join(texts[1].split()[3:30])
    items = [(n, part) for n in range(300)] + [(900, "river " * 200), (901, part), (901, part)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(awkward, items, 13)
    for block_bytes in (1 << 25, 20_000):
        got = contamination(docs, benchmark, block_bytes=block_bytes).drop("items", "spans").collect()
        assert collections.Counter(tuple(r) for r in got) == want


def test_a_block_is_small(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50_000, 100_000)
    text = " ".join(f"w{w}" for w in words)
    windows = _windows([(1, text)], 13)
    held = len(windows[1]) + sum(column.nbytes for _, *columns in windows[2] for column in columns)
    assert held < 10 * len(text)


def test_spans_are_cut_out(spark):
    words = [f"w{n}" for n in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "é! " + " ".join(words[20:40]) + " ü.")], "doc_id int, text string")
    benchmark = spark.createDataFrame([(9, " ".join(words[20:40]))], "item_id int, text string")
    got = {r.doc_id: r.text for r in remove_spans(docs, benchmark).collect()}
    assert got == {1: " ".join(words[:20]) + "  " + " ".join(words[40:]), 2: None, 3: "é!  ü."}


# -- line windows --------------------------------------------------------------------------

def brute_windows(rows):
    seen, out = set(), []
    unique = sorted(set(rows), key=lambda r: (r[0] is None, r[0]))
    for key, text in unique:
        if text is None:
            out.append((key, text, 0, 0, None))
            continue
        lines = text.split("\n")
        trimmed = [x.strip(" \t\x0b\x0c\r") for x in lines]
        covered, new = set(), set()
        for k in range(len(lines) - 2):
            window = tuple(trimmed[k : k + 3])
            if any(window):
                if window in seen or window in new:
                    covered |= {k, k + 1, k + 2}
                new.add(window)
        seen |= new
        left = [x for k, x in enumerate(lines) if k not in covered]
        out.append((key, text, len(lines), len(covered), "\n".join(left)))
    return {(key, text): rest for key, text, *rest in out}


def test_line_windows(spark, docs, clashing, none, awkward):
    rows = [(k, t) for k, t, *_ in awkward]
    loop = "a\nb\nc\n" * 5
    more = [(40, loop), (41, "x\n" + loop), (42, "q\n  \n\n\n\nq"), (43, "\n\n\n\n"), (44, " a\r\nb\t\nc"), (45, "one\ntwo")]
    extra = spark.createDataFrame([(k, t, None, None, None) for k, t in more], docs.schema)
    want = brute_windows(rows + more)
    got = remove_repeated_lines(docs.unionAll(extra)).withColumnRenamed("text", "left")
    again = docs.unionAll(extra).select(F.col("doc_id").alias("id"), F.col("text").alias("old"))
    for r in got.select("doc_id", "left", "n_lines", "n_removed").collect():
        options = [v for (k, t), v in want.items() if k == r.doc_id]
        assert [r.n_lines, r.n_removed, r.left] in options
    assert got.count() == again.count()
    assert set(remove_repeated_lines(clashing).columns) == {*clashing.columns, "n_removed"}
    assert remove_repeated_lines(none).count() == 0


# -- line labels ---------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words, seen, dup = WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    cover = {k + d for k in range(len(words) - 2) if count[tuple(words[k : k + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def test_base_counts(docs, clashing, none, awkward):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = collections.Counter((k, *brute_counts(t)) for k, t, *_ in awkward)
    for table in (docs, clashing):
        rows = line_crf.line_quality(table, line_crf.Field.blank()).collect()
        assert collections.Counter(tuple(r[c] for c in columns) for r in rows) == want
        assert all(r.kept == (not r.base_failed) for r in rows)  # untrained: all lines are content
    assert line_crf.line_quality(none, line_crf.Field.blank()).count() == 0


def random_chains(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 6, 9)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    features = rng.integers(0, line_crf.N_FEATURES, (bounds[-1], 4))
    field = line_crf.Field(rng.normal(size=(line_crf.N_FEATURES, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    return field, features, bounds, rng.integers(0, 2, bounds[-1])


def path_score(field, features, labels):
    score = field.first[labels[0]] + sum(field.emit[f, y].sum() for f, y in zip(features, labels))
    return score + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_and_slope_by_enumeration(seed):
    import itertools

    field, features, bounds, target = random_chains(seed)
    labels, total = field.viterbi(features, bounds), 0.0
    for low, high in zip(bounds, bounds[1:]):
        own = features[low:high]
        paths = {y: path_score(field, own, y) for y in itertools.product((0, 1), repeat=high - low)}
        assert paths[tuple(labels[low:high])] == max(paths.values())

    def likelihood(f):
        out = 0.0
        for low, high in zip(bounds, bounds[1:]):
            own = features[low:high]
            every = [path_score(f, own, y) for y in itertools.product((0, 1), repeat=high - low)]
            out += path_score(f, own, tuple(target[low:high])) - np.log(np.exp(every).sum())
        return out / len(features)

    emit, first, move = field.slope(features, bounds, target)
    for part, slope in ((field.emit, emit), (field.first, first), (field.move, move)):
        for at in [tuple(x) for x in np.argwhere(np.ones(part.shape))][:12]:
            part[at] += 1e-5
            up = likelihood(field)
            part[at] -= 2e-5
            down = likelihood(field)
            part[at] += 1e-5
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def test_line_verdicts_held_out(spark, sf_dir):
    from catalogkit.llm.queries import QUERIES

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = QUERIES["op3_line_crf"](spark, sf_dir).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 1")
    rows = found.filter("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.97


def test_token_files_of_equal_name_in_two_folders(spark, tmp_path):
    from catalogkit.llm import token_scan

    for folder, sizes in (("k=1", (3, 2)), ("k=2", (6, 2))):
        (tmp_path / folder).mkdir()
        ids = [x for n in sizes for x in [*range(1000, 1000 + n), 49407]]
        (tmp_path / folder / "part-0.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = token_scan.token_counts(spark, str(tmp_path), 49407, block_tokens=4, glob="part-*")
    rows = sorted((r["path"].split("/")[-2], r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in got.collect())
    assert rows == [("k=1", 0, 0, 3, True), ("k=1", 1, 4, 2, True), ("k=2", 0, 0, 6, True), ("k=2", 1, 7, 2, True)]


def test_one_token_file_of_ten_thousand_blocks(spark, tmp_path):
    from catalogkit.llm import token_scan

    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 60, 3000)
    ids = np.concatenate([np.append(np.full(n, 7), 49407) for n in sizes]).astype("<u2")
    ids.tofile(tmp_path / "part-0.bin")
    got = token_scan.token_counts(spark, str(tmp_path), 49407, block_tokens=len(ids) // 10_000, glob="part-*")
    assert [r["n_tokens"] for r in got.orderBy("doc_no").collect()] == sizes.tolist()
    assert not [r for r in got.filter("not ended").collect()]
