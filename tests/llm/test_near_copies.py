"""Near copies by five-word shingles against all pairs."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from catalogkit.llm.near_copies import first_of_near_copies
from catalogkit.llm.queries import read


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def links(texts, least=0.8):
    """Similar pairs of places; texts without words are all alike."""
    sets, where, out = [shingles(t) for t in texts], collections.defaultdict(list), set()
    for n, s in enumerate(sets):
        for x in s:
            where[x].append(n)
    for n, s in enumerate(sets):
        shared = collections.Counter(m for x in s for m in where[x] if m > n)
        out |= {(n, m) for m, c in shared.items() if c >= least * (len(s) + len(sets[m]) - c)}
    bare = [n for n, s in enumerate(sets) if not s]
    return out | set(zip(bare, bare[1:]))


def kept_by(rows):
    """Places that stay: the first by key (null last) of what links reach."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links([r[1] for r in rows]):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for n in range(len(rows)):
        groups[find(n)].append(n)
    return sorted(min((rows[n][0] is None, rows[n][0] or 0) for n in g)[::-1] for g in groups.values())


def got(df):
    return sorted((r["doc_id"] or 0, r["doc_id"] is None) for r in df.collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_planted_copies(spark):
    """Copies at 0.8 to 1, copies of copies, many copies of one text, and unlike texts with a long passage in common."""
    rng, rows, pairs = random.Random(2), [], []
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for n in range(300):
        base = fresh(rng.randint(60, 400))
        copy = edited(rng, base, max(1, len(base) // rng.randint(50, 90)))
        s, t = shingles(" ".join(base)), shingles(" ".join(copy))
        if 0.8 <= len(s & t) / len(s | t) <= 0.9:
            pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy).upper())]
    hot, passage = fresh(120), fresh(60)
    rows += [(1000 + n, " ".join(edited(rng, hot, 1))) for n in range(150)]
    rows += [(2000 + n, " ".join(fresh(60) + passage + fresh(60))) for n in range(150)]
    rows += [(3000 + n, " ".join(hot)) for n in range(50)]
    left = got(first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    want = [tuple(x) for x in kept_by(rows)]
    ids = {k for k, _ in left}
    assert len(pairs) > 60 and sum(b not in ids for _, b in pairs) >= 0.9 * len(pairs)
    assert set(want) <= set(left)  # nothing goes that has to stay
    assert len(left) - len(want) <= 0.02 * len(rows)


def test_no_pair_at_the_threshold_is_lost(spark):
    """Pairs barely similar enough, which fingerprints and bands miss now and then, beside texts barely too unlike."""
    rng, rows, near = random.Random(7), [], 0
    for _ in range(500):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(48, 60))]
        copy = edited(rng, base, rng.randint(1, 2))
        s, t = shingles(" ".join(base)), shingles(" ".join(copy))
        near += 0.8 <= len(s & t) / len(s | t) <= 0.84
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    assert near > 50
    assert got(first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == [tuple(x) for x in kept_by(rows)]


def test_awkward_rows(spark, docs, clashing, none, awkward):
    want = [tuple(x) for x in kept_by([(k, t) for k, t, *_ in awkward])]
    for table in (docs, clashing.withColumns({n: F.lit("x") for n in ("t", "best", "no", "low", "high", "bands", "root", "packed", "words")})):
        kept = first_of_near_copies(table)
        assert got(kept) == want and kept.columns == table.columns
    assert first_of_near_copies(none).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_no_pair_of_the_documents_is_lost(spark, folder):
    table = read(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert got(first_of_near_copies(table)) == [tuple(x) for x in kept_by(rows)]
