"""Conversation repair against plain dynamic programming from the last row on, and against full enumeration."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from catalogkit.llm import conversation_repair as cr
from catalogkit.llm.queries import QUERIES, read

NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    """Fault of each row in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """``(cost, audit, repaired rows)``: best suffix from each state, last row first."""
    after = {"": "ua"}  # due role by state
    best = {"": (0, "", ()), "s": (6, "II", (("user", ""), ("assistant", ""))), "u": (3, "I", (("assistant", ""),)), "a": (0, "", ())}
    for (_, _, role, text), fault in zip(rows[::-1], faults[::-1]):
        direct = {}
        for state in best:
            due = "assistant" if state == "u" else "user"
            options = [(4, "D", None, state)]
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                options.append((3 + late, "R", (due, text), due[0]))
                if role[:1] == due[0] or (role[:1] == "s" and state == ""):
                    options.append((late, "K", (role, text), role[0]))
            direct[state] = min(
                (c + best[end][0], e + best[end][1], ((row,) if row else ()) + best[end][2]) for c, e, row, end in options
            )
        step = {"": "u", "s": "u", "a": "u", "u": "a"}
        new = {}
        for state in direct:
            found, cost, letters, rows_, now = [], 0, "", (), state
            for _ in range(3):
                c, a, r = direct[now]
                found.append((cost + c, letters + a, rows_ + r))
                now = step[now]
                cost, letters = cost + 3, letters + "I"
                rows_ += ((("user" if now == "u" else "assistant"), ""),)
            new[state] = min(found)
        best = new
    return best[""]


def plain(rows, ids, text_hash=None):
    """Expected digest of each conversation; ``text_hash`` orders the texts of one turn."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    out = []
    for conv in ids:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), text_hash(r[3]) if text_hash else 0))
        faults = faults_of(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = "".join((r[2][:1] or "x") for r in own)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = plain_repair(own, faults)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


def got(df):
    return collections.Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def xxh(text):
    import xxhash

    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def rows_at_random(seed, convs=150, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "", " \n", "cut off", "a.b", None, "Done. ", "x"]
    out = []
    for conv in range(convs):
        for n in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else n + rng.choice([0, 0, 0, 1])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            out.append((conv if conv else None, turn, role, rng.choice(texts)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_digest_of_awkward_rows(spark):
    rows = rows_at_random(1)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain([tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows], {r[0] for r in rows}, xxh)
    assert got(cr.repair(table)) == want
    from pyspark.sql import functions as F

    names = "conv o1 o2 t1 t2 symbol then n first turns task number costs audits about k place edit fault".split()
    clashing = table.select("*", *[F.lit("x").alias(n) for n in names])
    assert got(cr.repair(clashing)) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(empty).count() == 0 and cr.repair(empty).columns == NAMES


def test_damage_and_conversations_that_lose_every_row(spark):
    rows = rows_at_random(2, 400, 3)
    table = spark.createDataFrame(rows, SCHEMA)
    want = plain(plain_damage(rows), {r[0] for r in rows}, xxh)
    found = got(cr.repair(cr.damage(table), table))
    assert found == want
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in found)


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_one_hot_conversation_in_stretches(spark, stretch):
    rng = random.Random(stretch)
    rows = [(7, n, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two", ""]) + str(rng.randrange(500)) + ".") for n in range(1500)]
    rows += [(8, 1, "user", "again.")] * 900 + [(9, 0, "user", "Hi."), (9, 1, "assistant", "Ho.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r["conv"]: (r["cost"], r["audit"]) for r in cr.edits(table, stretch=stretch).collect()}
    for conv in (7, 8, 9):
        own = sorted(r for r in rows if r[0] == conv)
        assert found[conv] == plain_repair(own, faults_of(own))[:2]


def test_repaired_rows_keep_the_order(spark):
    rows = rows_at_random(3, 40)
    back = collections.defaultdict(list)
    for r in cr.repaired_rows(spark.createDataFrame(rows, SCHEMA)).collect():
        back[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for own in back.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for _, role, _ in own))


def test_plain_dynamic_programming_against_enumeration():
    """Every audit of few rows, with at most four inserts."""
    letters = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", ""), ("assistant", "d"), ("tool", "e.")]
    for n in (1, 2, 3):
        for rows in itertools.product(letters, repeat=n):
            rows = [(0, k, *r) for k, r in enumerate(rows)]
            faults = faults_of(rows)
            best = None
            for inserts in itertools.product(range(3), repeat=n + 1):
                if sum(inserts) > 4:
                    continue
                for edits in itertools.product("KDR", repeat=n):
                    made, cost, ok = [], 3 * sum(inserts), True
                    audit = "I" * inserts[0]
                    made += ["I"] * inserts[0]
                    for (_, _, role, _), fault, e, more in zip(rows, faults, edits, inserts[1:]):
                        if e != "D":
                            ok &= fault not in ("blank", "duplicate")
                            cost += 3 * (fault == "truncated") + 3 * (e == "R")
                            made.append(role[0] if e == "K" else "R")
                        else:
                            cost += 4
                        audit += e + "I" * more
                        made += ["I"] * more
                    s = made[:1] == ["s"]
                    rest = made[1:] if s else made
                    fits = all(x in ("I", "R", "ua"[k % 2]) for k, x in enumerate(rest)) and len(rest) % 2 == 0 and not (s and not rest)
                    if ok and fits:
                        best = min(best or (cost, audit), (cost, audit))
            assert plain_repair(rows, faults)[:2] == best


def test_re_pair_gives_the_strings_back():
    rng = np.random.default_rng(0)
    strings = [rng.integers(0, 3, n).astype(np.int64) for n in rng.integers(1, 60, 80)] + [np.zeros(37, np.int64)]
    rules, written = cr.re_pair(strings)

    def spell(s):
        return [s] if s < 16 else spell(rules[s - 16][0]) + spell(rules[s - 16][1])

    assert [sum(map(spell, w.tolist()), []) for w in written] == [s.tolist() for s in strings]
    pairs = collections.Counter()
    for w in written:
        at = -2
        for k, p in enumerate(zip(w.tolist(), w.tolist()[1:])):
            if not (p[0] == p[1] and at == k - 1 and pairs[p]):
                pairs[p] += 1
                at = k
    assert max(pairs.values()) < 2 and len(rules) > 5


def test_query(spark):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_grammar_repair"](spark, "/root/testdata/sf0.001")) == plain(plain_damage(rows), {r[0] for r in rows})
