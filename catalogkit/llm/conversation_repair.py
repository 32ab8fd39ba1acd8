"""Repair of conversation structure by dynamic programming over a grammar of role and fault sequences.

A conversation is a string of symbols, one per row: the role's initial with the row's first fault. The cheapest
edits of a stretch, from each state of the wanted order to each, are a 4 x 4 matrix of (cost, audit); a longer
stretch is a min-plus product. Re-Pair finds rules for pairs of symbols that repeat over all strings of a batch, each
rule's matrix is worked out once, bottom-up, and every conversation in which it stands uses it.

States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. Equal costs are decided by
the audit. Two audits of the same stretch between the same states and of the same cost never begin one another (that
would take inserts that lead back to where they start, at a cost), so the least of each entry is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Rows per stretch; longer conversations are several stretches, also over several tasks.
STRETCH = 4096
#: Symbols per grammar.
GRAMMAR = 16_384
_BLANK = " \t\n\x0b\x0c\r"
_FAULTS = ("", "blank", "duplicate", "truncated")
_FAR = 1 << 60

Entry = tuple[int, object]  # cost, rope: a string or a pair of ropes
Matrix = list[Entry]


def _leaves(rope: object) -> Iterator[str]:
    """The strings of a rope in order."""
    todo = [rope]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            if one:
                yield one
        else:
            todo += (one[1], one[0])


def _less(a: object, b: object) -> bool:
    """Whether rope ``a`` reads before rope ``b``."""
    while isinstance(a, tuple) and isinstance(b, tuple) and a[0] is b[0]:
        a, b = a[1], b[1]
    if a is b:
        return False
    left, right = _leaves(a), _leaves(b)
    x, y = next(left, ""), next(right, "")
    while x and y:
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:] or next(left, ""), y[n:] or next(right, "")
    return not x and bool(y)


def _better(new: Entry, old: Entry) -> bool:
    return new[0] < old[0] or (new[0] == old[0] and new[0] < _FAR and _less(new[1], old[1]))


def _turn(state: int) -> int:
    """The state after a user or assistant row, whichever is due."""
    return 3 if state == 2 else 2


def symbol_matrix(symbol: int) -> Matrix:
    """Edits of one row, with the inserts before it. A symbol is four times the initial (u, a, s, other) plus the fault."""
    initial, fault = divmod(symbol, 4)
    late = 3 * (fault == 3)
    out: Matrix = [(_FAR, "")] * 16
    for start in range(4):
        state, cost, inserted = start, 0, ""
        while True:
            edits = [(4, "D", state)]
            if fault in (0, 3):
                edits.append((3 + late, "R", _turn(state)))
                due = {0: state != 2, 1: state == 2, 2: state == 0}.get(initial, False)
                if due:
                    edits.append((late, "K", 1 if initial == 2 else _turn(state)))
            for price, letter, end in edits:
                new = (cost + price, inserted + letter)
                if _better(new, out[4 * start + end]):
                    out[4 * start + end] = new
            state, cost, inserted = _turn(state), cost + 3, inserted + "I"
            if len(inserted) > 2 or state == start:
                break
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; ropes are joined, not copied."""
    out: Matrix = [(_FAR, "")] * 16
    for start in range(4):
        for middle in range(4):
            cost, rope = left[4 * start + middle]
            if cost >= _FAR:
                continue
            for end in range(4):
                more, tail = right[4 * middle + end]
                at = 4 * start + end
                if cost + more <= out[at][0] and more < _FAR and _better(new := (cost + more, (rope, tail)), out[at]):
                    out[at] = new
    return out


def re_pair(strings: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules ``(left, right)`` numbered from 16, and the strings written in them: no pair stands twice."""
    ends = np.cumsum([len(s) + 1 for s in strings])
    flat = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    for end, s in zip(ends.tolist(), strings):
        flat[end - 1 - len(s) : end - 1] = s
    rules: list[tuple[int, int]] = []
    while len(flat) > 1:
        codes = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 32 | flat[1:], -1)
        kinds, counts = np.unique(codes, return_counts=True)
        counts[kinds < 0] = 0
        best = int(counts.argmax())
        if counts[best] < 2:
            break
        left, right = int(kinds[best]) >> 32, int(kinds[best]) & 0xFFFFFFFF
        at = np.flatnonzero(codes == kinds[best])
        if left == right:
            # every second place of a run; the others overlap
            new = np.append(True, np.diff(at) > 1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        flat[at] = 16 + len(rules)
        rules.append((left, right))
        flat = np.delete(flat, at + 1)
    cuts = np.flatnonzero(flat < 0)
    return rules, [flat[s:e] for s, e in zip(np.append(0, cuts[:-1] + 1).tolist(), cuts.tolist())]


def matrices(strings: list[np.ndarray]) -> Iterator[Matrix]:
    """The matrix of each string (not empty), by one grammar for all."""
    rules, written = re_pair(strings)
    known = [symbol_matrix(s) for s in range(16)]
    for left, right in rules:
        known.append(product(known[left], known[right]))
    for symbols in written:
        out = known[symbols[0]]
        for s in symbols[1:].tolist():
            out = product(out, known[s])
        yield out


def _stretch_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved(names: list[str]) -> pa.RecordBatch:
        strings = [np.frombuffer(s.encode(), np.uint8).astype(np.int64) - 65 for s in names]
        found = list(matrices(strings))
        costs = pa.array([[c for c, _ in m] for m in found], pa.list_(pa.int64()))
        audits = pa.array([["".join(_leaves(r)) for _, r in m] for m in found], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), costs, audits], ["symbols", "costs", "audits"])

    for batch in batches:
        names, size = [], 0
        for s in batch["symbols"].to_pylist():
            names.append(s)
            size += len(s)
            if size >= GRAMMAR:
                yield solved(names)
                names, size = [], 0
        if names:
            yield solved(names)


def _stretches(stretch: int) -> Callable:
    """Rows in order to strings of symbols; a task's number and a count keep the order of a conversation's stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, kept, number = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])

            def put(symbols: str) -> None:
                nonlocal number
                for values, value in zip(out, (now, number, symbols)):
                    values.append(value)
                number += 1

            for conv, symbol, then, n in zip(*(batch[c].to_pylist() for c in ("conv", "symbol", "then", "n"))):
                if kept and conv != now:
                    put(kept)
                    kept = ""
                now = conv
                kept += symbol
                n -= 1
                while len(kept) + n >= stretch:
                    n -= stretch - len(kept)
                    put(kept + then * (stretch - len(kept)))
                    kept = ""
                kept += then * n
            yield _stretch_batch(batch["conv"].type, task, *out)
        if kept:
            yield _stretch_batch(pa.array([now]).type if now is not None else pa.null(), task, [now], [number], [kept])

    return run


def _stretch_batch(kind: pa.DataType, task: int, conv: list, number: list, symbols: list) -> pa.RecordBatch:
    arrays = [pa.array(conv, kind), pa.array([task] * len(conv), pa.int32()), pa.array(number, pa.int64()), pa.array(symbols, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["conv", "task", "number", "symbols"])


def _illegal(symbols: str) -> int:
    """Adjacent rows whose initials are not system-user, user-assistant or assistant-user."""
    kinds = (np.frombuffer(symbols.encode(), np.uint8) - 65) // 4
    pairs = 4 * kinds[:-1] + kinds[1:]
    return int((~np.isin(pairs, (8, 1, 4))).sum())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, the last of a conversation first, to one row per conversation; ropes of later stretches are shared."""
    names = ("conv", "n_blank", "n_duplicate", "n_truncated", "illegal", "cost", "audit")
    start: Matrix = [(0, ""), (6, "II"), (3, "I"), (0, "")]
    now, open_, state, counts, first = None, False, start, [0] * 4, ""

    def done() -> tuple:
        return (now, *counts, state[0][0], "".join(_leaves(state[0][1])))

    def table(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        kinds = [kind, *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], list(names))

    kind = pa.null()
    for batch in batches:
        rows, kind = [], batch["conv"].type
        for conv, symbols, costs, audits in zip(*(batch[c].to_pylist() for c in ("conv", "symbols", "costs", "audits"))):
            if not open_ or conv != now:
                if open_:
                    rows.append(done())
                now, open_, state, counts, first = conv, True, start, [0] * 4, ""
            new: Matrix = []
            for x in range(4):
                best: Entry = (_FAR, "")
                for y in range(4):
                    cost = costs[4 * x + y] + state[y][0]
                    if costs[4 * x + y] < _FAR and _better(one := (cost, (audits[4 * x + y], state[y][1])), best):
                        best = one
                new.append(best)
            state = new
            faults = np.bincount((np.frombuffer(symbols.encode(), np.uint8) - 65) % 4, minlength=4)
            for k in range(3):
                counts[k] += int(faults[k + 1])
            counts[3] += _illegal(symbols + first)
            first = symbols[0]
        yield table(kind, rows)
    if open_:
        yield table(kind, [done()])


class _Conversation:
    """Edits of one conversation applied to its rows, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _turn(self.state)
            yield "user" if self.state == 2 else "assistant", "", "insert"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "K" and self.state == 0 and role.startswith("s"):
            self.state = 1
        else:
            self.state = _turn(self.state)
        if letter == "R":
            yield "user" if self.state == 2 else "assistant", text, "rerole"
        else:
            yield role, text, "keep"


def _applied(rows_out: bool) -> Callable:
    """Each conversation's edits, then its rows: out come the repaired rows, or one row with their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, begun, digest, n, conv = None, None, None, 0, None
        for batch in batches:
            out: list[tuple] = []

            def take(made: Iterator[tuple[str, str, str]]) -> None:
                nonlocal n
                for role, text, edit in made:
                    if rows_out:
                        out.append((conv, n, role, text, edit))
                    else:
                        digest.update((("\n" if n else "") + role + ":" + text).encode())
                    n += 1

            def end() -> None:
                if one is not None:
                    take(one.inserts())
                    if not rows_out:
                        out.append((*begun, digest.hexdigest()))

            columns = [batch[c].to_pylist() for c in batch.schema.names]
            for values in zip(*columns):
                conv_, about, role, text = values[0], values[1], values[-2], values[-1]
                if about is not None:
                    end()
                    conv, one, digest, n = conv_, _Conversation(about["audit"]), hashlib.sha256(), 0
                    begun = (conv_, *about.values())
                else:
                    take(one.row(role, text))
            yield _batch(out, batch, rows_out)
        if one is not None:
            out = []
            take(one.inserts())
            if not rows_out:
                out.append((*begun, digest.hexdigest()))
            yield _batch(out, batch, rows_out)

    return run


def _batch(rows: list[tuple], like: pa.RecordBatch, rows_out: bool) -> pa.RecordBatch:
    kind, about = like.schema.field("conv").type, like.schema.field("about").type
    if rows_out:
        fields = [("conv", kind), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    else:
        fields = [("conv", kind), *[(f.name, f.type) for f in about], ("repaired_sha256", pa.string())]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns in use, nulls of role and text as one space; ``o1, o2`` order rows by turn, nulls first."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))
    return named.select(
        "*", F.col("turn").isNotNull().alias("o1"), F.coalesce("turn", F.lit(0)).alias("o2"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"),
    )


_ORDER = ("conv", "o1", "o2", "role", "t1", "t2")


def _symbol(fault: Column) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    return F.char(F.lit(65) + 4 * kind + fault)


def edits(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH
) -> DataFrame:
    """The cheapest edits of each conversation: ``conv, n_blank, n_duplicate, n_truncated, illegal, cost, audit``.

    Keep costs 0, rerole to user or assistant 3, delete 4, insert an empty user or assistant row 3; a truncated
    row that stays adds 3; blank rows and duplicates have to go. The result reads ``(s?(ua)+)?`` by role initials. Of
    equal costs the audit that is ASCII-least wins.

    Equal rows of a turn are counted together first. Rows are then dealt out by ranges of the whole order, so a
    conversation of any length is spread over tasks, as stretches of ``stretch`` symbols; equal stretches are solved
    once. Folding takes one stretch at a time.
    """
    plain = _plain(rows, conv, turn, role, text)
    last = F.rtrim("text", F.lit(_BLANK))
    fault = F.when(last == "", 1).when(F.right(last, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    single = plain.select(*_ORDER, fault.alias("fault")).groupBy(*_ORDER, "fault").agg(F.count("*").alias("n"))
    same = ["conv", "role", "t1", "t2"]
    order = F.struct("o1", "o2")
    seen = single.filter("fault <> 1").groupBy(*same).agg(F.min(order).alias("first"), F.count("*").alias("turns"))
    seen = seen.filter("turns > 1").select(*[F.col(c).alias(f"s_{c}") for c in same], "first")
    on = F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role"))
    on = on & (F.col("t1") == F.col("s_t1")) & (F.col("t2") == F.col("s_t2"))
    marked = single.join(seen, on, "left")
    again = F.when(F.col("fault") == 1, F.lit(1)).otherwise(F.lit(2))
    own = F.when((F.col("fault") != 1) & (F.struct("o1", "o2") > F.col("first")), F.lit(2)).otherwise(F.col("fault"))
    marked = marked.select(*_ORDER, _symbol(own).alias("symbol"), _symbol(again).alias("then"), "n")
    ordered = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", "symbol", "then", "n")
    kind = plain.schema["conv"].dataType.simpleString()
    stretches = ordered.mapInArrow(_stretches(stretch), f"conv {kind}, task int, number long, symbols string")
    solved = stretches.select("symbols").distinct().mapInArrow(
        _stretch_matrices, "symbols string, costs array<long>, audits array<string>"
    )
    joined = stretches.join(solved, "symbols").repartition("conv")
    joined = joined.sortWithinPartitions("conv", F.desc("task"), F.desc("number")).select("conv", "symbols", "costs", "audits")
    return joined.mapInArrow(
        _fold, f"conv {kind}, n_blank long, n_duplicate long, n_truncated long, illegal long, cost long, audit string"
    )


def _with_edits(rows: DataFrame, about: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation its row of ``about`` (``conv`` and a struct) and then its rows in order."""
    plain = _plain(rows, conv, turn, role, text)
    kind = about.schema["about"].dataType
    first = about.select("conv", "about", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                         F.lit(0).alias("k"), F.lit(False).alias("o1"), F.lit(0).cast("long").alias("o2"),
                         F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"))
    then = plain.select("conv", F.lit(None).cast(kind).alias("about"), "role", "text", F.lit(1).alias("k"), "o1", "o2", "t1", "t2")
    both = first.unionByName(then).repartition("conv").sortWithinPartitions("conv", "k", "o1", "o2", "role", "t1", "t2")
    return both.select("conv", "about", "role", "text")


def repaired_rows(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The rows that the cheapest edits leave: ``conv, place, role, text, edit`` (keep, rerole or insert).

    Nulls, ties and repeats are handled as in ``repair``.
    """
    found = edits(rows, conv, turn, role, text).select("conv", F.struct("audit").alias("about"))
    kind = found.schema["conv"].dataType.simpleString()
    both = _with_edits(rows, found, conv, turn, role, text)
    out = both.mapInArrow(_applied(True), f"conv {kind}, place long, role string, text string, edit string")
    return out.withColumnRenamed("conv", conv)


def repair(
    rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first; rows of one turn by role, then by a hash of the text, so that equal
    rows stand together (the first stays, the others are duplicates). A null role or text is one space, hence blank. ``gaps`` is
    the number of turns missing between the first and last (0 if all are null). A null conversation id is one
    conversation. Ids that only ``conversations`` has get zeros, an empty audit and the hash of the empty text. An
    empty table gives no rows. Other columns are not read, whatever their names.

    The hash of a conversation is that of one running text, so its rows pass one task, in sorted order and one at
    a time; only its audit, a letter per row, is in memory.
    """
    plain = _plain(rows, conv, turn, role, text)
    turns = plain.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    every = (rows if conversations is None else conversations).select(F.col(conv).alias("c")).distinct()
    turns = every.join(turns, F.col("c").eqNullSafe(F.col("conv")), "left").select("c", "gaps")
    found = edits(rows, conv, turn, role, text)
    counts = ("gaps", "n_blank", "n_duplicate", "n_truncated", "illegal", "cost")
    about = turns.join(found, F.col("c").eqNullSafe(F.col("conv")), "left").select(
        F.col("c").alias("conv"),
        F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit")).alias("about"),
    )
    kind = about.schema["conv"].dataType.simpleString()
    fields = "gaps long, n_blank long, n_duplicate long, n_truncated long, illegal long, cost long, audit string"
    out = _with_edits(rows, about, conv, turn, role, text).mapInArrow(
        _applied(False), f"conv {kind}, {fields}, repaired_sha256 string"
    )
    return out.select(
        F.col("conv").alias(conv), "gaps", F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"),
        F.col("n_truncated").alias("truncated"), "illegal", "cost", "audit", "repaired_sha256",
    )


def damage(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows with known faults, by ``crc32(conv:turn) % 20``: 0 drops, 1 empties the text, 2 takes its ``[.!?]`` away, 3
    repeats the row, 4 makes the role user. A null is one space. Returns the four columns."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    plain = rows.select(F.col(conv).alias(conv), F.col(turn).alias(turn), role_.alias(role), text_.alias(text), (F.crc32(name) % 20).alias("kind"))
    kind = F.col("kind")
    changed = plain.filter(kind != 0).select(
        conv, turn, F.when(kind == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")
