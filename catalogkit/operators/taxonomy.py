"""Placing products in a five-level taxonomy."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.functions.text import Col, normalize_text, tokenize_unique, trim
from catalogkit.functions.values import computed_once, first_non_blank
from catalogkit.operators.blocks import block_pairs
from catalogkit.operators.dedupe import first_per_key, top_per_key
from catalogkit.session import stored

LEVELS = ["department", "category", "subcategory", "segment", "subsegment"]

# Points of a shared word, of each equal level, and the count at which a branch gets one point.
TOKEN_POINTS = 4
LEVEL_POINTS = [80, 90, 100, 110, 120]
FULL_COUNT = 25

# Where a classification came from, with its confidence.
SOURCE_EXACT, CONFIDENCE_EXACT = "existing_exact_match", 1.0
SOURCE_NONE, CONFIDENCE_NONE = "no_candidates", 0.0
SOURCE_BEST, CONFIDENCE_BEST = "heuristic", 0.35
SOURCE_CHOICE = "external_choice"

#: Rows of a block of item signatures and of entries.
ITEM_ROWS, ENTRY_ROWS = 2048, 4096

CANDIDATES_TYPE = "array<struct<entry_no:bigint,score:double,item_count:bigint>>"


def path_text(prefix: str = "") -> Column:
    """Levels joined by `` > ``, blanks skipped."""
    return F.concat_ws(" > ", *[F.nullif(trim(F.col(prefix + level)), F.lit("")) for level in LEVELS])


def taxonomy_entries(df: DataFrame, order: str) -> DataFrame:
    """Entries with generated id, path, normalised path, word set and count.

    ``df`` has the five levels, ``item_count`` and a unique 1-based ``order`` column.
    """
    count = F.coalesce(F.col("item_count").try_cast("double"), F.lit(0.0)).cast("long")
    path = path_text()
    return df.select(
        F.concat(F.lit("taxonomy_"), F.col(order)).alias("taxonomy_id"),
        F.col(order).cast("long").alias("entry_no"),
        *[F.nullif(trim(F.col(level)), F.lit("")).alias(level) for level in LEVELS],
        count.alias("item_count"),
        path.alias("path"),
        normalize_text(path).alias("normalized_path"),
        tokenize_unique(path).alias("path_tokens"),
    )


def taxonomy_exact(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Add ``exact_entry_no`` and ``exact_id``: the first entry with the item's normalised path."""
    first = first_per_key(entries, ["normalized_path"], ["entry_no"]).select(
        F.col("normalized_path").alias("_path"),
        F.col("entry_no").alias("exact_entry_no"),
        F.col("taxonomy_id").alias("exact_id"),
    )
    keyed = computed_once(items, _target=F.nullif(normalize_text(path_text()), F.lit("")))
    return keyed.join(first, F.col("_target") == F.col("_path"), "left").drop("_target", "_path")


def _scorer(block: pd.DataFrame, limit: int):
    """Arrow function giving the best ``limit`` entries of one held block for each item."""
    block = block.sort_values(["item_count", "entry_no"], ascending=[False, True], kind="stable")
    entry_no, item_count = block["entry_no"].to_numpy(), block["item_count"].to_numpy()
    size = len(block)
    # scores are multiples of 1/25, so they are exact integers after scaling
    base = np.minimum(block["item_count"].to_numpy(), FULL_COUNT).astype(np.int32)
    codes = [pd.factorize(block[f"n_{level}"]) for level in LEVELS]
    vocabulary = pd.factorize(block["path_tokens"].explode().dropna())
    owner = np.repeat(np.arange(size), block["path_tokens"].map(len).to_numpy())
    postings = owner[np.argsort(vocabulary[0], kind="stable")]
    begins = np.concatenate([[0], np.cumsum(np.bincount(vocabulary[0], minlength=len(vocabulary[1])))])
    words = pa.array(vocabulary[1], pa.string())
    level_values = [pa.array(names, pa.string()) for _, names in codes]
    step = max(1, 4_000_000 // size)
    top = min(limit, size)

    def level_scores(combination: np.ndarray) -> np.ndarray:
        """Score of every entry for one combination of level values."""
        score = base.copy()
        for (entry_codes, _), code, bonus in zip(codes, combination, LEVEL_POINTS):
            score[entry_codes == code] += bonus * FULL_COUNT
        return score

    def best(levels: list[pa.Array], tokens: pa.ListArray):
        rows = len(tokens)
        level_codes = np.stack(
            [np.asarray(pc.index_in(v, value_set=names).fill_null(-1)) for v, names in zip(levels, level_values)], axis=1
        )
        counts = np.asarray(tokens.value_lengths().fill_null(0)).astype(np.int64)
        word = np.asarray(pc.index_in(tokens.flatten(), value_set=words).fill_null(-1))
        word_row = np.repeat(np.arange(rows), counts)
        word_row, word = word_row[word >= 0], word[word >= 0]
        chosen, points = np.empty((rows, top), np.int64), np.empty((rows, top), np.int64)
        for low in range(0, rows, step):
            high = min(rows, low + step)
            # items share few combinations of levels: score those once, then add the words
            combinations, which = np.unique(level_codes[low:high], axis=0, return_inverse=True)
            score = np.stack([level_scores(c) for c in combinations])[which.ravel()]
            a, b = np.searchsorted(word_row, [low, high])
            length = begins[word[a:b] + 1] - begins[word[a:b]]
            start = np.repeat(begins[word[a:b]] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
            hit = postings[start + np.arange(length.sum())] if length.sum() else np.empty(0, np.int64)
            cell = np.repeat(word_row[a:b] - low, length) * size + hit
            shared = np.bincount(cell, minlength=score.size).reshape(score.shape)
            score += (shared * (TOKEN_POINTS * FULL_COUNT)).astype(np.int32)
            # entries stand in tie order, and argmax returns the first of equals
            picked = np.arange(high - low)
            for place in range(top):
                entry = score.argmax(axis=1)
                chosen[low:high, place] = entry
                points[low:high, place] = score[picked, entry]
                score[picked, entry] = -1
        return entry_no[chosen], points / FULL_COUNT, item_count[chosen]

    return best, top


def _score_blocks(limit: int):
    """Function of a block of item signatures and a block of entries to the best entries per signature."""

    def run(items: pa.Table, entries: pa.Table) -> pa.Table:
        if not items.num_rows or not entries.num_rows:
            return _SCORED.empty_table()
        best, top = _scorer(entries.to_pandas(), limit)
        levels = [items[f"n_{level}"].combine_chunks() for level in LEVELS]
        entry, score, count = best(levels, items["tokens"].combine_chunks())
        row = np.repeat(np.arange(items.num_rows), top)
        keep = score.ravel() > 0
        columns = [items[h].to_numpy()[row[keep]] for h in ("h1", "h2")]
        columns += [x.ravel()[keep] for x in (entry, score, count)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _SCORED.types)], schema=_SCORED)

    return run


_SCORED = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("entry_no", pa.int64()), ("score", pa.float64()), ("item_count", pa.int64())]
)


#: Sets of levels that an item and an entry may have in common, as bits, with their points.
_SETS = {
    sum(1 << n for n in chosen): sum(LEVEL_POINTS[n] for n in chosen)
    for size in range(len(LEVELS) + 1) for chosen in combinations(range(len(LEVELS)), size)
}


def _enough(points: int) -> list[int]:
    """The smallest sets of levels worth at least ``points``: every set worth as much holds one of them."""
    able = [m for m, worth in _SETS.items() if worth >= points]
    return [m for m in able if not any(o != m and o & m == o for o in able)]


def _level_keys(level: str = "n_") -> Column:
    """Array of ``(levels, key)`` for each set of levels: one hash of the set and the values there."""
    rows = []
    for mask in _SETS:
        if mask:
            values = [F.col(level + name) for n, name in enumerate(LEVELS) if mask >> n & 1]
            rows.append(F.struct(F.lit(mask).alias("levels"), F.xxhash64(F.lit(mask), *values).alias("key")))
    return F.array(*rows)


def level_thresholds(asked: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """``asked`` with ``levels_needed``: the sets of levels of which an entry must share one to be among the best ``limit``.

    If ``limit`` entries share a set of levels with an item, its last place has at least that set's points. Words and
    counts add at most 4 a word and 1, so an entry must earn the rest by its levels. An empty set means that every entry may do.
    """
    keys = held.select(F.inline(_level_keys())).groupBy("levels", "key").agg(F.count("*").alias("n"))
    common = keys.filter(F.col("n") >= limit).select("levels", "key")
    points = F.create_map(*[F.lit(x) for pair in _SETS.items() for x in pair])
    own = asked.select("h1", "h2", F.inline(_level_keys())).join(common, ["levels", "key"])
    sure = own.groupBy("h1", "h2").agg(F.max(F.element_at(points, F.col("levels"))).alias("sure"))
    steps = sorted(set(_SETS.values()))
    known = asked.join(sure, ["h1", "h2"], "left")
    need = F.coalesce("sure", F.lit(0)) - TOKEN_POINTS * F.size("tokens") - 1
    # no more is needed than all levels give
    sets = F.array(*[F.lit(m) for m in _enough(steps[-1])])
    for worth in reversed(steps[:-1]):
        sets = F.when(need <= worth, F.array(*[F.lit(m) for m in _enough(worth)])).otherwise(sets)
    return known.withColumn("levels_needed", sets).drop("sure")


def scored_by_levels(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``h1, h2, entry_no, score, item_count`` of the entries that share one of an item's ``levels_needed``.

    An equality join on sets of levels. A pair that shares several of the sets is taken with the first.
    """
    own = [F.col("s_" + name) for name in LEVELS]
    items = asked.select(
        "h1", "h2", "levels_needed", F.col("tokens").alias("s_tokens"), *[F.col("n_" + n).alias("s_" + n) for n in LEVELS],
        F.explode("levels_needed").alias("levels"),
    )
    # the key of the one set that the row asks for
    values = [F.when(F.col("levels").bitwiseAND(1 << n) != 0, own[n]) for n in range(len(LEVELS))]
    items = items.withColumn("key", F.xxhash64("levels", *values))
    entries = held.select("*", F.inline(_level_keys()))
    pairs = items.join(entries, ["levels", "key"])
    same = [F.when(F.col("s_" + n) == F.col("n_" + n), 1).otherwise(0) for n in LEVELS]
    shared = sum((s * (1 << n) for n, s in enumerate(same)), F.lit(0))
    pairs = pairs.withColumn("shared", shared)
    first = F.get(F.filter("levels_needed", lambda m: m.bitwiseAND(F.col("shared")) == m), F.lit(0))
    words = F.size(F.array_intersect("s_tokens", "path_tokens"))
    points = sum((s * bonus for s, bonus in zip(same, LEVEL_POINTS)), F.lit(0)) + words * TOKEN_POINTS
    full = F.least("item_count", F.lit(FULL_COUNT))
    return pairs.filter(F.col("levels") == first).select(
        "h1", "h2", "entry_no", ((points * FULL_COUNT + full) / FULL_COUNT).cast("double").alias("score"), "item_count"
    )


def taxonomy_candidates(
    items: DataFrame, entries: DataFrame, search_text: Col, limit: int = 10, item_rows: int = ITEM_ROWS,
    entry_rows: int = ENTRY_ROWS, where: Column | None = None,
) -> DataFrame:
    """Add ``candidates``: the best entries per item as ``array<struct<entry_no, score, item_count>>``.

    Every entry scores 4 per shared word, 80 to 120 per equal level (blank equals blank), and up
    to one point for its count; ties go to the higher count, then to file order. Items alike in levels and words
    are scored once. From how many entries share which levels with an item follows what its last place is worth at
    least, and only entries whose levels can reach that are scored. Where that rules nothing out, as with few
    entries or unknown levels, items meet all entries in pairs of blocks. Items outside ``where`` are not scored
    and have no candidates.
    """
    held = entries.select(
        "entry_no", "item_count", "path_tokens", *[normalize_text(level).alias(f"n_{level}") for level in LEVELS]
    )
    held = stored(held, "entries")
    named = [normalize_text(level).alias(f"n_{level}") for level in LEVELS]
    signature = F.struct(*named, F.array_sort(tokenize_unique(search_text)).alias("tokens"))
    keyed = computed_once(items, _signature=signature if where is None else F.when(where, signature))
    scored = F.col("_signature").isNotNull()
    keyed = keyed.withColumns({
        "_h1": F.when(scored, F.xxhash64("_signature")), "_h2": F.when(scored, F.xxhash64(F.lit("items"), "_signature"))
    })
    asked = keyed.filter(scored).groupBy(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"))
    asked = stored(asked.agg(F.first("_signature").alias("s")).select("h1", "h2", "s.*"), "signatures")
    needed = stored(level_thresholds(asked, held, limit), "needed")
    every = F.array_contains("levels_needed", 0)
    rest = needed.filter(every).drop("levels_needed")
    pairs = block_pairs(rest, held, ["h1", "h2"], "entry_no", item_rows, entry_rows, rest)
    kinds = "h1 long, h2 long, entry_no long, score double, item_count long"
    found = scored_by_levels(needed.filter(~every), held).unionByName(pairs.applyInArrow(_score_blocks(limit), kinds))
    best = top_per_key(found, ["h1", "h2"], [F.desc("score"), F.desc("item_count"), "entry_no"], limit, "rank")
    entry = F.struct("entry_no", "score", "item_count").alias("entry")
    lists = best.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(
        F.array_sort(F.collect_list(F.struct("rank", entry))).alias("_best")
    )
    joined = keyed.drop("_signature").join(lists, ["_h1", "_h2"], "left")
    candidates = F.transform("_best", lambda c: c["entry"])
    return joined.withColumn(
        "candidates", F.coalesce(candidates, F.array().cast(CANDIDATES_TYPE))
    ).drop("_h1", "_h2", "_best")


def classify_taxonomy(
    items: DataFrame,
    entries: DataFrame,
    search_text: Col,
    limit: int = 10,
    choices: DataFrame | None = None,
    item_key: str = "ean",
) -> DataFrame:
    """Add ``taxonomy`` and the resolved levels.

    An exact path has confidence 1; no candidate 0; otherwise the best candidate is taken with
    0.35. ``choices`` optionally holds ``(item_key, choice, confidence, rationale)`` decided
    outside: a choice among the item's candidates replaces the best one, an unknown id falls
    back to the best one.
    """
    exact = taxonomy_exact(items, entries)
    scored = taxonomy_candidates(exact, entries, search_text, limit, where=F.col("exact_entry_no").isNull())
    best = F.get("candidates", F.lit(0))["entry_no"]
    if choices is not None:
        picked = choices.join(
            entries.select(F.col("taxonomy_id").alias("choice"), F.col("entry_no").alias("_chosen")), "choice", "left"
        ).select(item_key, "_chosen", F.col("confidence").alias("_confidence"), F.col("rationale").alias("_rationale"),
                 F.lit(True).alias("_asked"))
        scored = scored.join(picked, item_key, "left")
        among = F.exists("candidates", lambda c: c["entry_no"] == F.col("_chosen"))
        best = F.when(among, F.col("_chosen")).otherwise(best)
    scored = computed_once(scored, _best=best)
    best = F.col("_best")
    has_choice = F.lit(False)
    if choices is not None:
        has_choice = F.coalesce(F.col("_asked"), F.lit(False)) & best.isNotNull()
    is_exact = F.col("exact_entry_no").isNotNull()
    selected = scored.withColumn("_selected", F.coalesce(F.col("exact_entry_no"), best))
    source = (
        F.when(is_exact, SOURCE_EXACT).when(has_choice, SOURCE_CHOICE).when(best.isNotNull(), SOURCE_BEST)
    ).otherwise(SOURCE_NONE)
    confidence = F.when(is_exact, CONFIDENCE_EXACT)
    if choices is not None:
        confidence = confidence.when(has_choice, F.coalesce(F.col("_confidence"), F.lit(0.0)))
    confidence = confidence.when(best.isNotNull(), CONFIDENCE_BEST).otherwise(CONFIDENCE_NONE)
    tagged = selected.withColumn(
        "taxonomy",
        F.struct(
            source.alias("source"),
            confidence.cast("double").alias("confidence"),
            F.when(is_exact, 1).otherwise(F.size("candidates")).alias("candidate_count"),
            (F.when(has_choice, F.col("_rationale")) if choices is not None else F.lit(None).cast("string")).alias("rationale"),
        ),
    )
    levels = entries.select(
        F.col("entry_no").alias("_entry"),
        F.col("taxonomy_id").alias("selected_id"),
        *[F.col(level).alias(f"_t_{level}") for level in LEVELS],
    )
    placed = tagged.join(levels, F.col("_selected") == F.col("_entry"), "left")
    resolved = {
        # a selected entry replaces the item's levels, blanks included
        level: F.when(F.col("_entry").isNotNull(), F.col(f"_t_{level}")).otherwise(first_non_blank(level))
        for level in LEVELS
    }
    return placed.withColumns(resolved).drop(
        "_selected", "_best", "_entry", "_chosen", "_confidence", "_rationale", "_asked", *[f"_t_{level}" for level in LEVELS]
    )
