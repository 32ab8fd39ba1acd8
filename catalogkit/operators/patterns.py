"""Many words at once: an automaton over a whole dictionary, in one pass over each text."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of all patterns together; the automaton takes some hundred bytes for each and is built in every worker.
MAX_CHARACTERS = 2_000_000


def _automaton(words: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for n, word in enumerate(words):
        made.add_word(word, n)
    if words:
        made.make_automaton()
    return made


def pattern_hits(text: Column | str, words: list[str], whole: bool = True) -> Column:
    """``array<struct<pattern: int, n: int>>``: which of ``words`` the text holds and how often, by their place in the list.

    With ``whole``, a hit has no letter or digit beside it. Occurrences may overlap. Case counts: lower both sides first
    where it should not. Null texts have none; the dictionary is bounded by ``MAX_CHARACTERS``.
    """
    if sum(map(len, words)) > MAX_CHARACTERS:
        raise ValueError("the dictionary is too large for one automaton")
    if len(set(words)) < len(words) or "" in words:
        raise ValueError("patterns are distinct and not empty")
    sizes = [len(w) for w in words]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(words)
        for column in columns:
            # four bytes a number; a text is brought to Python when its turn comes
            ends, found, often = array("i", [0]), array("i"), array("i")
            for text in column:
                value = text.as_py()
                counts: dict[int, int] = {}
                if value and words:
                    last = len(value) - 1
                    for end, n in automaton.iter(value):
                        start = end - sizes[n]
                        if whole and ((start >= 0 and value[start].isalnum()) or (end < last and value[end + 1].isalnum())):
                            continue
                        counts[n] = counts.get(n, 0) + 1
                for k in sorted(counts):
                    found.append(k)
                    often.append(counts[k])
                ends.append(len(found))
            numbers, times, offsets = (np.frombuffer(a, np.int32) if a else np.empty(0, np.int32) for a in (found, often, ends))
            pairs = pa.StructArray.from_arrays([pa.array(numbers), pa.array(times)], ["pattern", "n"])
            yield pa.ListArray.from_arrays(pa.array(offsets), pairs)

    return F.arrow_udf(run, "array<struct<pattern:int,n:int>>")(text)


def dictionary_matches(rows: DataFrame, text: str, dictionary: DataFrame, word: str, whole: bool = True) -> DataFrame:
    """``rows`` with one row per word of ``dictionary`` that ``text`` holds: ``pattern`` and ``n``, how often.

    The dictionary's distinct words come to the driver and go to every worker; more than ``MAX_CHARACTERS`` are an error, found by
    a count before anything is brought together.
    """
    words = dictionary.select(F.col(word).alias("w")).filter("w is not null and w <> ''").distinct()
    size = words.agg(F.sum(F.length("w"))).first()[0] or 0
    if size > MAX_CHARACTERS:
        raise ValueError(f"a dictionary of {size} characters is too large for one automaton")
    listed = sorted(r[0] for r in words.collect())
    hits = rows.withColumn("_hits", pattern_hits(text, listed, whole))
    named = hits.select("*", F.inline("_hits").alias("_no", "n")).drop("_hits")
    table = rows.sparkSession.createDataFrame(list(enumerate(listed)), "_no int, pattern string")
    # at most MAX_CHARACTERS rows, a few megabytes
    return named.join(F.broadcast(table), "_no").drop("_no")
