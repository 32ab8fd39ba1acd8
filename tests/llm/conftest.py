"""Small tables with every awkward row, shared by the operators' tests."""

import random

import pytest

WORDS = "alpha beta gamma delta omega river stone cloud green quiet sound paper light house north".split()


def prose(seed: int, n: int = 80, per_line: int = 9) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) + "." for k in range(0, n, per_line))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows."""
    rows = [(n, prose(n), "en" if n % 2 else "fr", f"src{n % 3}", 1) for n in range(12)]
    rows += [(20, None, "en", None, None), (21, "", None, "src0", 0), (22, " \t\n ", "en", "src0", 4)]
    rows += [(23, "!!! ??? 123", "en", "src0", 11), (None, prose(3), None, None, None), (None, None, None, None, None)]
    rows += [(24, prose(99, 60_000), "fr", "src1", None), (25, "x" * 50_000, "en", "src1", 50_000)]
    rows += [(26, "日本語の文章 élan Ñandú ß ￿ 😀 test", "fr", "src1", 3), (27, "a", "en", "s", 1), (28, "A\x00b\x1cc", "en", "s", 1)]
    rows += [(30, prose(1), "en", "src1", 1), (31, prose(2) + " tail", "fr", "src2", 1)]
    rows += [(5, prose(5), "en", "src2", 1)]  # the same row again
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like those that operators use inside or return."""
    from pyspark.sql import functions as F

    names = "_text _key _row _rank _n _r1 _r2 _gaps _tail key row doc root lang_pred label score predicted shard slot kept fp a b h1 pos piece length n_lines n"
    return docs.select("*", *[F.lit("x").alias(n) for n in dict.fromkeys(names.split())])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
