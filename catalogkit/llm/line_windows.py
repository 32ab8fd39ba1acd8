"""Line de-duplication by overlapping windows of consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogkit.session import cut_lineage

SIZE = 3
#: White space that may surround a line without changing it.
_BLANK = " \t\x0b\x0c\r"


def _identity(key: str, text: str) -> list[Column]:
    """128 bits that name a row; rows equal in key and text are one document."""
    named = [F.col(key), F.col(text)]
    return [F.xxhash64(*named).alias("_r1"), F.xxhash64(F.lit("row"), *named).alias("_r2")]


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per window of ``size`` consecutive lines that are not all blank: its 128-bit hash and place."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(_BLANK)))
    split = docs.select(F.col(key).alias("_key"), *_identity(key, text), lines.alias("_lines"))

    def window(at: Column) -> Column:
        own = F.slice(F.col("_lines"), at + 1, size)
        some = F.exists(own, lambda line: line != "")
        return F.when(
            some, F.struct(at.alias("pos"), F.xxhash64(own).alias("h1"), F.xxhash64(F.lit("lines"), own).alias("h2"))
        )

    n = F.size("_lines")
    windows = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), window))
    return (
        split.select("_key", "_r1", "_r2", F.explode(windows).alias("w"))
        .filter("w is not null")
        .select("_key", "_r1", "_r2", "w.pos", "w.h1", "w.h2")
    )


def repeated_stretches(windows: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document, what lies between the stretches to remove: ``_gaps`` (start, length) and ``_tail``.

    Later occurrences of a repeated window cover ``size`` lines each; covered lines that touch or overlap
    merge. The occurrences of a document are walked through in order, and no list outgrows the document.
    """
    order = F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_r1"), F.col("_r2"), F.col("pos"))
    seen = windows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(seen, ["h1", "h2"]).filter(order > F.col("first")).select("_r1", "_r2", "pos").distinct()
    before = F.lag("pos").over(Window.partitionBy("_r1", "_r2").orderBy("pos"))
    later = later.withColumn("_from", F.coalesce(before + size, F.lit(0)))
    gap = F.when(F.col("pos") > F.col("_from"), F.struct(F.col("_from").alias("at"), (F.col("pos") - F.col("_from")).alias("n")))
    return later.groupBy("_r1", "_r2").agg(
        F.array_sort(F.collect_list(gap)).alias("_gaps"), (F.max("pos") + size).alias("_tail")
    )


def remove_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, n_lines: str = "n_lines",
    n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with repeated windows of lines cut from ``text``, and the columns ``n_lines`` and ``n_removed``.

    Lines end at ``\\n`` and are compared without surrounding white space; a window of blank lines only is
    no window. The first occurrence, by key (null last) and place, stays; every line inside a later
    occurrence goes, also within one document. A text may end up empty, but its row stays. Null texts stay
    null and texts of fewer than ``size`` lines stay as they are; null has no lines and the empty text has one.
    Rows equal in key and text are one document and come out alike. Long texts are cut whole: a row holds its lines at once. An empty
    table gives no rows. All columns of ``docs`` are kept; if
    one is named like a new column, the new one takes its place.
    """
    removed = repeated_stretches(cut_lineage(line_windows(docs, key, text, size)), size)
    columns = [c for c in docs.columns if c == text or c not in (n_lines, n_removed)]
    # the columns travel as one, so that names of ``docs`` meet none used here
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), *_identity(key, text))
    joined = whole.join(removed, ["_r1", "_r2"], "left").select("doc", "_gaps", "_tail")
    old = F.col("doc").getField(text)
    lines = F.split(old, "\n", -1)
    total = F.coalesce(F.size(lines), F.lit(0))
    total = F.when(old.isNull(), F.lit(0)).otherwise(total)
    tail = F.struct(F.col("_tail").alias("at"), F.greatest(F.size(lines) - F.col("_tail"), F.lit(0)).alias("n"))
    parts = F.filter(F.concat(F.col("_gaps"), F.array(tail)), lambda part: part["n"] > 0)
    left = F.array_join(F.flatten(F.transform(parts, lambda part: F.slice(lines, part["at"] + 1, part["n"]))), "\n")
    stay = F.aggregate(parts, F.lit(0), lambda n, part: n + part["n"])
    cut = F.col("_tail").isNotNull()
    return joined.select(
        *[F.when(cut, left).otherwise(old).alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in columns],
        total.cast("long").alias(n_lines),
        F.when(cut, total - stay).otherwise(0).cast("long").alias(n_removed),
    )
