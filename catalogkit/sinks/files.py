"""Writing exports and catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str, order: str | None = None, single_file: bool = False) -> None:
    """CSV with header, quotes doubled, null as empty, in ``order`` across the part files.

    ``single_file`` is for exports a person opens: one file that starts with a byte order mark.
    """
    ordered = df.orderBy(order) if order else df
    ordered = ordered.coalesce(1) if single_file else ordered
    marked = ordered.withColumnRenamed(ordered.columns[0], "﻿" + ordered.columns[0]) if single_file else ordered
    marked.write.mode("errorifexists").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file of rows."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a catalogue to a new path that the caller names; an existing one is an error.

    Readers take the path from the caller, who hands it on once the write has ended.
    """
    df.write.mode("errorifexists").parquet(path)
