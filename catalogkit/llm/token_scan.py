"""Token counts of the documents in flat token files, found by scanning for their end marks.

A flat file is one run of little-endian token ids, every document followed by the end-of-document id,
with no index beside it. Files are cut into blocks, every task reads and searches its own blocks, and a running
maximum over the blocks of a file tells where the document began that runs into a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalogkit.llm.textbytes import chunks
from catalogkit.llm.tokens import worker_tokens
from catalogkit.session import new_work_path

BLOCK_TOKENS = 1 << 19
#: One task reads about so many bytes.
TASK_BYTES = 1 << 25
#: Documents per written file: about 10 MB of ids at common lengths. Longer documents make larger files, which are read in ranges.
DOCUMENTS_PER_FILE = 4000


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", documents: int = DOCUMENTS_PER_FILE
) -> None:
    """Write the token ids of all documents as flat files of 16-bit ids; null texts are empty documents.

    Repeated rows are documents each; long texts are encoded whole; other columns are not read; an empty table makes files without ids.

    The files' only structure is the end mark. Spark's text writer puts its line separator after every
    row; with the mark as separator and the ids' bytes as row, what it writes is the flat file. Names of
    special tokens inside a text are ordinary text, so no document contains the mark.
    """
    if not 0x100 <= end_id < 1 << 16:
        raise ValueError("ids of 16 bits, with an end mark of two bytes")

    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = worker_tokens(tokenizer, "text")
        for column in columns:
            parts: list[bytes] = []
            for low, end, _, _ in chunks(column):
                ids, offsets = tokens.ids(column.slice(low, end - low).to_pylist())
                data = ids.astype("<u2").tobytes()
                parts += [data[2 * a : 2 * b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.array(parts, pa.binary())

    # a cast from binary to string keeps the bytes as they are
    rows = docs.select(F.arrow_udf(encode, "binary")(F.col(text)).cast("string").alias("value"))
    mark = end_id.to_bytes(2, "little").decode("latin-1")
    writer = rows.write.option("maxRecordsPerFile", documents).option("lineSep", mark).option("encoding", "ISO-8859-1")
    writer.text(path)


def open_file(path: str) -> pa.NativeFile:
    """Open a file, named as Spark names it, for reads at any place; an error if Arrow does not know its store."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    authority, _, tail = rest.removeprefix("//").partition("/")
    system, root = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return system.open_input_file(f"{root.rstrip('/')}/{tail}")


#: Stores whose files Arrow opens for reads at any place.
RANGE_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
#: Blocks that are numbered together; the running figures of a file then go over these groups.
GROUP = 4096


def _block_order(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """Per block (``path, block, here, last``): ``before``, the marks before it, ``open_from``, the place after the last of
    those, and ``final``, whether it is its file's last block."""
    grouped = blocks.withColumn("g", F.floor(F.col("block") / group))
    sums = grouped.groupBy("path", "g").agg(F.sum("here").alias("g_here"), F.max("last").alias("g_last"), F.max("block").alias("g_block"))
    earlier = Window.partitionBy("path").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "path", "g", F.sum("g_here").over(earlier).alias("g_before"), F.max("g_last").over(earlier).alias("g_open"),
        F.max("g_block").over(file).alias("most"),
    )
    within = Window.partitionBy("path", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.select("path", "g", "block", F.sum("here").over(within).alias("b_before"), F.max("last").over(within).alias("b_open"))
    return placed.join(sums, ["path", "g"]).select(
        "path", "block", (F.coalesce("b_before", F.lit(0)) + F.coalesce("g_before", F.lit(0))).alias("before"),
        (F.coalesce("b_open", "g_open", F.lit(-1)) + 1).alias("open_from"), (F.col("block") == F.col("most")).alias("final"),
    )


def token_counts(
    spark: SparkSession, path: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, glob: str = "*"
) -> DataFrame:
    """One row per document of the flat files under ``path``: ``path, file, doc_no, start, n_tokens, ended``.

    ``path`` is the file's whole path, ``file`` its last part; files of equal name in several folders are kept apart.
    ``start`` is the place of its first id in the file; the end mark does not count. Two marks in a row are an
    empty document. Ids after a file's last mark are a document with ``ended`` false; bytes short of a whole id are
    ignored. Empty files have no documents, and no document runs from one file into the next.

    Every task opens the files and reads its own blocks, so a file may have any size; errors of the store come through. The
    store's scheme decides: in one that is not among ``RANGE_SCHEMES`` (``viewfs``, say), Spark reads each file as one row
    instead: one task holds a whole file there, and one over ``spark.sql.sources.binaryFile.maxLength`` (2 GB) is an error.
    Marks stay with their blocks; only a few numbers per block are put in order, ``GROUP`` blocks at a time and then group by group.
    """
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    step = block_tokens * width
    # paths and lengths come from the listing; contents are read only where they are named
    listed = files.agg(F.collect_set(F.split_part("path", F.lit(":"), F.lit(1))).alias("schemes"), F.sum("length").alias("bytes")).first()
    in_ranges = set(listed["schemes"]) <= set(RANGE_SCHEMES)
    # a partial id at the end of a file is cut off
    size = F.expr(f"length - length % {width}")
    begins = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(step).cast("long")))
    if in_ranges:
        tasks = max(spark.sparkContext.defaultParallelism, -(-(listed["bytes"] or 0) // TASK_BYTES))
        blocks = files.select("path", size.alias("size"), F.posexplode(begins).alias("block", "at"))
        blocks = blocks.repartition(tasks, "path", "block").sortWithinPartitions("path", "block")
        what = F.struct("path", "at", F.least(F.lit(step), F.col("size") - F.col("at")).alias("length"))
    else:
        pieces = F.transform(begins, lambda at: F.substring("content", (at + 1).cast("int"), F.least(F.lit(step), size - at).cast("int")))
        blocks = files.select("path", F.posexplode(pieces).alias("block", "bytes"))
        what = F.col("bytes")
    blocks = blocks.select("path", "block", what.alias("what"))

    def contents(column: pa.Array) -> Iterator[bytes | pa.Buffer]:
        if not in_ranges:
            yield from (value.as_buffer() for value in column)
            return
        path, opened = None, None
        for row in column.to_pylist():
            if row["path"] != path:
                if opened:
                    opened.close()
                path, opened = row["path"], open_file(row["path"])
            data = opened.read_at(row["length"], row["at"])
            if len(data) < row["length"]:
                raise OSError(f"{path} ends before {row['at'] + row['length']}")
            yield data
        if opened:
            opened.close()

    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found, lengths = [], []
            for data in contents(column):
                ids = np.frombuffer(data, dtype)
                found.append(np.flatnonzero(ids == end_id))
                lengths.append(len(ids))
            yield pa.StructArray.from_arrays(
                [pa.array(found, pa.list_(pa.int64())), pa.array(lengths, pa.int64())], ["marks", "n"]
            )

    found = blocks.select(
        "path", "block", F.arrow_udf(search, "marks array<long>, n long")(F.col("what")).alias("s")
    ).select("path", "block", "s.marks", "s.n")
    stored_at = new_work_path(spark, "marks")
    found.write.parquet(stored_at)
    scanned = spark.read.parquet(stored_at)
    base = F.col("block").cast("long") * block_tokens
    order = _block_order(scanned.select(
        "path", "block", F.size("marks").cast("long").alias("here"),
        F.when(F.size("marks") > 0, base + F.element_at("marks", -1)).alias("last"),
    ))
    stitched = scanned.join(order, ["path", "block"]).select(
        "path", "open_from", "before", F.transform("marks", lambda m: m + base).alias("marks"),
        (base + F.col("n")).alias("upto"), "final",
    )
    starts = F.concat(F.array("open_from"), F.transform("marks", lambda m: m + 1))
    ends = F.concat("marks", F.when(F.col("final"), F.array("upto")).otherwise(F.array().cast("array<bigint>")))
    docs = stitched.select(
        "path", "before", F.size("marks").alias("n"),
        F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("a"), ends.alias("b"))).alias("at", "d"),
    )
    ended = F.col("at") < F.col("n")
    return docs.filter(ended | (F.col("d.b") > F.col("d.a"))).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("before") + F.col("at")).cast("long").alias("doc_no"),
        F.col("d.a").alias("start"),
        (F.col("d.b") - F.col("d.a")).alias("n_tokens"),
        ended.alias("ended"),
    )
