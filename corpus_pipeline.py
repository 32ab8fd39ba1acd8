"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogkit.llm.queries import read, word_tokenizer
from catalogkit.session import new_work_path


#: Texts of an Arrow batch: the JVM and a worker each hold a batch and its copies, besides what a stage itself needs.
BATCH_TEXTS = 2000
#: Words that a packing worker keeps and bytes of text that it encodes at once, besides what the stages before have left in it.
PACK_WORDS, PACK_BYTES = 150_000, 1 << 18
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_TEXTS`` rows to a worker at once; a smaller setting stays."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_TEXTS:
        spark.conf.set(_BATCH, str(BATCH_TEXTS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text in a language that the labelled documents teach.

    Null and empty texts and texts without a letter go; long texts are scored whole; repeated rows are judged alike;
    all columns stay. A table without labelled texts teaches nothing, and nothing is kept.
    """
    bounded_batches(spark)
    from catalogkit.llm.ppm_language import fit_languages, keep_known_languages
    from catalogkit.llm.sampling import held_out

    return keep_known_languages(docs, fit_languages(docs.filter(~held_out())))


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut three-line windows that stood earlier; a document of which nothing is left goes.

    ``n_chars``, where there is such a column, is counted anew for texts that were cut. Null texts and texts of fewer lines
    stay as they are; rows equal in id and text come out alike.
    """
    from catalogkit.llm.line_windows import remove_repeated_lines

    lines, removed = _fresh(docs, "_n_lines"), _fresh(docs, "_n_removed")
    cut = remove_repeated_lines(docs, n_lines=lines, n_removed=removed)
    left = cut.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\s]"))
    if "n_chars" in docs.columns:
        count = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return left.select(*[f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Nulls, ties, repeats and texts without a word are handled as in ``first_of_near_copies``.
    """
    bounded_batches(spark)
    from catalogkit.llm.near_copies import first_of_near_copies

    return first_of_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words are benchmark text; null and empty texts stay."""
    bounded_batches(spark)
    from catalogkit.llm.decontaminate import remove_contaminated

    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in a training sequence; null and empty texts are one end mark, repeated rows have places each."""
    bounded_batches(spark)
    from catalogkit.llm.slack_packing import pack_documents

    return pack_documents(docs, word_tokenizer(), max_pieces=PACK_WORDS, slice_bytes=PACK_BYTES)


STAGES = [
    ("language", known_language),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_copies),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# language models and packing by subset sums have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are stored before the next reads them.

    Rows are told apart as each stage states; an empty table goes through and gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
