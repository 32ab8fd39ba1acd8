"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogkit.session import new_work_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed value: the end-of-text id of the word vocabulary.
END_OF_TEXT = 49407


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the SQL with the same rows."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Where the public word vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_slack_packing")
def op7_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4,096 tokens."""
    from catalogkit.llm.slack_packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), word_tokenizer())


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark item in every document."""
    from catalogkit.llm.decontaminate import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_simhash_ring")
def op4_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from catalogkit.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op9_ppm_language")
def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; two thirds of the labelled documents may teach."""
    from catalogkit.llm.ppm_language import fit_languages, predict_languages
    from catalogkit.llm.sampling import held_out

    docs = read(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_languages(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


_OP8_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents),
trimmed as (
  select doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as l from lines),
w as (
  select doc_id, pos, l, lead(l) over o as l2, lead(l, 2) over o as l3 from trimmed
  window o as (partition by doc_id order by pos)),
windows as (
  select doc_id, pos, l || chr(10) || l2 || chr(10) || l3 as k from w
  where l3 is not null and l || l2 || l3 <> ''),
later as (
  select doc_id, pos from (
    select doc_id, pos, row_number() over (partition by k order by doc_id, pos) as n from windows) where n > 1),
covered as (
  select distinct doc_id, pos + d as pos from later, (values (0), (1), (2)) as t(d)),
kept as (
  select doc_id, count(*) as n, string_agg(line, chr(10) order by pos) as text
  from lines anti join covered using (doc_id, pos) group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) as n_lines,
  cast(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) as bigint) as n_removed,
  case when d.text is not null then coalesce(k.text, '') end as text
from documents d left join kept k using (doc_id)
"""


@query("op8_line_windows", _OP8_SQL)
def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the three-line windows that stood before it or earlier in it."""
    from catalogkit.llm.line_windows import remove_repeated_lines

    docs = remove_repeated_lines(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


@query("op2_subword_quality")
def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; two thirds of the labelled documents may teach."""
    from catalogkit.llm.quality_embedding import fit_quality, score_quality
    from catalogkit.llm.sampling import held_out

    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs.filter(~held_out()), read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op3_line_crf")
def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and content verdict of every document; two thirds of the labelled documents may teach."""
    from catalogkit.llm.line_crf import fit_lines, line_quality
    from catalogkit.llm.sampling import held_out

    docs = read(spark, sf_dir, "documents")
    field = fit_lines(docs.filter(~held_out()), read(spark, sf_dir, "labels"))
    return line_quality(docs, field).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "content_share",
    )


@query("op1_shard_table")
def op1_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed on one of 64 shards."""
    from catalogkit.llm.shard_table import place_rows

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    shards = [f"shard-{n:03d}" for n in range(64)]
    placed = place_rows(docs, ["doc_id"], shards, without_key=["text"])
    return placed.select("doc_id", "slot", "shard", F.length("text").alias("n_chars"))


@query("op10_separator_scan")
def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as flat token files, and the token count of each document in them."""
    from catalogkit.llm.token_scan import token_counts, write_token_files

    path = new_work_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path, word_tokenizer(), END_OF_TEXT)
    return token_counts(spark, path, END_OF_TEXT, glob="part-*")


@query("op6_secret_forest")
def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate in every document with the forest's verdict; planted controls teach."""
    from catalogkit.llm.secret_forest import scan_secrets

    return scan_secrets(read(spark, sf_dir, "documents"), path="source")


@query("op12_lockstep_align")
def op12_lockstep_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public vocabularies over every document."""
    import public_tokenizers

    from catalogkit.llm.lockstep_align import rate_links

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return rate_links(read(spark, sf_dir, "documents"), *paths)


@query("op13_grammar_repair")
def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged in known ways, with its faults and its cheapest repair."""
    from catalogkit.llm.conversation_repair import damage, repair

    conversations = read(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations)


@query("op11_bucket_refinement")
def op11_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that also start elsewhere."""
    from catalogkit.llm.suffix_buckets import remove_repeats

    cut = remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
