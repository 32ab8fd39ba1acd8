"""Reading item, product and taxonomy files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from catalogkit.functions.values import field_type, optional_text
from catalogkit.operators.ordering import with_row_number
from catalogkit.operators.taxonomy import LEVELS, taxonomy_entries
from catalogkit.sources.normalize import canonical_item

# Header of a taxonomy file.
TAXONOMY_HEADER = ["Departamento", "Categoria", "Subcategoria", "Segmento", "Subsegmento"]
TAXONOMY_COUNT = "Qtd_Codigos_Barras"


def _csv(spark: SparkSession, path: str, sep: str, multi_line: bool) -> DataFrame:
    df = spark.read.csv(
        path,
        sep=sep,
        header=True,
        inferSchema=False,
        multiLine=multi_line,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_items_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header CSV to canonical items.

    ``multi_line`` allows line breaks inside quotes; turn it off for files without them, so
    that one large file is read by many tasks.
    """
    return canonical_item(_csv(spark, path, ",", multi_line), "csv")


def _records(df: DataFrame, *wrappers: str) -> DataFrame:
    """Rows of a payload that is an array, a wrapper object holding one, or a single record."""
    present = [w for w in wrappers if isinstance(field_type(df.schema, w), T.ArrayType)]
    if not present:
        return df
    inner = df.select(F.explode(F.coalesce(*[F.col(w) for w in present])).alias("_r")).select("_r.*")
    own = [c for c in df.columns if c not in wrappers]
    if not own:
        return inner
    bare = df.filter(F.coalesce(*[F.col(w) for w in present]).isNull()).select(*own)
    return inner.unionByName(bare, allowMissingColumns=True)


def read_items_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array, or ``{"items": […]}``, to canonical items.

    With ``multi_line`` off every line is one item, and large files are split.
    """
    return canonical_item(_records(spark.read.json(path, multiLine=multi_line), "items"), "json")


def read_products_payload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Product rows of an array, ``{products}``, ``{produtos}`` or a single product."""
    rows = _records(spark.read.json(path, multiLine=multi_line), "products", "produtos")
    if not {"description", "descricaoProduto"} & set(rows.columns):
        raise ValueError("Envie um produto unico ou um array em products ou produtos.")
    return rows


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy entries of ``;`` separated files, in file order; several files follow each other by name."""
    rows = _csv(spark, path, ";", True).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")
    )
    rows = with_row_number(rows, ["_file", "_at"], "entry_order")
    named = rows.select(
        *[optional_text(source).alias(level) for source, level in zip(TAXONOMY_HEADER, LEVELS)],
        F.col(TAXONOMY_COUNT).alias("item_count"),
        "entry_order",
    )
    return taxonomy_entries(named, "entry_order")


def read_jdbc_packages(spark: SparkSession, url: str, schema: str, partitions: int = 8, **options) -> DataFrame:
    """A client's package table, read in parallel by hash of its id."""
    parts = [f"mod(abs(id), {partitions}) = {i}" for i in range(partitions)]
    return spark.read.jdbc(url, f"{schema}.embalagem", predicates=parts, properties=options)


