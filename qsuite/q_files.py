"""Files written from the tables and read back through the file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators.ordering import with_row_number
from catalogkit.operators.waterfall import lookup_waterfall, register_lookups
from catalogkit.session import new_work_path
from catalogkit.sinks.files import export_csv, write_snapshot
from catalogkit.sources.files import TAXONOMY_COUNT, TAXONOMY_HEADER, read_items_csv, read_items_json, read_products_payload, read_taxonomy
from catalogkit.sources.normalize import SourceRegistry, normalize_erp_b, normalize_packages
from qsuite import views as v
from qsuite.q_catalog import UPSERT_SQL, upserted
from qsuite.q_enrich import SOURCES, WATERFALL_SQL, keys
from qsuite.registry import query

_PART_ITEMS = """select case when p_partkey % 9 = 0 then null else cast(p_partkey as varchar) end as ean,
  'Item "' || p_name || '", ' || p_brand || chr(10) || p_type as received_name, '{0}' as source from part"""


def part_items(spark, d):
    key = F.col("p_partkey")
    return v.table(spark, d, "part").select(
        key.cast("string").alias("id"),
        F.when(key % 9 == 0, "NULL").otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).alias("codigobarras"),
        F.concat(F.lit('Item "'), F.col("p_name"), F.lit('", '), F.col("p_brand"), F.lit("\n"), F.col("p_type")).alias("descricao"))


@query("read_items_csv", _PART_ITEMS.format("csv"))
def read_items_csv_q(spark, d):
    path = new_work_path(spark, "items-csv")
    export_csv(part_items(spark, d), path)
    return read_items_csv(spark, path).select("ean", "received_name", "source")


@query("read_items_json", _PART_ITEMS.format("json"))
def read_items_json_q(spark, d):
    path = new_work_path(spark, "items-json")
    part_items(spark, d).write.json(path)
    return read_items_json(spark, path, multi_line=False).select("ean", "received_name", "source")


@query(
    "read_products_payload",
    "select cast(p_partkey as varchar) as ean, p_name as description from part",
)
def read_products_payload_q(spark, d):
    path = new_work_path(spark, "products-json")
    p = v.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 50).alias("request"), F.struct(F.col("p_partkey").cast("string").alias("ean"), F.col("p_name").alias("descricaoProduto")).alias("p"))
    wrapped = p.groupBy("request").agg(F.collect_list("p").alias("products")).drop("request")
    wrapped.write.json(path)
    return read_products_payload(spark, path, multi_line=False).select("ean", F.col("descricaoProduto").alias("description"))


@query(
    "read_taxonomy",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL) + "select path, item_count, department, subsegment from taxonomy",
)
def read_taxonomy_q(spark, d):
    path = new_work_path(spark, "taxonomy-csv")
    levels = ["department", "category", "subcategory", "segment", "subsegment"]
    t = v.taxonomy(spark, d)
    named = t.orderBy("entry_no").select(*[F.col(c).alias(n) for c, n in zip(levels, TAXONOMY_HEADER)], F.col("item_count").alias(TAXONOMY_COUNT))
    named.write.csv(path, header=True, sep=";")
    return read_taxonomy(spark, path).select("path", "item_count", "department", "subsegment")


@query(
    "export_csv",
    v.ctes(v.CATALOG_SQL) + "select row_number() over (order by ean) as row_no, ean, 'q\"' || description || '\", x' as description, active_ingredient from catalog",
)
def export_csv_q(spark, d):
    path = new_work_path(spark, "export-csv")
    shown = F.concat(F.lit('q"'), F.col("description"), F.lit('", x')).alias("description")
    export_csv(v.catalog(spark, d).select("ean", shown, "active_ingredient"), path, "ean")
    # rows as they stand in the files, in the files' order
    rows = spark.read.csv(path, header=True, escape='"', schema="ean string, description string, active_ingredient string")
    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("at"))
    numbered = with_row_number(placed, ["file", "block", "at"], "row_no")
    return numbered.select(F.col("row_no").cast("long"), "ean", "description", "active_ingredient")


@query("write_snapshot", v.ctes(v.CATALOG_SQL, UPSERT_SQL) + "select ean, description, price from merged")
def write_snapshot_q(spark, d):
    path = new_work_path(spark, "catalog")
    write_snapshot(upserted(spark, d).select("ean", "description", "price"), path)
    return spark.read.parquet(path)


@query(
    "register_source",
    """select cast(p_partkey as varchar) as ean, 'erp_b' as source from part where p_partkey % 3 <> 0
    union all select cast(s_suppkey as varchar), 'client_table' from supplier""",
)
def register_source_q(spark, d):
    registry = SourceRegistry().register_source("ERP_B", normalize_erp_b).register_source("client", normalize_packages)
    parts = v.table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey").cast("string")).alias("codigoBarras"), F.col("p_name").alias("descricao"))
    suppliers = v.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ean"), F.col("s_name").alias("name"))
    a, b = registry.normalize("erp_b", parts), registry.normalize("client", suppliers)
    return a.select("ean", "source").unionByName(b.select("ean", "source"))


@query(
    "register_lookup",
    v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, WATERFALL_SQL) + "select ean, resolved_by from asked",
)
def register_lookup_q(spark, d):
    all_answers = v.lookups(spark, d)
    # registered in reverse: the priorities bring back the order
    own = lambda s: all_answers.filter(F.col("source_key") == s).drop("source_key")
    registered = {f" {s.upper()} ": (own(s), i) for i, s in reversed(list(enumerate(SOURCES)))}
    merged, order = register_lookups(registered)
    return lookup_waterfall(keys(spark, d), merged, order).select("ean", "resolved_by")
