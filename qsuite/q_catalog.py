"""Catalogue maintenance: sources, upserts, dimensions, paging and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators.ordering import chunk, export_slice, keyset_page, page, with_row_number
from catalogkit.plans.catalog import (
    assign_dimension_keys,
    catalog_columns,
    compare_sources,
    eligible_for_publish,
    extend_dimension,
    legacy_reconstruct,
    read_details,
    reprocess,
    upsert_catalog,
    validate_products,
    with_search_columns,
)
from catalogkit.sinks.publish import publish_payload
from catalogkit.sinks.routes import audit_mirror, review_sink
from catalogkit.sources.normalize import (
    canonical_item,
    count_packages,
    explode_product_skus,
    feed_predicate,
    normalize_packages,
    normalize_stock_a,
    normalize_stock_b,
    normalize_stock_c,
    read_packages,
    select_feed_columns,
    spec_value,
)
from catalogkit.operators.namejoin import similar_names
from catalogkit.plans.bucketed import upsert_bucketed, write_bucketed
from catalogkit.session import new_work_path
from qsuite import views as v
from qsuite.registry import query

# -- S: sources ----------------------------------------------------------------------------


@query(
    "canonical_item",
    """select cast(p_partkey as varchar) as ean, case when p_partkey % 9 = 0 then null else trim(p_name) end as received_name, 'part_table' as source,
      '{"codigo_barras":"' || case when p_partkey % 5 = 0 then 'NULL' else cast(p_partkey as varchar) end || '","codigo":"' || p_partkey || '"'
        || case when p_partkey % 9 = 0 then ',"nome":" null "' else ',"nome":"' || p_name || ' "' end || '}' as raw from part
    union all
    select cast(s_suppkey as varchar), s_name, 'supplier_table', '{"ean":"' || s_suppkey || '","description":"' || s_name || '"}' from supplier""",
)
def canonical_item_q(spark, d):
    text = F.col("p_partkey").cast("string")
    parts = v.table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, "NULL").otherwise(text).alias("codigo_barras"),
        text.alias("codigo"),
        F.when(F.col("p_partkey") % 9 == 0, " null ").otherwise(F.concat("p_name", F.lit(" "))).alias("nome"),
    )
    suppliers = v.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("ean"), F.col("s_name").alias("description"))
    return canonical_item(parts, "part_table").unionByName(canonical_item(suppliers, "supplier_table"))


PACKAGES_SQL = """packages as (
  select case when l_partkey % 10 = 0 then ' ' else cast(l_partkey as varchar) end as codigobarras,
    case when l_suppkey % 4 = 0 then null else 'pack ' || l_suppkey end as descricao,
    l_orderkey * 10 + l_linenumber as id from lineitem
), picked as (
  select distinct on (codigobarras) codigobarras as ean, descricao as name from packages
  where trim(codigobarras) <> '' and trim(descricao) <> '' order by codigobarras, descricao, id
)"""


def packages(spark, d):
    l = v.table(spark, d, "lineitem")
    return l.select(
        F.when(F.col("l_partkey") % 10 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("codigobarras"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("pack "), F.col("l_suppkey").cast("string"))).alias("descricao"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


@query("read_packages", v.ctes(PACKAGES_SQL) + "select * from picked")
def read_packages_q(spark, d):
    return read_packages(packages(spark, d))


@query("read_packages_page", v.ctes(PACKAGES_SQL) + "select * from picked order by ean limit 30 offset 20")
def read_packages_page_q(spark, d):
    return read_packages(packages(spark, d), top=30, skip=20)


@query("count_packages", v.ctes(PACKAGES_SQL) + "select count(*) as total from picked")
def count_packages_q(spark, d):
    return count_packages(packages(spark, d))


@query(
    "normalize_packages",
    """select cast(p_partkey as varchar) as ean, p_name as received_name, 'client_table' as source, p_name as display_name
    from part where p_partkey % 6 <> 0 and p_partkey % 4 <> 0""",
)
def normalize_packages_q(spark, d):
    rows = v.table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(" ").alias("ean"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat("p_name", F.lit(" "))).alias("name"),
    )
    return normalize_packages(rows).select("ean", "received_name", "source", "raw.display_name")


@query(
    "explode_product_skus",
    """select distinct l_orderkey % 50 as bucket, cast(l_partkey as varchar) as product_id, cast(l_suppkey as varchar) as sku_id
    from lineitem where l_suppkey % 3 <> 0""",
)
def explode_product_skus_q(spark, d):
    l = v.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("bucket"), F.col("l_partkey").cast("string").alias("p"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).otherwise("").alias("s"))
    lists = l.distinct().groupBy("bucket", "p").agg(F.collect_list("s").alias("skus"))
    maps = lists.select("bucket", F.create_map("p", "skus").alias("m"))
    return explode_product_skus(maps, "m", ["bucket"])


@query(
    "spec_value",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'R' and l_linestatus = 'F' then null
      when l_returnflag = 'R' then l_linestatus else l_returnflag end as spec from lineitem""",
)
def spec_value_q(spark, d):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    entry = lambda name, values: F.struct(F.lit(name).alias("FieldName"), values.alias("FieldValues"))
    specs = F.array(
        entry("Other", F.array(F.lit("x"))),
        entry(" Código MS ", F.array(F.lit(" "), F.when(flag == "R", "").otherwise(flag))),
        entry("RMS", F.array(F.when(line == "F", "  ").otherwise(line))),
    )
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", spec_value(specs, ["código ms", "rms"]).alias("spec"))


def erp_rows(spark, d):
    l = v.table(spark, d, "lineitem")
    return l.select(
        F.col("l_suppkey").cast("int").alias("cdFilial"),
        F.col("l_partkey").cast("string").alias("cdProduto"),
        F.when(F.col("l_partkey") % 8 == 0, "").when(F.col("l_partkey") % 9 != 0, F.col("l_partkey").cast("string")).alias("codigoBarras"),
        (F.col("l_returnflag") == "R").alias("inativo"),
        F.col("l_quantity").alias("qtdEstoque"),
        F.col("l_extendedprice").alias("vlrTabela"),
        F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("vlrOferta"),
        F.col("l_tax").alias("percDesconto"),
        F.col("l_shipdate").alias("not_in_the_feed"),
    )


@query(
    "feed_predicate",
    """select cast(l_suppkey as integer) as "cdFilial", cast(l_partkey as varchar) as "cdProduto", l_quantity as "qtdEstoque" from lineitem
    where l_returnflag <> 'R' and l_partkey % 8 <> 0 and l_partkey % 9 <> 0 and l_quantity > 10 and l_suppkey = 3""",
)
def feed_predicate_q(spark, d):
    return feed_predicate(erp_rows(spark, d), "qtdEstoque > 10", 3).select("cdFilial", "cdProduto", "qtdEstoque")


@query(
    "select_feed_columns",
    """select cast(l_suppkey as integer) as "cdFilial", cast(l_partkey as varchar) as "cdProduto",
      case when l_partkey % 8 = 0 then '' when l_partkey % 9 <> 0 then cast(l_partkey as varchar) end as "codigoBarras",
      l_returnflag = 'R' as inativo, l_quantity as "qtdEstoque", l_extendedprice as "vlrTabela", l_tax as "percDesconto",
      case when l_discount > 0.03 then l_extendedprice * (1 - l_discount) end as "vlrOferta" from lineitem""",
)
def select_feed_columns_q(spark, d):
    return select_feed_columns(erp_rows(spark, d))


@query(
    "normalize_stock_a",
    """select l_orderkey, l_linenumber, l_partkey, 'erp_a' as source, cast(l_partkey as varchar) as id, cast(l_partkey as varchar) as code,
      cast(l_suppkey as varchar) as branch, case when l_partkey % 8 = 0 then 'alt' || l_partkey else cast(l_partkey as varchar) end as ean,
      'line' as description, case when l_returnflag = 'R' then 0.0 else l_quantity end as stock, l_extendedprice as price,
      cast(null as double) as promo_price, l_tax as discount_pct, l_returnflag <> 'R' and l_quantity > 0 as available from lineitem""",
)
def normalize_stock_a_q(spark, d):
    l = v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_partkey").cast("string").alias("codigo"),
        F.col("l_suppkey").alias("cdFilial"),
        F.when(F.col("l_partkey") % 8 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("codigoBarras"),
        F.concat(F.lit("alt"), F.col("l_partkey").cast("string")).alias("ean"),
        F.lit("line").alias("nome"),
        F.lit("n/a").alias("quantidadeEstoqueEcommerce"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("string")).otherwise("none").alias("qtdEstoque"),
        F.lit("").alias("valorVenda"),
        F.col("l_extendedprice").alias("vlrTabela"),
        F.col("l_tax").alias("percDesconto"),
    )
    return normalize_stock_a(l, keep=["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "normalize_stock_b",
    """select l_orderkey, l_linenumber, l_partkey as part_no, 'erp_b' as source, cast(l_partkey as varchar) as id, cast(l_partkey as varchar) as code,
      cast(cast(l_suppkey as integer) as varchar) as branch, case when l_partkey % 8 <> 0 and l_partkey % 9 <> 0 then cast(l_partkey as varchar) end as ean,
      cast(null as varchar) as description, l_quantity as stock, l_extendedprice as price,
      case when l_discount > 0.03 then l_extendedprice * (1 - l_discount) end as promo_price, l_tax as discount_pct, l_quantity > 0 as available from lineitem""",
)
def normalize_stock_b_q(spark, d):
    keyed = v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").cast("int").alias("cdFilial"),
        F.when(F.col("l_partkey") != 0, F.col("l_partkey").cast("string")).otherwise("0 ").alias("cdProduto"),
        F.when(F.col("l_partkey") % 8 == 0, "").when(F.col("l_partkey") % 9 != 0, F.col("l_partkey").cast("string")).alias("codigoBarras"),
        F.col("l_quantity").alias("qtdEstoque"),
        F.col("l_extendedprice").alias("vlrTabela"),
        F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("vlrOferta"),
        F.col("l_tax").alias("percDesconto"),
    )
    made = normalize_stock_b(keyed, keep=["l_orderkey", "l_linenumber", "part_no"])
    return made.withColumns({"id": F.trim("id"), "code": F.trim("code")})


@query(
    "normalize_stock_c",
    v.ctes(v.FEED_SQL)
    + """select id as row_id, l_partkey, 'erp_c' as source, code as id, code, cast(null as varchar) as branch, ean, description,
      stock, price, case when promo_price > 0 and promo_price < price then promo_price end as promo_price,
      case when promo_price > 0 and promo_price < price then round((price - promo_price) / price * 100, 2) end as discount_pct, stock > 0 as available from feed""",
)
def normalize_stock_c_q(spark, d):
    f = v.feed(spark, d).select(
        F.col("id").alias("row_id"), "l_partkey",
        F.when(F.col("l_partkey") != 0, F.col("code")).otherwise("0 ").alias("codigo"),
        F.concat(F.substring("ean", 1, 4), F.lit("."), F.substring("ean", 5, 20)).alias("ean"), F.col("description").alias("nome"),
        F.col("stock").alias("estoque"), F.col("price").alias("valorVenda"), F.col("promo_price").alias("melhorDesconto"))
    made = normalize_stock_c(f, keep=["row_id", "l_partkey"])
    return made.withColumns({"id": F.trim("id"), "code": F.trim("code")})


# -- P: product records --------------------------------------------------------------------


@query(
    "validate_products",
    """select p_partkey, case when length(e) between 8 and 14 then e end as ean, trim(n) as description,
      case when n is null then 'Todo produto precisa ter o campo descricaoProduto.' when e = '' then 'Todo produto precisa ter o campo ean.'
        when length(e) not between 8 and 14 then 'O campo ean precisa ter entre 8 e 14 digitos.'
        when n = '!!' then 'Nao foi possivel gerar tokens a partir dos dados do produto.' end as error
    from (select p_partkey, case p_partkey % 6 when 0 then '' when 1 then '12' else '7890000' || p_partkey end as e,
      case p_partkey % 5 when 0 then null when 1 then '!!' else p_name end as n from part)""",
)
def validate_products_q(spark, d):
    key = F.col("p_partkey")
    rows = v.table(spark, d, "part").select(
        "p_partkey",
        F.when(key % 6 == 0, "").when(key % 6 == 1, "1-2").otherwise(F.concat(F.lit("789-0000"), key.cast("string"))).alias("ean"),
        F.when(key % 5 == 0, " ").when(key % 5 == 1, "!!").otherwise(F.concat("p_name", F.lit(" "))).alias("descricaoProduto"),
    )
    return validate_products(rows, ["p_partkey"]).select("p_partkey", "ean", "description", "error")


ELIGIBLE = "trim(active_ingredient) <> '' and classification <> 'NAO DEFINIDO'"


@query("eligible_for_publish", v.ctes(v.CATALOG_SQL) + f"select ean, description from catalog where {ELIGIBLE}")
def eligible_for_publish_q(spark, d):
    rows = v.catalog(spark, d).withColumn("details", F.lit("{}"))
    return eligible_for_publish(rows).select("ean", "description")


@query("eligible_for_publish_relaxed", v.ctes(v.CATALOG_SQL) + "select ean, description from catalog where p_partkey % 11 <> 0")
def eligible_relaxed_q(spark, d):
    rows = v.catalog(spark, d).withColumn("description", F.when(F.col("active_ingredient").isNotNull(), F.col("description")))
    return eligible_for_publish(rows, include_incomplete=True).select("ean", "description")


@query(
    "catalog_columns",
    """select case when p_partkey % 4 = 0 then p_name else null end as "nomeSocial", cast(p_partkey as varchar) as ean,
      case when p_partkey % 3 = 0 then p_type || '|' || p_brand when p_partkey % 3 = 1 then p_type end as parts from part""",
)
def catalog_columns_q(spark, d):
    key = F.col("p_partkey")
    rows = v.table(spark, d, "part").select(
        key.cast("string").alias("ean"),
        F.when(key % 4 == 0, F.col("p_name")).alias("social_name"),
        F.when(key % 3 == 0, F.concat("p_type", F.lit(" , "), F.col("p_brand"), F.lit(","))).when(key % 3 == 1, F.col("p_type")).alias("active_ingredient"),
    )
    made = catalog_columns(rows)
    return made.select("ean", "nomeSocial", F.array_join("principioAtivo", "|").alias("parts"))


@query(
    "read_details",
    """select p_partkey, case when p_partkey % 2 = 0 then p_type else p_brand end as department, p_name as category,
      cast(null as varchar) as subcategory from part""",
)
def read_details_q(spark, d):
    key = F.col("p_partkey")
    final = F.when(key % 2 == 0, F.struct(F.col("p_type").alias("departamento")))
    body = F.struct(final.alias("estrutura_final"), F.col("p_brand").alias("departamento"), F.col("p_name").alias("categoria"))
    rows = v.table(spark, d, "part").select("p_partkey", F.to_json(body).alias("details"))
    return read_details(rows).select("p_partkey", "department", "category", "subcategory")


# -- K, J: catalogue -----------------------------------------------------------------------

NOW = "timestamp '2024-06-01 00:00:00'"
UPSERT_SQL = """old as (select *, timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-02 00:00:00' as updated_at
  from catalog where p_partkey % 3 <> 0),
new as (select * from catalog where p_partkey % 2 = 0),
merged as (select coalesce(n.ean, o.ean) as ean, case when n.ean is null then o.description else upper(n.description) end as description,
  case when n.ean is null then o.price else n.price * 2 end as price,
  coalesce(o.created_at, timestamp '2024-06-01 00:00:00') as created_at,
  case when n.ean is null then o.updated_at else timestamp '2024-06-01 00:00:00' end as updated_at
  from old o full join new n on o.ean = n.ean)"""


def old_and_new(spark, d):
    columns = ["ean", "description", "price"]
    c = v.catalog(spark, d)
    old = c.filter(F.col("p_partkey") % 3 != 0).select(
        *columns, F.expr("timestamp '2024-01-01 00:00:00'").alias("created_at"), F.expr("timestamp '2024-01-02 00:00:00'").alias("updated_at"))
    new = c.filter(F.col("p_partkey") % 2 == 0)
    first = new.select(*columns, F.lit(1).alias("at"))
    last = new.select("ean", F.upper("description").alias("description"), (F.col("price") * 2).alias("price"), F.lit(2).alias("at"))
    return old, first.unionByName(last)


def upserted(spark, d):
    old, new = old_and_new(spark, d)
    return upsert_catalog(old, new, F.expr(NOW), position="at")


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"


@query(
    "upsert_catalog",
    v.ctes(v.CATALOG_SQL, UPSERT_SQL)
    + f"select ean, description, price, {STAMP.format('created_at')}, {STAMP.format('updated_at')} from merged",
)
def upsert_catalog_q(spark, d):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")}
    return upserted(spark, d).withColumns(shown)


@query(
    "upsert_bucketed",
    v.ctes(v.CATALOG_SQL, UPSERT_SQL)
    + f"select ean, description, price, {STAMP.format('created_at')}, {STAMP.format('updated_at')} from merged",
)
def upsert_bucketed_q(spark, d):
    """The same rows from a catalogue in buckets, of which only the touched ones are rewritten."""
    old, new = old_and_new(spark, d)
    catalog = write_bucketed(old, new_work_path(spark, "bucketed"), 16)
    upsert_bucketed(catalog, new, F.expr(NOW), "at")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")}
    return catalog.rows().withColumns(shown)


_UUID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"


def _uuid(name: str) -> str:
    return _UUID.replace("h,", f"sha256({name}),")


@query(
    "assign_dimension_keys",
    v.ctes(v.CATALOG_SQL)
    + ", known as (select distinct department as name, 'dept-' || department as id from catalog where department in ('SMALL', 'PROMO'))\n"
    + f"""select ean, coalesce(k.id, {_uuid('department')}) as department_id, {_uuid('category')} as category_id,
      case when subcategory is not null then {_uuid('subcategory')} end as subcategory_id,
      case when active_ingredient is not null then {_uuid('active_ingredient')} end as active_ingredient_id,
      {_uuid('segment')} as segment_id, case when subsegment is not null then {_uuid('subsegment')} end as subsegment_id
    from catalog left join known k on k.name = department""",
)
def assign_dimension_keys_q(spark, d):
    c = v.catalog(spark, d)
    known = c.filter(F.col("department").isin("SMALL", "PROMO")).select(
        F.col("department").alias("name"), F.concat(F.lit("dept-"), F.col("department")).alias("id")).distinct()
    ids = ["department_id", "category_id", "subcategory_id", "active_ingredient_id", "segment_id", "subsegment_id"]
    return assign_dimension_keys(c, {"department": known}).select("ean", *ids)


@query(
    "extend_dimension",
    v.ctes(v.CATALOG_SQL)
    + f"""select name, case when name < 'Brand#2' then 'old-' || name else {_uuid('name')} end as id
      from (select distinct manufacturer as name from catalog)""",
)
def extend_dimension_q(spark, d):
    c = v.catalog(spark, d)
    old = c.filter(F.col("manufacturer") < "Brand#2").select(
        F.col("manufacturer").alias("name"), F.concat(F.lit("old-"), F.col("manufacturer")).alias("id")).distinct()
    return extend_dimension(old, c, "manufacturer")


@query(
    "reprocess_catalog",
    v.ctes(v.CATALOG_SQL)
    + f""", texts as (select ean, concat_ws(' ', description, active_ingredient, description, active_ingredient, social_name, classification,
        manufacturer, department, category, subcategory, segment, subsegment) as t from catalog)
    select ean, {v.sql_search_norm('t')} as normalized_searchable_text, cast(len({v.sql_tokens('t')}) as integer) as token_count,
      cast(1.0 as double) as norm from texts""",
)
def reprocess_q(spark, d):
    made = reprocess(v.catalog(spark, d), F.current_timestamp(), 64)
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return made.select("ean", "normalized_searchable_text", "token_count", norm.alias("norm"))


@query(
    "save_products",
    v.ctes(v.CATALOG_SQL)
    + f""", texts as (select ean, department, concat_ws(' ', description, description, department, category) as t from catalog)
    select ean, department, {_uuid('department')} as department_id, cast(len({v.sql_tokens('t')}) as integer) as token_count from texts""",
)
def save_products_q(spark, d):
    payload = v.catalog(spark, d).select("ean", F.col("description").alias("descricaoProduto"), F.col("department").alias("departamento"),
                                         F.col("category").alias("categoria"))
    good = validate_products(payload).filter(F.col("error").isNull())
    ready = assign_dimension_keys(with_search_columns(good, 64))
    return ready.select("ean", "department", "department_id", "token_count")


@query(
    "legacy_reconstruct",
    """with drugs as (select l_partkey, string_agg(n, ', ' order by n) as active_ingredient from (
        select distinct l_partkey, s_name as n from lineitem join supplier on s_suppkey = l_suppkey where s_suppkey % 3 <> 0) group by 1)
    select l_orderkey || '-' || l_linenumber || '-' || l_suppkey as ean, 'row ' || l_orderkey as description, p_name as social_name,
      p_type as classification, p_brand as manufacturer, d.active_ingredient
    from lineitem l join part p on p_partkey = l.l_partkey join drugs d on d.l_partkey = p_partkey
    where l_quantity > 5 and p_type <> 'PROMO' and p_partkey % 2 = 0""",
)
def legacy_reconstruct_q(spark, d):
    l, p = v.table(spark, d, "lineitem"), v.table(spark, d, "part")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")])
    presentations = l.select(
        key.alias("ean"),
        F.when(F.col("l_quantity") > 5, F.concat(F.lit("row "), F.col("l_orderkey").cast("string"))).otherwise(" ").alias("display_name"),
        F.col("l_partkey").alias("product_id"))
    products = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("laboratory"),
        F.when(F.col("p_type") == "PROMO", "NAO DEFINIDO").otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("p_partkey") % 2 == 0, "trusted").otherwise("other").alias("name_source"))
    links = l.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("ingredient_id"))
    s = v.table(spark, d, "supplier")
    drugs = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise(" ").alias("name"))
    made = legacy_reconstruct(presentations, products, links, drugs, ["trusted"])
    return made.select("ean", "description", "social_name", "classification", "manufacturer", "active_ingredient")


@query(
    "compare_sources",
    v.ctes(v.CATALOG_SQL)
    + """, a as (select ean, description as n from catalog where p_partkey % 5 <> 0),
      b as (select ean, social_name || case when p_partkey % 3 = 0 then ' pack' else '' end as n from catalog where p_partkey % 4 <> 0),
      w as (select coalesce(a.ean, b.ean) as ean, a.n as x, b.n as y, list_distinct(string_split(lower(a.n), ' ')) as l, list_distinct(string_split(lower(b.n), ' ')) as r
        from a full join b on a.ean = b.ean),
      s as (select ean, case when x is not null and y is not null then len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) end as score from w)
    select ean, round(score, 6) as score, case when score is null then 'error' when score >= 1 then 'exact' when score >= 0.75 then 'strong'
      when score >= 0.5 then 'likely' when score >= 0.25 then 'weak' else 'mismatch' end as bucket from s""",
)
def compare_sources_q(spark, d):
    c = v.catalog(spark, d)
    a = c.filter(F.col("p_partkey") % 5 != 0).select("ean", F.col("description").alias("name"))
    tail = F.when(F.col("p_partkey") % 3 == 0, " pack").otherwise("")
    b = c.filter(F.col("p_partkey") % 4 != 0).select("ean", F.concat("social_name", tail).alias("name"))
    return compare_sources(a, b).select("ean", F.round("score", 6).alias("score"), "bucket")


# names of one source against names of the other with words dropped, changed or added: no code is looked at
@query(
    "similar_names",
    """with a as (select p_partkey as id, list_distinct(string_split(p_name, ' ')) as w from part),
      b as (select id, list_distinct(case id % 4 when 0 then list_concat(w, ['pack']) when 1 then w[2:] when 2 then list_concat(['new'], w[2:]) else w end) as w
        from (select p_partkey as id, string_split(p_name, ' ') as w from part))
    select a.id as left_id, b.id as right_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as score from a, b
    where len(b.w) > 0 and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.5""",
)
def similar_names_q(spark, d):
    names = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    words = F.split("name", " ")
    rest, kind = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.col("id") % 4
    damaged = F.when(kind == 0, F.concat(words, F.array(F.lit("pack")))).when(kind == 1, rest).when(kind == 2, F.concat(F.array(F.lit("new")), rest))
    other = names.select("id", F.array_join(F.coalesce(damaged, words), " ").alias("name"))
    return similar_names(names, other, 0.5, digits=6)


# -- O: order and paging -------------------------------------------------------------------


@query(
    "page",
    """select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 20 as position, cast(15 as bigint) as returned,
      true as has_more, cast(35 as bigint) as next_offset from orders
    qualify row_number() over (order by o_totalprice desc, o_orderkey) between 21 and 35""",
)
def page_q(spark, d):
    rows = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return page(rows, [F.desc("o_totalprice"), "o_orderkey"], 15, 20).drop("o_totalprice")


@query("keyset_page", "select cast(o_orderkey as varchar) as ean, o_custkey from orders where cast(o_orderkey as varchar) > '5' order by ean limit 40")
def keyset_page_q(spark, d):
    rows = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("ean"), "o_custkey")
    return keyset_page(rows, "ean", "5", 40)


@query(
    "chunk",
    """select o_orderkey, cast(floor((row_number() over (order by o_custkey, o_orderkey) - 1) / 7) as bigint) as chunk_no from orders""",
)
def chunk_q(spark, d):
    return chunk(v.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 7).drop("o_custkey")


@query("row_number", "select l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() over (order by l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity) as row_no from lineitem")
def row_number_q(spark, d):
    keys = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    return with_row_number(v.table(spark, d, "lineitem").select(*keys), keys).drop("l_quantity")


@query("export_slice", v.ctes(v.CATALOG_SQL) + "select ean, description from catalog order by ean limit 50 offset 25")
def export_slice_q(spark, d):
    return export_slice(v.catalog(spark, d).select("ean", "description"), "ean", 50, 25)


# -- K: sinks ------------------------------------------------------------------------------


@query(
    "publish_payload",
    v.ctes(v.CATALOG_SQL)
    + """select ean, '{"descricaoProduto":"' || description || '","ean":"' || ean || '"' ||
      case when active_ingredient is not null then ',"principioAtivo":"' || active_ingredient || '"' else '' end ||
      ',"classificacao":"' || classification || '","nomeSocial":"' || social_name || '","fabricante":"' || manufacturer || '","departamento":"' || department ||
      '","categoria":"' || category || '"' || case when subcategory is not null then ',"subcategoria":"' || subcategory || '"' else '' end ||
      ',"segmento":"' || segment || '"' || case when subsegment is not null then ',"subsegmento":"' || subsegment || '"' else '' end || '}' as payload from catalog""",
)
def publish_payload_q(spark, d):
    return publish_payload(v.catalog(spark, d)).select("ean", "payload")


@query(
    "review_sink",
    v.ctes(v.ITEMS_SQL)
    + """select batch_id, item_id, ean, received_name as suggested_name, 'no name' as reason, source, 'pending' as review_status,
      '{"value":' || k || '}' as content from items where status = 'review'""",
)
def review_sink_q(spark, d):
    rows = v.items(spark, d).withColumn("requires_approval", F.col("status") == "review").withColumn("approval_reason", F.lit("no name"))
    return review_sink(rows.withColumn("raw", F.to_json(F.struct(F.col("k").alias("value")))))


@query(
    "audit_mirror",
    v.ctes(v.ITEMS_SQL)
    + """select batch_id, item_id, ean, status, '{"value":' || k || '}' as original, '{"name":"' || event_type || '","batch":' || batch_id || '}' as enriched,
      'sent ' || item_id as payload from items where source = 'partner'""",
)
def audit_mirror_q(spark, d):
    product = F.struct(F.col("event_type").alias("name"), F.col("batch_id").alias("batch"))
    rows = v.items(spark, d).withColumns({
        "raw": F.to_json(F.struct(F.col("k").alias("value"))), "product": product,
        "payload": F.concat(F.lit("sent "), F.col("item_id").cast("string")),
    })
    return audit_mirror(rows, "partner")
