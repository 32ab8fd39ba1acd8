"""Catalogue-shaped inputs derived from the given tables, in Spark and in SQL alike.

Remainders of keys only decide which rows lack a value, a source or a partner, so that every
case of an operator occurs; queries run over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogkit.functions.ean import check_digit
from catalogkit.functions.values import computed_once
from catalogkit.operators.ordering import with_row_number
from catalogkit.operators.taxonomy import LEVELS, taxonomy_entries
from catalogkit.session import spread


SMALL_TABLES = {"region", "nation", "supplier", "benchmark", "labels"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if name in SMALL_TABLES else spread(df)


# -- SQL fragments -------------------------------------------------------------------------

def sql_digit(body: str) -> str:
    """Check digit of a code body, weights 1,3,1,3… from the left."""
    cell = f"cast(substr({body}, i, 1) as bigint) * case when i % 2 = 1 then 1 else 3 end"
    return f"((10 - list_sum(list_transform(range(1, length({body}) + 1), lambda i: {cell})) % 10) % 10)"


def sql_body(key: str) -> str:
    return f"('789' || lpad(cast({key} as varchar), 9, '0'))"


def sql_ean(key: str) -> str:
    """Code of a key; every seventh key gets a wrong check digit."""
    shift = f"case when {key} % 7 = 0 then 1 else 0 end"
    return f"({sql_body(key)} || cast(cast(({sql_digit(sql_body(key))} + {shift}) % 10 as bigint) as varchar))"


def sql_norm(text: str) -> str:
    return f"lower(trim(regexp_replace(strip_accents({text}), '[^a-zA-Z0-9]+', ' ', 'g')))"


def sql_search_norm(text: str) -> str:
    lowered = f"lower(strip_accents({text}))"
    split = f"regexp_replace(regexp_replace({lowered}, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({split}, '[^a-z0-9]+', ' ', 'g'))"


def sql_tokens(text: str, limit: int | None = None) -> str:
    tokens = f"regexp_extract_all({sql_search_norm(text)}, '[a-z0-9]+')"
    return f"list_slice({tokens}, 1, {limit})" if limit else tokens


def sql_fnv(token: str) -> str:
    step = "((xor(h, c) * 16777619) & 4294967295)"
    chars = f"list_transform(range(1, length({token}) + 1), lambda i: cast(unicode(substr({token}, i, 1)) as bigint))"
    return f"list_reduce(list_prepend(cast(2166136261 as bigint), {chars}), lambda h, c: {step})"


def sql_word(text: str, n: int) -> str:
    return f"split_part({text}, ' ', {n})"


# -- derived tables ------------------------------------------------------------------------

def ean_of(key: str) -> Column:
    number = F.col(key)
    body = F.concat(F.lit("789"), F.lpad(number.cast("string"), 9, "0"))
    digit = (check_digit(body) + F.when(number % 7 == 0, 1).otherwise(0)) % 10
    return F.concat(body, digit.cast("string"))


CATALOG_SQL = f"""catalog as (
  select {sql_ean('p_partkey')} as ean,
    p_partkey,
    p_name || ' ' || p_size || 'mg' as description,
    case when p_partkey % 11 = 0 then null else {sql_word('p_name', 2)} end as active_ingredient,
    p_name as social_name,
    case when p_partkey % 13 = 0 then 'NAO DEFINIDO' else p_type end as classification,
    p_brand as manufacturer,
    p_type as department,
    {sql_word('p_name', 2)} as category,
    case when p_size % 3 = 0 then null else {sql_word('p_name', 1)} end as subcategory,
    case when p_size % 2 = 0 then 'even size' else 'odd size' end as segment,
    case when p_size % 10 = 0 then p_brand end as subsegment,
    p_retailprice as price,
    p_partkey % 1000 as updated_no
  from part
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part."""
    p = computed_once(table(spark, sf_dir, "part"), ean=ean_of("p_partkey"))
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    return p.select(
        "ean",
        "p_partkey",
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mg")).alias("description"),
        F.when(F.col("p_partkey") % 11 != 0, word(2)).alias("active_ingredient"),
        F.col("p_name").alias("social_name"),
        F.when(F.col("p_partkey") % 13 == 0, "NAO DEFINIDO").otherwise(F.col("p_type")).alias("classification"),
        F.col("p_brand").alias("manufacturer"),
        F.col("p_type").alias("department"),
        word(2).alias("category"),
        F.when(F.col("p_size") % 3 != 0, word(1)).alias("subcategory"),
        F.when(F.col("p_size") % 2 == 0, "even size").otherwise("odd size").alias("segment"),
        F.when(F.col("p_size") % 10 == 0, F.col("p_brand")).alias("subsegment"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") % 1000).alias("updated_no"),
    )


FEED_SQL = f"""feed as (
  select {sql_ean('l_partkey')} as ean,
    l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount,
    cast(l_suppkey as varchar) as branch,
    l_orderkey || '-' || l_linenumber || '-' || l_suppkey as id,
    cast(l_partkey as varchar) as code,
    'stock ' || l_partkey as description,
    case when l_returnflag = 'R' then 0.0 else l_quantity end as stock,
    l_extendedprice as price,
    case when l_discount > 0 then l_extendedprice * (1 - l_discount) end as promo_price,
    case when l_discount > 0 then round(l_discount * 100, 2) end as discount_pct,
    case l_returnflag when 'A' then 'GENERICO' when 'N' then 'REFERENCIA' else 'SIMILAR' end as kind
  from lineitem
)"""

FEED_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
FEED_ORDER_SQL = ", ".join(FEED_ORDER)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stock row per order line."""
    l = computed_once(table(spark, sf_dir, "lineitem"), ean=ean_of("l_partkey"))
    s = lambda c: F.col(c).cast("string")
    offer = F.col("l_discount") > 0
    return l.select(
        "ean",
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        s("l_suppkey").alias("branch"),
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_suppkey")).alias("id"),
        s("l_partkey").alias("code"),
        F.concat(F.lit("stock "), s("l_partkey")).alias("description"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("stock"),
        F.col("l_extendedprice").alias("price"),
        F.when(offer, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("promo_price"),
        F.when(offer, F.round(F.col("l_discount") * 100, 2)).alias("discount_pct"),
        F.when(F.col("l_returnflag") == "A", "GENERICO").when(F.col("l_returnflag") == "N", "REFERENCIA")
        .otherwise("SIMILAR").alias("kind"),
    )


ITEMS_SQL = f"""items as (
  select user_id as batch_id, event_id as item_id, event_type, value,
    cast(json_extract(props, '$.k') as bigint) as k,
    case when event_id % 17 = 0 then '' when event_id % 19 = 0 then '123'
      else substr({sql_ean("cast(json_extract(props, '$.k') as bigint)")}, 1, 3) || '-' ||
           substr({sql_ean("cast(json_extract(props, '$.k') as bigint)")}, 4) end as ean,
    case when event_id % 5 = 0 then null else 'Item ' || event_type || ' ' || event_id end as received_name,
    case event_type when 'view' then 'shop_feed' when 'click' then 'partner' else 'erp' end as source,
    case event_type when 'error' then 'failed' when 'signup' then 'review' when 'view' then 'skipped_duplicate'
      else 'enriched' end as status
  from events
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One received item per event."""
    return items_of(table(spark, sf_dir, "events"))


def items_of(events: DataFrame) -> DataFrame:
    e = computed_once(events, k=F.get_json_object("props", "$.k").cast("long"))
    e = computed_once(e, code=ean_of("k"))
    code = F.col("code")
    dashed = F.concat(F.substring(code, 1, 3), F.lit("-"), F.substring(code, 4, 20))
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("batch_id"),
        F.col("event_id").alias("item_id"),
        "event_type",
        "value",
        "k",
        F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 19 == 0, "123").otherwise(dashed).alias("ean"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Item "), kind, F.lit(" "), F.col("event_id").cast("string")))
        .alias("received_name"),
        F.when(kind == "view", "shop_feed").when(kind == "click", "partner").otherwise("erp").alias("source"),
        F.when(kind == "error", "failed").when(kind == "signup", "review").when(kind == "view", "skipped_duplicate")
        .otherwise("enriched").alias("status"),
    )


# which parts each of three sources answers for, and how
LOOKUP_SOURCES = ["store_api", "retail_site", "price_page"]
LOOKUPS_SQL = f"""lookups as (
  select {sql_ean('p_partkey')} as ean, s.source_key,
    case when p_partkey % 4 <> 0 and p_partkey % s.m <> 2 then p_name end as r_nome,
    case when p_partkey % 4 <> 0 and p_partkey % s.m <> 2 and p_size % 2 = 0 then p_name || ' ' || p_size || 'mg' end as r_nome_exibicao,
    case when p_partkey % 4 <> 0 and p_partkey % s.m <> 2 then p_brand end as r_laboratorio,
    (p_partkey % 4 <> 0 and p_partkey % s.m <> 2) as has_result,
    case when p_partkey % 6 = 1 then p_name || ' caixa' end as d_produto,
    case when p_partkey % 6 = 1 then p_size || ' mg/5 ml' end as d_apresentacao,
    case when p_partkey % 6 = 1 then p_type end as d_classe,
    (p_partkey % 6 = 1) as has_detail,
    case when p_partkey % s.m = 2 and p_partkey % 6 <> 1 then 'timeout' end as error
  from part, (values ('store_api', 3), ('retail_site', 5), ('price_page', 8)) s(source_key, m)
  where p_partkey % s.m <> 0
)"""


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three sources: ``(ean, source_key, result, detail, error)``."""
    p = computed_once(table(spark, sf_dir, "part"), ean=ean_of("p_partkey"))
    key = F.col("p_partkey")
    sources = F.array(*[F.struct(F.lit(s).alias("source_key"), F.lit(m).alias("m")) for s, m in zip(LOOKUP_SOURCES, (3, 5, 8))])
    rows = p.select("*", F.inline(sources)).filter(key % F.col("m") != 0)
    has_result = (key % 4 != 0) & (key % F.col("m") != 2)
    has_detail = key % 6 == 1
    shown = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))
    result = F.struct(
        F.col("p_name").alias("nome"),
        F.when(F.col("p_size") % 2 == 0, shown).alias("nome_exibicao"),
        F.col("p_brand").alias("laboratorio"),
    )
    info = F.struct(
        F.concat("p_name", F.lit(" caixa")).alias("produto"),
        F.concat(F.col("p_size").cast("string"), F.lit(" mg/5 ml")).alias("apresentacao"),
        F.col("p_type").alias("classe"),
    )
    return rows.select(
        "ean",
        "source_key",
        F.when(has_result, result).alias("result"),
        F.when(has_detail, F.struct(info.alias("info"))).alias("detail"),
        F.when((key % F.col("m") == 2) & ~has_detail, "timeout").alias("error"),
    )


TAXONOMY_SQL = f"""paths as (
  select department, category, subcategory, segment, subsegment, count(*) as item_count
  from catalog where p_partkey % 3 <> 1 group by all
), taxonomy as (
  select *, row_number() over (order by department, category, coalesce(subcategory, ''), segment, coalesce(subsegment, '')) as entry_no,
    concat_ws(' > ', department, category, subcategory, segment, subsegment) as path
  from paths
)"""


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths seen in two thirds of the parts, with how many parts each has."""
    c = catalog(spark, sf_dir).filter(F.col("p_partkey") % 3 != 1)
    paths = c.groupBy(*LEVELS).agg(F.count("*").alias("item_count"))
    blank = lambda x: F.coalesce(F.col(x), F.lit(""))
    order = ["department", "category", blank("subcategory"), "segment", blank("subsegment")]
    return taxonomy_entries(with_row_number(paths, order, "entry_order"), "entry_order")


def ctes(*parts: str) -> str:
    return "with " + ", ".join(parts) + "\n"
