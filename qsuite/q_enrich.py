"""Lookups in priority order, enrichment and product records."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.functions.ean import validate_ean
from catalogkit.operators.policy import SourcePolicy
from catalogkit.operators.waterfall import (
    approval_reason,
    lookup_status_long,
    lookup_status_wide,
    lookup_waterfall,
    resolve_sources,
    source_order,
    staged_waterfall,
)
from catalogkit.operators.taxonomy import LEVELS
from catalogkit.plans.enrich import details_json, enrich_items, lookup_batch, product_snapshot
from qsuite import views as v
from qsuite.q_triage import CHECKED_SQL, DIGITS
from qsuite.registry import query

SOURCES = v.LOOKUP_SOURCES
POLICY = SourcePolicy(
    trusted=["store_api", "retail_site"], pass_through=["shop_feed"], preferred_names=["retail_site"],
    preferred_data=["price_page", "store_api"], labels={"price_page": "Price Page"},
)


def _waterfall_sql(order: list[str]) -> str:
    """Sources joined side by side; ``hit`` is the first with a result or detail."""
    joins, hit, columns = [], [], []
    for i, s in enumerate(order):
        joins.append(f"left join (select * from lookups where source_key = '{s}') s{i} on s{i}.ean = k.ean")
        found = f"(coalesce(s{i}.has_result, false) or coalesce(s{i}.has_detail, false))"
        hit.append(f"when {found} then {i}")
        columns.append(
            f"s{i}.r_nome as n{i}, s{i}.r_nome_exibicao as e{i}, s{i}.r_laboratorio as l{i}, coalesce(s{i}.has_result, false) as r{i}, "
            f"coalesce(s{i}.has_detail, false) as d{i}, s{i}.d_produto as p{i}, s{i}.d_apresentacao as a{i}, s{i}.d_classe as c{i}, s{i}.error as x{i}"
        )
    names = "case hit " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(order)) + " end"
    return (
        f"keys as (select distinct {DIGITS} as ean from items), wide as (select k.ean, case {' '.join(hit)} else 99 end as hit, {', '.join(columns)} "
        f"from keys k {' '.join(joins)}), asked as (select *, {names} as resolved_by from wide)"
    )


WATERFALL_SQL = _waterfall_sql(SOURCES)


def _long_sql(order: list[str]) -> str:
    return " union all ".join(
        f"select ean, '{s}' as source_key, r{i} and {i} <= hit as search, d{i} and {i} <= hit as detail, case when {i} <= hit then x{i} end as error, "
        f"{i} > hit as skipped, case when {i} > hit then 'resolved_by_' || resolved_by end as skip_reason from asked"
        for i, s in enumerate(order)
    )


def keys(spark, d):
    return v.items(spark, d).select(validate_ean("ean")["ean"].alias("ean"))


def answers(spark, d, order=None):
    return lookup_waterfall(keys(spark, d), v.lookups(spark, d), order or SOURCES)


@query("lookup_waterfall", v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, WATERFALL_SQL) + _long_sql(SOURCES))
def lookup_waterfall_q(spark, d):
    rows = answers(spark, d).select("ean", F.explode("lookups").alias("l"))
    return rows.select(
        "ean", F.col("l.key").alias("source_key"), F.col("l.result").isNotNull().alias("search"),
        F.col("l.detail").isNotNull().alias("detail"), "l.error", "l.skipped", "l.skip_reason")


@query("staged_waterfall", v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, WATERFALL_SQL) + _long_sql(SOURCES))
def staged_waterfall_q(spark, d):
    lookups = v.lookups(spark, d)
    by_source = {s: lookups.filter(F.col("source_key") == s) for s in SOURCES}
    rows = staged_waterfall(keys(spark, d), by_source, SOURCES).select("ean", F.explode("lookups").alias("l"))
    return rows.select(
        "ean", F.col("l.key").alias("source_key"), F.col("l.result").isNotNull().alias("search"),
        F.col("l.detail").isNotNull().alias("detail"), "l.error", "l.skipped", "l.skip_reason")


for _mode in ("api_only", "scraping_only", "scraping_first", "api_first"):
    _order = source_order(["store_api"], ["retail_site", "price_page"], _mode)

    @query(
        f"source_order_{_mode}",
        v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, _waterfall_sql(_order))
        + "select resolved_by, count(*) as eans from asked group by resolved_by",
    )
    def source_order_q(spark, d, order=_order):
        return answers(spark, d, order).groupBy("resolved_by").agg(F.count("*").alias("eans"))


@query(
    "lookup_status_wide",
    v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, WATERFALL_SQL)
    + "select ean, resolved_by, "
    + ", ".join(
        f"r{i} and {i} <= hit as {s}_search, d{i} and {i} <= hit as {s}_detail, case when {i} <= hit then x{i} end as {s}_error, "
        f"{i} > hit as {s}_skipped, case when {i} > hit then 'resolved_by_' || resolved_by end as {s}_skip_reason"
        for i, s in enumerate(SOURCES)
    )
    + " from asked",
)
def lookup_status_wide_q(spark, d):
    return lookup_status_wide(answers(spark, d), SOURCES)


@query("lookup_status_unpivot", v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, WATERFALL_SQL) + _long_sql(SOURCES))
def lookup_status_long_q(spark, d):
    return lookup_status_long(lookup_status_wide(answers(spark, d), SOURCES), SOURCES)


# only the hit source keeps an answer, so it is the name and the data source whenever it has a name
_HIT = lambda column: "case hit " + " ".join(f"when {i} then {column}{i}" for i in range(len(SOURCES))) + " end"


# every source was asked: the price page tells no name and the retail site no detail, so names and data come from different sources
_ASKED_SQL = """eff as (select ean, source_key, case when source_key <> 'price_page' then r_nome end as n, has_result and source_key <> 'price_page' as r,
    case when source_key <> 'retail_site' then d_produto end as p, has_detail and source_key <> 'retail_site' as d from lookups),
  per as (select ean, """ + ", ".join(
    f"max(coalesce(n, p)) filter (source_key = '{s}') as n_{k}, coalesce(bool_or(d) filter (source_key = '{s}'), false) as d_{k}, "
    f"coalesce(bool_or(r or d) filter (source_key = '{s}'), false) as m_{k}" for k, s in (("s", "store_api"), ("r", "retail_site"), ("p", "price_page"))
) + """ from eff group by ean),
  named as (select *, case when n_r is not null then 'retail_site' when n_s is not null then 'store_api' when n_p is not null then 'price_page' end as own from per),
  found as (select *, case when d_p then 'price_page' when d_s then 'store_api' when d_r then 'retail_site'
    when m_p then 'price_page' when m_s then 'store_api' when m_r then 'retail_site' else own end as data_key from named)"""


@query("resolve_sources", v.ctes(v.LOOKUPS_SQL, _ASKED_SQL) + "select ean, coalesce(own, data_key) as name_key, data_key from found")
def resolve_sources_q(spark, d):
    rows = v.lookups(spark, d)
    kept = rows.withColumns({
        "result": F.when(F.col("source_key") != "price_page", F.col("result")), "detail": F.when(F.col("source_key") != "retail_site", F.col("detail")),
    })
    own = [F.max(F.when(F.col("source_key") == s, F.struct("result", "detail", "error"))).alias(s) for s in SOURCES]
    entries = [F.struct(F.lit(s).alias("key"), F.lit(n).alias("priority"), f"{s}.result", f"{s}.detail", f"{s}.error") for n, s in enumerate(SOURCES)]
    asked = kept.groupBy("ean").agg(*own).select("ean", F.array(*entries).alias("lookups"))
    made = resolve_sources(asked, SOURCES, POLICY)
    return made.select("ean", F.col("name_lookup.key").alias("name_key"), F.col("data_lookup.key").alias("data_key"))


_LABELS = {"store_api": "Store Api", "retail_site": "Retail Site", "price_page": "Price Page"}
# preference order: retail_site, store_api, price_page
_ASKED_ORDER = ["retail_site", "store_api", "price_page"]


def _reason_sql() -> str:
    parts = []
    for s in _ASKED_ORDER:
        i = SOURCES.index(s)
        parts.append(
            f"'{_LABELS[s]}' || case when (r{i} or d{i}) and {i} <= hit then ' encontrou resultado.' "
            f"when {i} > hit then ' nao foi consultada porque uma fonte anterior resolveu o EAN.' "
            f"when x{i} is not null then ' falhou: ' || x{i} else ' sem resultado.' end"
        )
    return " || ' ' || ".join(parts)


@query("approval_reason", v.ctes(v.ITEMS_SQL, v.LOOKUPS_SQL, WATERFALL_SQL) + f"select ean, {_reason_sql()} as reason from asked")
def approval_reason_q(spark, d):
    return answers(spark, d).select("ean", approval_reason("lookups", SOURCES, POLICY).alias("reason"))


_NAME = f"coalesce({_HIT('n')}, {_HIT('p')})"
_SHOWN = f"coalesce({_HIT('e')}, {_HIT('n')}, nullif(concat_ws(' ', {_HIT('p')}, {_HIT('a')}), ''))"
ENRICHED_SQL = f"""enriched as (
  select i.item_id, a.ean, i.source, a.resolved_by, hit < 99 as matched,
    case when hit < 99 then {_SHOWN} else i.received_name end as received_name,
    hit < 99 or (i.source = 'shop_feed' and i.received_name is not null) as found,
    case when hit < 99 then resolved_by = 'price_page' else not (i.source = 'shop_feed' and i.received_name is not null) end as requires_approval,
    case when hit < 99 and resolved_by = 'price_page' then 'Nome nao resolvido por Store Api ou Retail Site.'
      when hit = 99 and not (i.source = 'shop_feed' and i.received_name is not null) then {_reason_sql()} end as approval_reason,
    case when hit = 99 and i.source = 'shop_feed' and i.received_name is not null then 'shop_feed' end as pass_through_source,
    case when hit < 99 then {_NAME} when i.source = 'shop_feed' then i.received_name end as name,
    case when hit < 99 then {_HIT('c')} end as category,
    case when hit < 99 then {_HIT('l')} end as laboratory,
    case when hit < 99 then nullif(regexp_extract({_HIT('a')}, '^\\d+ mg/5 ml'), '') end as dose,
    case when hit < 99 then resolved_by when i.source = 'shop_feed' and i.received_name is not null then 'shop_feed' end as name_source,
    case when hit < 99 then resolved_by else i.source end as data_source
  from checked i join asked a on a.ean = i.digits
)"""


def enriched(spark, d):
    rows = v.items(spark, d).select(
        "item_id", validate_ean("ean")["ean"].alias("ean"), "received_name", "source")
    return enrich_items(rows, answers(spark, d), SOURCES, POLICY)


@query("enrich_items", v.ctes(v.ITEMS_SQL, CHECKED_SQL, v.LOOKUPS_SQL, WATERFALL_SQL, ENRICHED_SQL) + "select * from enriched")
def enrich_items_q(spark, d):
    return enriched(spark, d).select(
        "item_id", "ean", "source", "resolved_by", "matched", "received_name", "found", "requires_approval", "approval_reason",
        "pass_through_source", *[F.col(f"product.{c}").alias(c) for c in ("name", "category", "laboratory", "dose", "name_source", "data_source")])


_TRUST = "name_source in ('store_api', 'retail_site', 'shop_feed')"


@query(
    "product_snapshot",
    v.ctes(v.ITEMS_SQL, CHECKED_SQL, v.LOOKUPS_SQL, WATERFALL_SQL, ENRICHED_SQL)
    + f"""select item_id, case when {_TRUST} then coalesce(name, received_name) end as social_name,
      case when {_TRUST} then received_name end as description, coalesce(category, 'outro') as classification, laboratory as manufacturer,
      case when {_TRUST} then null else 'Nome do produto nao foi validado por Store Api, Retail Site ou Shop Feed.' end as reject_reason
    from enriched""",
)
def product_snapshot_q(spark, d):
    return product_snapshot(enriched(spark, d), POLICY).select(
        "item_id", "social_name", "description", "classification", "manufacturer", "reject_reason")


@query(
    "lookup_batch",
    v.ctes(v.ITEMS_SQL, CHECKED_SQL, v.LOOKUPS_SQL, WATERFALL_SQL)
    + f"""select item_id as request_id, digits as ean, status, case status when 'invalid_ean' then 'INVALID_EAN' when 'not_found' then 'LOOKUP_NOT_FOUND'
        when 'error' then 'LOOKUP_ERROR' end as fallback_code,
      case when status = 'enriched' then {_NAME} end as social_name, case when status in ('review', 'enriched') then {_NAME} end as item_name,
      case when status = 'enriched' then taxonomy end as taxonomy_source,
      case when ok then array_to_string(list_slice({SOURCES}, 1, hit + 1), ' ') else '' end as attempted,
      case when status = 'error' then 'timeout; timeout; timeout' end as error
    from (select i.item_id, i.digits, i.ok, a.*, 'heuristic' as taxonomy, case when not ok then 'invalid_ean' when hit = 99 and x0 is not null and x1 is not null and x2 is not null then 'error'
        when hit = 99 then 'not_found' when resolved_by = 'price_page' then 'review' else 'enriched' end as status
      from checked i join asked a on a.ean = i.digits)""",
)
def lookup_batch_q(spark, d):
    requests = v.items(spark, d).select(F.col("item_id").alias("request_id"), F.col("ean").alias("input_ean"))
    made = lookup_batch(requests, v.lookups(spark, d), SOURCES, POLICY, v.taxonomy(spark, d))
    name = F.coalesce("item.product_name", "item.name").alias("item_name")
    tag = F.when(F.col("status") == "enriched", F.col("taxonomy.source")).alias("taxonomy_source")
    return made.select("request_id", "ean", "status", "fallback_code", "social_name", name, tag,
                       F.array_join("attempted_sources", " ").alias("attempted"), F.when(F.col("status") == "error", F.col("error")).alias("error"))


_TEXTS = ["dose", "unit", "form", "route", "quantity", "volume", "registration", "control_label", "name_source", "data_source",
          "original_description", "normalized_description", "brand", "active_ingredient", *LEVELS]


@query(
    "details_json_build",
    """with p as (select *, case when p_partkey % 4 <> 0 then ',"departamento":"' || p_type || '"' else '' end as department,
        case when p_partkey % 3 = 0 then '["' || p_type || '"]' else '[]' end as drugs from part)
    select p_partkey, '{"ean":"' || p_partkey || '","dose":"' || p_size || ' mg","origem_nome":"' || case when p_partkey % 2 = 0 then 'site' else 'feed' end
        || '","origem_dados":"feed","descricao_original":"' || p_name || '"' || department || case when p_partkey % 3 = 0 then ',"farmacos":' || drugs else '' end
        || ',"estrutura_final":{"ean":"' || p_partkey || '","descricao_original":"' || p_name || '","marca":"' || p_brand || '","fabricante":"' || p_brand || '"'
        || department || ',"principio_ativo":' || drugs || '}}' as details from p""",
)
def details_json_build_q(spark, d):
    key = F.col("p_partkey")
    given = {
        "dose": F.concat(F.col("p_size").cast("string"), F.lit(" mg ")), "original_description": F.col("p_name"), "brand": F.col("p_brand"),
        "department": F.when(key % 4 != 0, F.col("p_type")), "name_source": F.when(key % 2 == 0, "site").otherwise(" "),
    }
    product = F.struct(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in _TEXTS])
    drugs = F.when(key % 3 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    rows = v.table(spark, d, "part").select("p_partkey", product.alias("p"), drugs.alias("drugs"), "p_brand")
    made = details_json(F.col("p"), F.col("p_partkey").cast("string"), F.lit("feed"), F.col("drugs"), F.col("p_brand"))
    return rows.select("p_partkey", made.alias("details"))
