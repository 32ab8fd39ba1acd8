"""Stock merges, window expansion and offers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalogkit.operators.ordering import WEB_LIMIT
from catalogkit.plans.stock import (
    expand_window,
    generic_highlights,
    merge_diagnostics,
    merge_stock,
    offer_candidates,
    offer_tiers,
)
from qsuite import views as v
from qsuite.registry import query

# search results: all products of a maker, dearest first; some without a code, some with one that the feed does not have
RESULTS_SQL = """results as (select manufacturer as query_id, p_partkey as doc_id,
    case when p_partkey % 17 = 0 then null when p_partkey % 4 = 1 then '000' || ean else ean end as ean, description,
    (p_partkey % 9) / 10.0::double as similarity, p_partkey % 3 as overlap, case when p_partkey % 29 = 0 then 1 else 0 end as exact,
    row_number() over (partition by manufacturer order by price desc, p_partkey) as rk from catalog)"""
FIRST_SQL = f"firsts as (select * from feed qualify row_number() over (partition by ean order by {v.FEED_ORDER_SQL}) = 1)"


def results(spark, d):
    c = v.catalog(spark, d)
    key = F.col("p_partkey")
    rows = c.select(
        F.col("manufacturer").alias("query_id"), key.alias("doc_id"), 
        F.when(key % 17 == 0, None).when(key % 4 == 1, F.concat(F.lit("000"), "ean")).otherwise(F.col("ean")).alias("ean"), "description", "price",
        ((key % 9) / 10).alias("similarity"), (key % 3).alias("overlap"), F.when(key % 29 == 0, 1).otherwise(0).alias("exact"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("price"), "doc_id")))


MERGED_SQL = """merged as (select r.query_id, r.doc_id, f.ean, f.id as feed_id, r.description, printf('%.4f', f.stock) as stock,
    round(similarity * 10 + overlap + exact, 3) as score, r.similarity, coalesce(f.promo_price, f.price) as sale_price, f.promo_price is not null as has_offer
  from results r join firsts f on f.ean = r.ean where f.stock >= 2)"""


@query(
    "merge_stock",
    v.ctes(v.CATALOG_SQL, v.FEED_SQL, RESULTS_SQL, FIRST_SQL, MERGED_SQL)
    + """select *, cast(row_number() over (partition by query_id order by score desc, similarity desc, sale_price, description, doc_id) as integer) as merged_rank from merged""",
)
def merge_stock_q(spark, d):
    made = merge_stock(results(spark, d), v.feed(spark, d), v.FEED_ORDER, 2)
    return made.select("query_id", "doc_id", "ean", "feed_id", "description", "stock", "score", "similarity", "prices.sale_price", "prices.has_offer", "merged_rank")


@query(
    "merge_diagnostics",
    v.ctes(v.CATALOG_SQL, v.FEED_SQL, RESULTS_SQL, FIRST_SQL)
    + """select r.query_id, (select count(*) from feed) as feed_received, (select count(*) from firsts) as feed_with_ean,
      count(*) as results_received, count(r.ean) as results_with_ean, count(*) filter (r.ean is not null and f.ean is null) as missing_match,
      count(f.ean) as matched, count(*) filter (f.stock < 2) as low_stock, count(*) filter (f.stock >= 2) as merged
    from results r left join firsts f on f.ean = r.ean group by r.query_id""",
)
def merge_diagnostics_q(spark, d):
    return merge_diagnostics(results(spark, d), v.feed(spark, d), v.FEED_ORDER, 2)


_STEPS = [1, 2, 4, 8, 16, 32, 50]


def _expand_sql() -> str:
    found, goes_on = [], []
    for size in _STEPS:
        found.append(f"coalesce(first_stocked <= {size}, false)")
        goes_on.append(f"(returned >= {size} or coalesce(first_low <= {size}, false))")
    cases = " ".join(
        f"when {f}{' or true' if n == len(_STEPS) else f' or not {g}'} then {n}" for n, (f, g) in enumerate(zip(found, goes_on), 1)
    )
    sizes = " ".join(f"when {n} then {s}" for n, s in enumerate(_STEPS, 1))
    hits = " ".join(f"when {n} then {f}" for n, f in enumerate(found, 1))
    return f"""per as (select r.query_id, max(rk) as returned, min(rk) filter (f.stock >= 45) as first_stocked, min(rk) filter (f.stock < 45) as first_low
      from results r left join firsts f on f.ean = r.ean where rk <= 50 group by 1),
    tried as (select *, case {cases} end as attempts from per)
    select query_id, cast(attempts as integer) as attempts, cast(case attempts {sizes} end as integer) as window_size, case attempts {hits} end as found from tried"""


@query("expand_window", v.ctes(v.CATALOG_SQL, v.FEED_SQL, RESULTS_SQL, FIRST_SQL) + ", " + _expand_sql())
def expand_window_q(spark, d):
    return expand_window(results(spark, d), v.feed(spark, d), v.FEED_ORDER, 1, WEB_LIMIT, 45)


# offers: each branch's stock, by price or in arrival order
OFFERS_SQL = f"""priced as (select *, coalesce(case when promo_price > 0 then promo_price end, price) as final_price, promo_price > 0 as offered
  from feed where stock > 0),
by_price as (select *, row_number() over (partition by branch order by final_price, {v.FEED_ORDER_SQL}) as rk from priced),
short as (select *, count(*) over (partition by branch) as n from by_price where rk <= 7)"""


def offers(spark, d):
    return offer_candidates(v.feed(spark, d), sale="price", list_price="price")


@query(
    "offer_tiers_by_price",
    v.ctes(v.FEED_SQL, OFFERS_SQL)
    + """select branch, id, l_partkey, final_price, cast(rk as integer) as offer_rank, case when n >= 2 and rk = 1 then 'mais_barato' when n = 2 and rk = 2 then 'mais_caro'
      when n >= 3 and rk = 2 then 'preco_medio' when n >= 3 and rk = 3 then 'mais_caro' end as tier from short""",
)
def offer_tiers_q(spark, d):
    made = offer_tiers(offers(spark, d), ["branch"], v.FEED_ORDER)
    return made.select("branch", "id", "l_partkey", "final_price", "offer_rank", "tier")


@query(
    "offer_tiers_by_relevance",
    v.ctes(v.FEED_SQL, OFFERS_SQL)
    + f"""select branch, id, l_partkey, final_price, cast(rk2 as integer) as offer_rank from (
      select *, row_number() over (partition by branch order by {v.FEED_ORDER_SQL}) as rk2 from priced) where rk2 <= 7""",
)
def offer_relevance_q(spark, d):
    made = offer_tiers(offers(spark, d), ["branch"], v.FEED_ORDER, by_price=False)
    return made.select("branch", "id", "l_partkey", "final_price", "offer_rank")


# a branch's shelves: enough of them that some shortlist of seven has no generic
@query(
    "generic_highlights",
    v.ctes(v.FEED_SQL, OFFERS_SQL)
    + f""", shelf as (select *, row_number() over (partition by branch, l_linenumber order by final_price, {v.FEED_ORDER_SQL}) as srk from priced),
      covered as (select distinct branch, l_linenumber from shelf where kind = 'GENERICO' and srk <= 7),
      once as (select * from priced anti join covered using (branch, l_linenumber) where kind = 'GENERICO'
        qualify row_number() over (partition by branch, l_linenumber, l_partkey order by {v.FEED_ORDER_SQL}) = 1)
    select branch, l_linenumber, id, l_partkey, final_price, cast(rk as integer) as highlight_rank from (
      select *, row_number() over (partition by branch, l_linenumber order by final_price, {v.FEED_ORDER_SQL}) as rk from once) where rk <= 3""",
)
def generic_highlights_q(spark, d):
    c, shelf = offers(spark, d), ["branch", "l_linenumber"]
    made = generic_highlights(c, offer_tiers(c, shelf, v.FEED_ORDER), shelf, v.FEED_ORDER, "l_partkey")
    return made.select(*shelf, "id", "l_partkey", "final_price", "highlight_rank")
