"""Import triage, de-duplication and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.functions.ean import validate_ean
from catalogkit.functions.values import computed_once
from catalogkit.operators.aggregates import (
    LOOKUP_STATUSES,
    count_distinct_keys,
    distinct_concat,
    distinct_values,
    group_by_key,
    import_counters,
    latency_summary,
    quality_by_category,
    status_summary,
    token_frequencies,
)
from catalogkit.operators.dedupe import (
    distinct_on,
    first_per_key,
    mark_duplicates,
    newest_snapshot_wins,
    top_per_key,
    union_sources,
)
from catalogkit.plans.catalog import lookup_eans, lookup_summary
from catalogkit.plans.reports import import_report, import_report_rows, quality_report
from catalogkit.plans.triage import drop_existing, missing_keys, triage, triage_summary
from qsuite import views as v
from qsuite.registry import query

DIGITS = "regexp_replace(ean, '[^0-9]', '', 'g')"
CHECKED_SQL = f"""checked as (
  select i.*, {DIGITS} as digits,
    (length({DIGITS}) in (8, 12, 13, 14) and
      right({DIGITS}, 1) = cast(cast({v.sql_digit(f"left({DIGITS}, length({DIGITS}) - 1)")} as bigint) as varchar)) as ok
  from items i
)"""
TRIAGED_SQL = f"""numbered as (
  select *, row_number() over (partition by batch_id, ok, digits order by item_id) as rn from checked
), triaged as (
  select n.batch_id, n.item_id, n.digits,
    case when not n.ok then 'invalid' when n.rn > 1 then 'duplicate'
      when c.ean is not null then 'existing' else 'eligible' end as triage
  from numbered n left join (select ean from catalog where p_partkey % 3 = 0) c on c.ean = n.digits
)"""


def known(spark, d):
    return v.catalog(spark, d).filter(F.col("p_partkey") % 3 == 0)


@query(
    "import_triage",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL, TRIAGED_SQL)
    + """select batch_id, count(*) as staged, count(*) filter (triage = 'invalid') as invalid,
      count(*) filter (triage = 'duplicate') as duplicate, count(*) filter (triage = 'existing') as existing,
      count(*) filter (triage in ('invalid', 'eligible')) as to_process
    from triaged group by batch_id""",
)
def import_triage(spark, d):
    return triage_summary(triage(v.items(spark, d), known(spark, d)))


@query(
    "triage_rows",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL, TRIAGED_SQL)
    + "select batch_id, item_id, digits as valid_ean, triage from triaged",
)
def triage_rows(spark, d):
    return triage(v.items(spark, d), known(spark, d)).select("batch_id", "item_id", "valid_ean", "triage")


@query(
    "mark_duplicates",
    v.ctes(v.ITEMS_SQL, CHECKED_SQL)
    + """select item_id, ok and row_number() over (partition by batch_id, ok, digits order by item_id) > 1 as is_duplicate
    from checked""",
)
def mark_duplicates_q(spark, d):
    rows = computed_once(v.items(spark, d), c=validate_ean("ean"))
    rows = rows.select("batch_id", "item_id", F.col("c.ean").alias("digits"), F.col("c.is_valid").alias("ok"))
    return mark_duplicates(rows, ["batch_id"], "digits", "ok", ["item_id"], "item_id").select("item_id", "is_duplicate")


@query(
    "drop_existing",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL)
    + """select item_id, digits as ean, digits in (select ean from catalog where p_partkey % 3 = 0) as exists_in_catalog
    from checked where ok""",
)
def drop_existing_q(spark, d):
    rows = computed_once(v.items(spark, d), c=validate_ean("ean")).filter("c.is_valid")
    return drop_existing(rows.select("item_id", F.col("c.ean").alias("ean")), known(spark, d))


@query(
    "missing_keys",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL)
    + "select distinct digits as ean from checked where ok and digits not in (select ean from catalog where p_partkey % 3 = 0)",
)
def missing_keys_q(spark, d):
    rows = computed_once(v.items(spark, d), c=validate_ean("ean")).filter("c.is_valid")
    return missing_keys(rows.select(F.col("c.ean").alias("ean")), known(spark, d))


LOOKUP_EANS_SQL = f"""asked as (
  select case when length(digits) between 8 and 14 then digits else ean end as ean, item_id,
    case when digits = '' then 'Todo produto precisa ter o campo ean.'
      when length(digits) not between 8 and 14 then 'O campo ean precisa ter entre 8 e 14 digitos.' end as error
  from checked
), answers as (
  select a.ean, a.first_position, a.error, c.description, c.ean is not null as found
  from (select ean, min(item_id) as first_position, max(error) as error from asked group by ean) a
  left join (select * from catalog where p_partkey % 3 = 0) c on a.ean = c.ean
)"""


@query(
    "lookup_eans",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL, LOOKUP_EANS_SQL) + "select * from answers",
)
def lookup_eans_q(spark, d):
    return lookup_eans(v.items(spark, d), known(spark, d).select("ean", "description"), "item_id")


@query(
    "lookup_eans_summary",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL, LOOKUP_EANS_SQL)
    + """select count(*) as requested, count(*) filter (found) as returned, count(*) filter (not found) as missing
    from answers""",
)
def lookup_eans_summary(spark, d):
    return lookup_summary(lookup_eans(v.items(spark, d), known(spark, d).select("ean", "description"), "item_id"))


COUNTERS_SQL = """counters as (
  select batch_id, count(*) as total, count(*) as processed, count(*) filter (status = 'enriched') as success,
    count(*) filter (status = 'failed') as failed, count(*) filter (status = 'review') as review
  from items group by batch_id
)"""


@query(
    "import_counters",
    v.ctes(v.ITEMS_SQL, COUNTERS_SQL)
    + "select *, case when total > 0 and failed = total then 'failed' else 'completed' end as batch_status from counters",
)
def import_counters_q(spark, d):
    return import_counters(v.items(spark, d))


@query(
    "finalize_status",
    v.ctes(v.ITEMS_SQL)
    + """select k, value_band, case when count(*) filter (status = 'failed') = count(*) then 'failed' else 'completed' end as batch_status
    from (select k, cast(floor(value / 5) as bigint) as value_band, status from items) group by k, value_band""",
)
def finalize_status_q(spark, d):
    from catalogkit.operators.aggregates import count_if, finalize_status

    rows = v.items(spark, d).withColumn("value_band", F.floor(F.col("value") / 5).cast("long"))
    counted = rows.groupBy("k", "value_band").agg(F.count("*").alias("n"), count_if(F.col("status") == "failed").alias("bad"))
    return counted.select("k", "value_band", finalize_status("n", "bad").alias("batch_status"))


@query(
    "status_summary",
    """select user_id, count(*) as total, count(*) filter (event_type = 'view') as view,
      count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error,
      count(*) filter (event_type = 'refund') as refund from events group by user_id""",
)
def status_summary_q(spark, d):
    return status_summary(v.table(spark, d, "events"), "event_type", ["view", "click", "error", "refund"], ["user_id"])


@query(
    "distinct_on",
    "select distinct on (l_partkey) l_partkey, l_suppkey, l_orderkey from lineitem order by l_partkey, l_suppkey, l_orderkey, l_linenumber",
)
def distinct_on_q(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return distinct_on(rows, ["l_partkey"], ["l_suppkey", "l_orderkey", "l_linenumber"]).drop("l_linenumber")


@query(
    "first_per_key",
    v.ctes(v.FEED_SQL)
    + f"""select ean, l_orderkey, l_linenumber, price from feed
    qualify row_number() over (partition by ean order by {v.FEED_ORDER_SQL}) = 1""",
)
def first_per_key_q(spark, d):
    return first_per_key(v.feed(spark, d), ["ean"], v.FEED_ORDER).select("ean", "l_orderkey", "l_linenumber", "price")


@query(
    "top_per_key",
    v.ctes(v.FEED_SQL)
    + f"""select ean, l_orderkey, l_linenumber, cast(rk as integer) as rank_no from (
      select *, row_number() over (partition by ean order by price desc, {v.FEED_ORDER_SQL}) as rk from feed) where rk <= 3""",
)
def top_per_key_q(spark, d):
    top = top_per_key(v.feed(spark, d), ["ean"], [F.desc("price"), *v.FEED_ORDER], 3, "rank_no")
    return top.select("ean", "l_orderkey", "l_linenumber", "rank_no")


@query(
    "first_match",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL)
    + "select department, category, min(entry_no) as entry_no from taxonomy group by all",
)
def first_match_q(spark, d):
    t = v.taxonomy(spark, d)
    return first_per_key(t, ["department", "category"], ["entry_no"]).select("department", "category", "entry_no")


SNAPSHOTS_SQL = """snaps as (
  select ean, description, 'snap_2024_01' as snapshot, false as legacy from catalog where p_partkey % 2 = 0
  union all select ean, social_name, 'snap_2024_02', false from catalog where p_partkey % 3 = 0
  union all select ean, upper(social_name), 'snap_2024_03', true from catalog where p_partkey % 5 = 0
)"""


def snapshots(spark, d):
    c = v.catalog(spark, d)
    part = lambda n, text, name, legacy: c.filter(F.col("p_partkey") % n == 0).select(
        "ean", text.alias("description"), F.lit(name).alias("snapshot"), F.lit(legacy).alias("legacy"))
    return union_sources(
        part(2, F.col("description"), "snap_2024_01", False),
        part(3, F.col("social_name"), "snap_2024_02", False),
        part(5, F.upper("social_name"), "snap_2024_03", True),
    )


@query("union_snapshots", v.ctes(v.CATALOG_SQL, SNAPSHOTS_SQL) + "select * from snaps")
def union_snapshots_q(spark, d):
    return snapshots(spark, d)


for _flag in (False, True):

    @query(
        "newest_snapshot_wins" + ("_with_legacy" if _flag else ""),
        v.ctes(v.CATALOG_SQL, SNAPSHOTS_SQL)
        + f"""select * from snaps where {'true' if _flag else 'not legacy'}
        qualify row_number() over (partition by ean order by snapshot desc) = 1""",
    )
    def newest_snapshot_q(spark, d, flag=_flag):
        return newest_snapshot_wins(snapshots(spark, d), "ean", "snapshot", "legacy", flag)


@query(
    "quality_report",
    v.ctes(v.CATALOG_SQL, SNAPSHOTS_SQL)
    + """, used as (
      select snapshot, count(*) as included from (
        select * from snaps where not legacy qualify row_number() over (partition by ean order by snapshot desc) = 1) group by 1
    ), per as (
      select s.snapshot, count(*) as found, coalesce(any_value(u.included), 0) as included,
        count(*) filter (s.legacy) as skipped
      from snaps s left join used u on u.snapshot = s.snapshot group by s.snapshot
    )
    select snapshot, cast(sum(found) as bigint) as found, cast(sum(included) as bigint) as included,
      cast(sum(found - skipped - included) as bigint) as duplicates, cast(sum(skipped) as bigint) as skipped
    from per group by rollup (snapshot)""",
)
def quality_report_q(spark, d):
    return quality_report(snapshots(spark, d), "ean", "snapshot", "legacy")


@query(
    "distinct_concat",
    """select l_suppkey, string_agg(f, ',' order by f) as joined from (
      select distinct l_suppkey, l_returnflag || l_linestatus || l_linenumber as f from lineitem) group by l_suppkey""",
)
def distinct_concat_q(spark, d):
    rows = v.table(spark, d, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("f"))
    return distinct_concat(rows, ["l_suppkey"], "f")


@query("count_distinct_keys", "select count(distinct l_partkey) as total from lineitem")
def count_distinct_keys_q(spark, d):
    return count_distinct_keys(v.table(spark, d, "lineitem"), "l_partkey")


@query("distinct_values", "select distinct p_brand as name from part where trim(p_brand) <> ''")
def distinct_values_q(spark, d):
    return distinct_values(v.table(spark, d, "part"), "p_brand")


@query(
    "group_by_ean",
    v.ctes(v.FEED_SQL)
    + """select ean, cast(count(*) as bigint) as items, cast(sum(l_quantity) as bigint) as quantity, min(l_orderkey) as first_order,
      md5(string_agg(l_orderkey || ':' || l_linenumber || ':' || id, ' ' order by l_orderkey, l_linenumber, cast(id as varchar))) as content
    from feed group by ean""",
)
def group_by_ean_q(spark, d):
    rows = v.feed(spark, d).select("ean", "id", "l_orderkey", "l_linenumber", "l_quantity")
    lists = group_by_key(rows, "ean", "id", ["l_orderkey", "l_linenumber"], size=20)
    per_list = lists.select(
        "ean",
        F.size("items").alias("n"),
        F.aggregate("items", F.lit(0.0), lambda s, x: s + x["l_quantity"]).alias("q"),
        F.get("items", F.lit(0))["l_orderkey"].alias("o"),
    )
    sums = per_list.groupBy("ean").agg(
        F.sum("n").alias("items"), F.sum("q").cast("long").alias("quantity"), F.min("o").alias("first_order"))
    # what the lists hold, row by row
    flat = lists.select("ean", F.explode("items").alias("i"))
    cell = F.concat_ws(":", "i.l_orderkey", "i.l_linenumber", "i.id")
    kept = flat.groupBy("ean").agg(F.array_sort(F.collect_list(F.struct("i.l_orderkey", "i.l_linenumber", cell.alias("c")))).alias("c"))
    content = F.md5(F.array_join(F.transform("c", lambda x: x["c"]), " ").cast("binary")).alias("content")
    return sums.join(kept.select("ean", content), "ean")


@query(
    "quality_by_category",
    """with o as (select d.lang as category, l.quality = 1 as passed, l.toxic = 1 as failed
      from labels l join documents d using (doc_id))
    select category, count(*) as total, count(*) filter (passed and not failed) as passed,
      count(*) filter (failed) as errors, count(*) filter (not passed and not failed) as missed,
      round(count(*) filter (passed and not failed) / count(*) * 100, 2) as pass_pct
    from o group by rollup (category)""",
)
def quality_by_category_q(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    o = v.table(spark, d, "labels").join(docs, "doc_id").select(
        "category", (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("failed"))
    return quality_by_category(o, "category", "passed", "failed")


@query(
    "latency_summary",
    """with e as (select event_type as stage, value from events union all select 'all', value from events),
    t as (select event_type as stage, epoch(max(ts)) - epoch(min(ts)) as s from events group by 1),
    time as (select stage, floor(s) * 1000 as ms from t union all select 'all', sum(floor(s)) * 1000 from t)
    select stage, count(*) as requests, count(*) filter (value < 20) as successes, any_value(ms) as elapsed_ms,
      round(count(*) / (any_value(ms) / 1000), 2) as requests_per_second,
      round(count(*) filter (value < 20) / count(*) * 100, 2) as success_pct,
      round(min(value), 2) as min, round(sum(cast(round(value * 100) as bigint)) / 100 / count(*), 2) as avg,
      round(quantile_disc(value, 0.5), 2) as p50, round(quantile_disc(value, 0.9), 2) as p90,
      round(quantile_disc(value, 0.95), 2) as p95, round(quantile_disc(value, 0.99), 2) as p99, round(max(value), 2) as max
    from e join time using (stage) group by stage""",
)
def latency_summary_q(spark, d):
    e = v.table(spark, d, "events").withColumnRenamed("event_type", "stage")
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    exact = F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")
    elapsed = e.groupBy("stage").agg((F.floor(exact) * 1000).cast("double").alias("elapsed_ms"))
    return latency_summary(e, "stage", "value", F.col("value") < 20, elapsed)


@query(
    "token_frequencies",
    f"""with t as (select lang, unnest({v.sql_tokens('text', None)}) as token from documents)
    select lang, token, count(*) as occurrences, round(1 + ln(count(*)), 6) as weight from t group by all""",
)
def token_frequencies_q(spark, d):
    from catalogkit.functions.text import tokenize

    docs = v.table(spark, d, "documents").select("lang", tokenize("text", None).alias("tokens"))
    return token_frequencies(docs, "tokens", ["lang"]).withColumn("weight", F.round("weight", 6))


@query(
    "import_report",
    v.ctes(v.ITEMS_SQL)
    + """select batch_id, count(*) as items_count, count(*) filter (status = 'review') as reviews_count,
      count(*) filter (status = 'failed') as dead_letters_count, count(*) filter (source = 'partner') as mirror_count
    from items group by batch_id""",
)
def import_report_q(spark, d):
    rows = v.items(spark, d)
    return import_report(rows.select("batch_id").distinct(), _children(rows))


def _children(rows):
    return {
        "items": rows,
        "reviews": rows.filter(F.col("status") == "review"),
        "dead_letters": rows.filter(F.col("status") == "failed"),
        "mirror": rows.filter(F.col("source") == "partner"),
    }


@query(
    "import_report_rows",
    v.ctes(v.ITEMS_SQL)
    + """, s as (select *, 'items' as section from items union all select *, 'reviews' from items where status = 'review'
      union all select *, 'dead_letters' from items where status = 'failed')
    select batch_id, section, cast(item_id as varchar) as row_id,
      '{"status":"' || status || '","props_json":{"k":' || k || '}}' as content from s""",
)
def import_report_rows_q(spark, d):
    rows = v.items(spark, d).select(
        "batch_id", F.col("item_id").alias("row_id"), "status",
        F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")).alias("props_json"))
    return import_report_rows({
        "items": rows,
        "reviews": rows.filter(F.col("status") == "review"),
        "dead_letters": rows.filter(F.col("status") == "failed"),
    })
