"""Streaming imports run over the events table until caught up."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators.waterfall import lookup_waterfall
from catalogkit.plans.bucketed import write_bucketed
from catalogkit.session import new_work_path
from catalogkit.sinks.publish import publish, publish_payload, replay
from catalogkit.streaming.cache import cache_hits, cached_rows, cached_state, stock_cache_stream
from catalogkit.streaming.imports import (
    dedupe_stream,
    enrich_stream,
    exclude_known,
    import_stream,
    read_table_stream,
    running_counters,
    start,
    write_epoch,
)
from catalogkit.streaming.requests import publish_requests, publish_waiting
from qsuite import views as v
from qsuite.q_enrich import SOURCES, WATERFALL_SQL
from qsuite.q_triage import CHECKED_SQL, TRIAGED_SQL, COUNTERS_SQL, known
from qsuite.registry import query


# quarters of the events, and files of each: more where there are more rows, so that a micro-batch keeps all cores busy
PARTS, FILES = 4, 2
FILE_ROWS = 100_000


def event_stream(spark, d):
    """All events as a stream of four micro-batches: a quarter of the ids each, in id order."""
    e = v.table(spark, d, "events")
    folder = new_work_path(spark, "events")
    low, high, rows = e.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    files = max(FILES, -(-rows // (PARTS * FILE_ROWS)))
    for part in range(PARTS):
        bounds = [low + (high + 1 - low) * p // PARTS for p in (part, part + 1)]
        own = e.filter((F.col("event_id") >= bounds[0]) & (F.col("event_id") < bounds[1]))
        own.repartition(files).write.mode("append").parquet(folder)
    return read_table_stream(spark, folder, "*.parquet", files)


def item_stream(spark, d):
    return v.items_of(event_stream(spark, d))


def drained(spark, stream, name):
    """Run a stream until caught up and read what it wrote."""
    out = new_work_path(spark, name)
    start(stream, lambda df, epoch: write_epoch(df, f"{out}/rows", epoch), f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("epoch")


@query(
    "import_stream",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL, TRIAGED_SQL) + "select batch_id, item_id, digits as valid_ean, triage from triaged",
)
def import_stream_q(spark, d):
    out = new_work_path(spark, "import-stream")
    import_stream(item_stream(spark, d), known(spark, d), out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("batch_id", "item_id", "valid_ean", "triage")


@query(
    "import_stream_bucketed",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL, TRIAGED_SQL) + "select batch_id, item_id, digits as valid_ean, triage from triaged",
)
def import_stream_bucketed_q(spark, d):
    """Known codes from a catalogue in buckets, asked through its Bloom filters."""
    out = new_work_path(spark, "import-stream")
    catalog = write_bucketed(known(spark, d).select("ean"), f"{out}/catalog", 32)
    import_stream(item_stream(spark, d), catalog, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("batch_id", "item_id", "valid_ean", "triage")


@query("stream_dedupe", v.ctes(v.ITEMS_SQL, CHECKED_SQL) + "select distinct batch_id, digits as valid_ean from checked where ok")
def stream_dedupe_q(spark, d):
    return drained(spark, dedupe_stream(item_stream(spark, d), unbounded=True).select("batch_id", "valid_ean"), "stream-dedupe")


@query(
    "stream_static_exclude",
    v.ctes(v.CATALOG_SQL, v.ITEMS_SQL, CHECKED_SQL)
    + "select distinct batch_id, digits as valid_ean from checked where ok and digits not in (select ean from catalog where p_partkey % 3 = 0)",
)
def stream_static_exclude_q(spark, d):
    firsts = dedupe_stream(item_stream(spark, d), unbounded=True).select("batch_id", "valid_ean")
    return drained(spark, exclude_known(firsts, known(spark, d)), "stream-exclude")


@query(
    "stream_enrich",
    v.ctes(v.ITEMS_SQL, CHECKED_SQL, v.LOOKUPS_SQL, WATERFALL_SQL)
    + "select distinct batch_id, digits as valid_ean, resolved_by from checked join asked on asked.ean = digits where ok",
)
def stream_enrich_q(spark, d):
    sources = v.lookups(spark, d)
    answers = lookup_waterfall(sources.select("ean"), sources, SOURCES).select("ean", "resolved_by")
    firsts = dedupe_stream(item_stream(spark, d), unbounded=True).select("batch_id", "valid_ean")
    return drained(spark, enrich_stream(firsts, answers), "stream-enrich")


def products(rows):
    return rows.select("item_id", "k", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("description"), "ean")


def refuse_some(body: str) -> None:
    """Stand-in receiver that refuses a request if it holds a product whose number is a multiple of 37."""
    import json

    sent = json.loads(body)
    if any(int(p["descricaoProduto"].split(" ")[1]) % 37 == 0 for p in sent.get("products", [sent])):
        raise RuntimeError("refused")


def accept_all(body: str) -> None:
    """Stand-in receiver that takes everything."""


# requests of ten in id order: of all events, or of each lane
_BATCHED = """numbered as (select *, {part} as part from items),
placed as (select *, (row_number() over (partition by part order by item_id) - 1) // 10 as b from numbered),
sent as (select item_id, bool_or(item_id % 37 = 0) over (partition by part, b) as failed from placed)"""
# eight lanes by id: a lane's requests of ten go on over the four micro-batches
LANES = 8
_LANES = _BATCHED.format(part=f"item_id % {LANES}")


@query(
    "micro_batch_publish",
    v.ctes(v.ITEMS_SQL, _LANES)
    + """select item_id, case when failed then 'pending_replay' else 'published' end as status,
      case when failed then 'refused' end as error from sent""",
)
def micro_batch_publish_q(spark, d):
    out = new_work_path(spark, "publish-stream")
    stream = products(item_stream(spark, d))
    lane = (F.col("item_id") % LANES).cast("int")
    publish_requests(stream, refuse_some, out, f"{out}/checkpoint", wait=None, order=["item_id"], lane=lane).awaitTermination()
    publish_waiting(spark, refuse_some, out, f"{out}/checkpoint")
    columns = ["item_id", "status", "error"]
    sent, dead = (spark.read.parquet(f"{out}/{name}").select(*columns) for name in ("sent", "dead"))
    return sent.unionByName(dead)


@query(
    "dead_letter_replay",
    v.ctes(v.ITEMS_SQL, _BATCHED.format(part="0"))
    + "select item_id, 'replayed' as status from sent where failed union all select item_id, 'published' from sent",
)
def dead_letter_replay_q(spark, d):
    out = new_work_path(spark, "dead-letters")
    rows = publish_payload(products(v.items(spark, d)))
    publish(rows, refuse_some, f"{out}/sent", f"{out}/dead", "item_id", size=10, order=["item_id"])
    after = replay(spark, f"{out}/dead", accept_all, f"{out}/sent", "item_id", size=10)
    return after.select("item_id", "status").unionByName(spark.read.parquet(f"{out}/sent").select("item_id", "status"))


@query(
    "running_counters",
    v.ctes(v.ITEMS_SQL, COUNTERS_SQL)
    + "select *, case when total > 0 and failed = total then 'failed' else 'completed' end as batch_status from counters",
)
def running_counters_q(spark, d):
    out = new_work_path(spark, "running-counters")
    run = running_counters(item_stream(spark, d), out, f"{out}/checkpoint")
    run.awaitTermination()
    last = max(p["batchId"] for p in run.recentProgress)
    from catalogkit.streaming.imports import latest_counters

    return latest_counters(spark, out, last)


CACHE_SQL = """live as (select * from events where ts > (select max(ts) from events) - interval 5 days),
cache as (select user_id, event_id, value from live qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"""
CACHE_SECONDS = 5 * 86400


def cache(spark, d):
    e = v.table(spark, d, "events")
    now = e.agg(F.max("ts")).scalar()
    return cached_rows(e, ["user_id"], "ts", now, CACHE_SECONDS, None, ["event_id"]).select("user_id", "event_id", "value")


@query("stock_cache_ttl", v.ctes(CACHE_SQL) + "select * from cache")
def stock_cache_q(spark, d):
    return cache(spark, d)


@query(
    "stock_cache_hits",
    v.ctes(CACHE_SQL)
    + """select r.event_id as request_id, cache.event_id as event_id, cache.event_id is not null as cache_hit
      from events r left join cache on cache.user_id = r.user_id""",
)
def stock_cache_hits_q(spark, d):
    requests = v.table(spark, d, "events").select(F.col("event_id").alias("request_id"), "user_id")
    return cache_hits(requests, cache(spark, d), ["user_id"]).select("request_id", "event_id", "cache_hit")


@query("stock_cache_stream", v.ctes(CACHE_SQL) + "select * from cache")
def stock_cache_stream_q(spark, d):
    """All events through keyed state, in four micro-batches; then what the state holds."""
    check = new_work_path(spark, "cache-stream")
    rows = event_stream(spark, d).select("user_id", "event_id", "value", "ts")
    stock_cache_stream(rows, check, ["user_id"], "ts", CACHE_SECONDS, ["event_id"]).awaitTermination()
    return cached_state(spark, check, "ts", CACHE_SECONDS).select("user_id", "event_id", "value")
