"""Sketches of the quarters of the events, united, against exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators.sketches import (
    RANK_ERROR,
    distinct_error,
    distinct_sketches,
    frequent_items,
    quantile_sketches,
    relative_error,
    unite_distinct,
    unite_frequent,
    unite_quantiles,
)
from qsuite import views as v
from qsuite.registry import query

RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
FREQUENT = 40


def events(spark, d):
    """Events in four batches, by id."""
    return v.table(spark, d, "events").withColumn("part", F.col("event_id") % 4)


@query(
    "distinct_sketches",
    "select event_type, count(distinct user_id) as users, true as same_as_whole, true as within_error from events group by event_type",
)
def distinct_sketches_q(spark, d):
    """Users per event type from four united sketches; five deviations of the error are allowed."""
    e = events(spark, d)
    united = unite_distinct(distinct_sketches(e, ["event_type", "part"], "user_id"), ["event_type"])
    whole = distinct_sketches(e, ["event_type"], "user_id").select("event_type", F.hll_sketch_estimate("sketch").alias("at_once"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    joined = exact.join(united, "event_type").join(whole, "event_type")
    near = relative_error(F.col("n"), F.col("users")) <= 5 * distinct_error()
    return joined.select("event_type", "users", (F.col("n") == F.col("at_once")).alias("same_as_whole"), near.alias("within_error"))


@query(
    "quantile_sketches",
    "select event_type, unnest(['p50', 'p95', 'p99']) as name, true as within_error from (select distinct event_type from events)",
)
def quantile_sketches_q(spark, d):
    """The true ranks of the values that four united sketches give; twice the stated error is allowed."""
    e = events(spark, d)
    found = unite_quantiles(quantile_sketches(e, ["event_type", "part"], "value"), ["event_type"], RANKS)
    marks = found.select("event_type", F.explode(F.create_map(*[x for n in RANKS for x in (F.lit(n), F.col(n))])).alias("name", "mark"))
    asked = marks.join(e.select("event_type", "value"), "event_type").groupBy("event_type", "name").agg(
        F.avg((F.col("value") <= F.col("mark")).cast("double")).alias("high"), F.avg((F.col("value") < F.col("mark")).cast("double")).alias("low"))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair]), F.col("name"))
    near = (F.col("low") <= share + 2 * RANK_ERROR) & (F.col("high") >= share - 2 * RANK_ERROR)
    return asked.select("event_type", "name", near.alias("within_error"))


@query(
    "frequent_items",
    f"""with counted as (select event_type, event_id % 4 as part, user_id as item, count(*) as n from events group by all),
    ranked as (select *, row_number() over (partition by event_type, part order by n desc, item) as rk from counted),
    missed as (select event_type, part, coalesce(max(n) filter (rk = {FREQUENT + 1}), 0) as missed from ranked group by all),
    total as (select event_type, sum(missed) as all_missed from missed group by all),
    united as (select event_type, item, sum(n) as n, sum(missed) as had from ranked join missed using (event_type, part) where rk <= {FREQUENT} group by all),
    best as (select *, row_number() over (partition by event_type order by n desc, item) as rk from united)
    select b.event_type, b.item, cast(b.n as bigint) as n, cast(b.n + all_missed - had as bigint) as at_most,
      (select count(*) from events e where e.event_type = b.event_type and e.user_id = b.item) between b.n and b.n + all_missed - had as holds
    from best b join total using (event_type) where b.rk <= {FREQUENT}""",
)
def frequent_items_q(spark, d):
    e = events(spark, d)
    parts = frequent_items(e, ["event_type", "part"], "user_id", FREQUENT)
    united = unite_frequent(parts, "part", ["event_type"], FREQUENT)
    exact = e.groupBy("event_type", F.col("user_id").alias("item")).agg(F.count("*").alias("exact"))
    joined = united.join(exact, ["event_type", "item"])
    return joined.select("event_type", "item", "n", "at_most", F.col("exact").between(F.col("n"), F.col("at_most")).alias("holds"))
