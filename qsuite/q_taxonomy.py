"""Taxonomy reading, scoring and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators.taxonomy import LEVELS, classify_taxonomy, taxonomy_candidates, taxonomy_exact
from qsuite import views as v
from qsuite.registry import query


@query(
    "taxonomy_entries",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL)
    + f"""select 'taxonomy_' || entry_no as taxonomy_id, entry_no, path, item_count, {v.sql_norm('path')} as normalized_path,
      cast(len(list_distinct(string_split({v.sql_norm('path')}, ' '))) as integer) as words from taxonomy""",
)
def taxonomy_entries_q(spark, d):
    return v.taxonomy(spark, d).select(
        "taxonomy_id", "entry_no", "path", "item_count", "normalized_path", F.size("path_tokens").alias("words"))


EXACT_SQL = f"""exacts as (select c.*, t.entry_no as exact_entry_no from catalog c left join (
  select {v.sql_norm('path')} as np, min(entry_no) as entry_no from taxonomy group by 1) t
  on t.np = {v.sql_norm("concat_ws(' > ', c.department, c.category, c.subcategory, c.segment, c.subsegment)")})"""


@query("taxonomy_exact", v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL, EXACT_SQL) + "select p_partkey, exact_entry_no from exacts")
def taxonomy_exact_q(spark, d):
    return taxonomy_exact(v.catalog(spark, d), v.taxonomy(spark, d)).select("p_partkey", "exact_entry_no")


_SAME = lambda level, bonus: f"case when {v.sql_norm(f'coalesce(c.{level}, $$$$)')} = {v.sql_norm(f'coalesce(t.{level}, $$$$)')} then {bonus} else 0 end"
_BONUS = " + ".join(_SAME(level, bonus) for level, bonus in zip(LEVELS, (80, 90, 100, 110, 120)))
SCORED_SQL = f"""signals as (select p_partkey, case when p_partkey % 4 <> 0 then department end as department, category, subcategory,
    case when p_partkey % 5 <> 0 then segment end as segment, subsegment,
    list_distinct(string_split({v.sql_norm("description || ' ' || manufacturer || ' ' || segment")}, ' ')) as words from catalog),
entries as (select *, list_distinct(string_split({v.sql_norm('path')}, ' ')) as words from taxonomy),
scored as (select c.p_partkey, t.entry_no, t.item_count,
    4 * len(list_intersect(c.words, t.words)) + {_BONUS} + least(t.item_count, 25) / 25 as score
  from signals c, entries t),
ranked as (select *, row_number() over (partition by p_partkey order by score desc, item_count desc, entry_no) as rk from scored)"""


def signals(spark, d):
    return v.catalog(spark, d).withColumn("all_words", F.concat_ws(" ", "description", "manufacturer", "segment")).withColumns({
        "department": F.when(F.col("p_partkey") % 4 != 0, F.col("department")),
        "segment": F.when(F.col("p_partkey") % 5 != 0, F.col("segment")),
    })


@query(
    "taxonomy_candidates",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL, SCORED_SQL)
    + "select p_partkey, cast(rk as integer) as rank_no, entry_no, round(score, 6) as score from ranked where rk <= 5",
)
def taxonomy_candidates_q(spark, d):
    made = taxonomy_candidates(signals(spark, d), v.taxonomy(spark, d), "all_words", 5)
    rows = made.select("p_partkey", F.posexplode("candidates").alias("pos", "c"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("rank_no"), "c.entry_no", F.round("c.score", 6).alias("score"))


@query(
    "taxonomy_top_candidate",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL, SCORED_SQL)
    + "select entry_no, count(*) as items from ranked where rk = 1 group by entry_no",
)
def taxonomy_top_q(spark, d):
    made = taxonomy_candidates(signals(spark, d), v.taxonomy(spark, d), "all_words", 1, item_rows=300, entry_rows=200)
    return made.groupBy(F.get("candidates", F.lit(0))["entry_no"].alias("entry_no")).agg(F.count("*").alias("items"))


CLASSIFIED_SQL = """sig as (select *, concat_ws(' > ', department, category, subcategory, segment, subsegment) as path from signals),
exact2 as (select s.p_partkey, min(t.entry_no) as entry_no from sig s join taxonomy t on lower(t.path) = lower(s.path) group by 1),
best as (select p_partkey, entry_no from ranked where rk = 1)"""


@query(
    "classify_taxonomy",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL, SCORED_SQL, CLASSIFIED_SQL)
    + """select b.p_partkey, coalesce(e.entry_no, b.entry_no) as entry_no, t.department, t.category, t.subcategory, t.segment, t.subsegment,
      case when e.entry_no is not null then 'existing_exact_match' else 'heuristic' end as source,
      case when e.entry_no is not null then 1.0::double else 0.35::double end as confidence
    from best b left join exact2 e using (p_partkey) join taxonomy t on t.entry_no = coalesce(e.entry_no, b.entry_no)""",
)
def classify_taxonomy_q(spark, d):
    made = classify_taxonomy(signals(spark, d), v.taxonomy(spark, d), "all_words", 5)
    number = F.substring_index("selected_id", "_", -1).cast("long").alias("entry_no")
    return made.select("p_partkey", number, *LEVELS, "taxonomy.source", "taxonomy.confidence")


@query(
    "external_choice",
    v.ctes(v.CATALOG_SQL, v.TAXONOMY_SQL, SCORED_SQL, CLASSIFIED_SQL)
    + """, asked as (select s.p_partkey, r.entry_no as choice from signals s left join ranked r on r.p_partkey = s.p_partkey and r.rk = 2
        where s.p_partkey % 2 = 0)
    select b.p_partkey, coalesce(e.entry_no, case when a.p_partkey is not null and b.p_partkey % 3 <> 0 then a.choice end, b.entry_no) as entry_no,
      case when e.entry_no is not null then 'existing_exact_match' when a.p_partkey is not null then 'external_choice' else 'heuristic' end as source,
      case when e.entry_no is not null then 1.0::double when a.p_partkey is not null then 0.9::double else 0.35::double end as confidence
    from best b left join exact2 e using (p_partkey) left join asked a using (p_partkey)""",
)
def external_choice_q(spark, d):
    rows, entries = signals(spark, d), v.taxonomy(spark, d)
    second = taxonomy_candidates(rows, entries, "all_words", 5).filter(F.col("p_partkey") % 2 == 0)
    number = F.get("candidates", F.lit(1))["entry_no"]
    pick = F.when(F.col("p_partkey") % 3 == 0, "taxonomy_none").otherwise(F.concat(F.lit("taxonomy_"), number.cast("string")))
    choices = second.select("p_partkey", pick.alias("choice"), F.lit(0.9).alias("confidence"), F.lit("outside").alias("rationale"))
    made = classify_taxonomy(rows, entries, "all_words", 5, choices, "p_partkey")
    chosen = F.substring_index("selected_id", "_", -1).cast("long").alias("entry_no")
    return made.select("p_partkey", chosen, "taxonomy.source", "taxonomy.confidence")
