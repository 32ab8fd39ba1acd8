"""Texts of configured sources are constants, equal to those computed per row."""

from pyspark.sql import functions as F

from catalogkit.operators.policy import SourcePolicy
from catalogkit.operators.waterfall import approval_reason

RULES = SourcePolicy(trusted=["a", "b-site"], labels={"A": "Alpha"})


def test_lists_of_sources_are_constants(spark):
    rows = spark.range(3)
    for names in ([], ["a"], ["b-site", " A "], ["a", "b-site", "zz", "", "zz"], [" x9y--z\t", "éa b"], ["", "--"]):
        made = rows.select(
            RULES.fixed_list_text(names).alias("once"), RULES.list_text(F.array(*map(F.lit, names)).cast("array<string>")).alias("each"),
        )
        assert all(r["once"] == r["each"] for r in made.collect()), names
    plan = rows.select(RULES.fixed_list_text(["a", "zz"]).alias("t"), F.col("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    entry = "struct<key:string,result:string,detail:string,error:string,skipped:boolean>"
    asked = spark.createDataFrame([([("a", None, None, None, False)] * 2,)], f"lookups array<{entry}>")
    reason = asked.select(approval_reason("lookups", ["a", "b-site"], RULES).alias("r"))
    assert "lambda" not in reason._jdf.queryExecution().optimizedPlan().toString()
    assert reason.first()["r"] == "Alpha sem resultado. B Site sem resultado."
