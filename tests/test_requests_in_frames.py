"""Numbered requests are sent many a task, each whole, wherever Arrow batches end."""

from pyspark.sql import Window, functions as F

from catalogkit.sinks.publish import send_batches


def test_requests_stay_whole_over_frames(spark):
    def answer_with_rows(body):
        import json

        raise RuntimeError(",".join(str(p["i"]) for p in json.loads(body).get("products", [json.loads(body)])))

    rows = spark.range(2003).withColumn("payload", F.to_json(F.struct(F.col("id").alias("i"))))
    for number in (F.floor(F.col("id") / 10), F.struct((F.col("id") % 3).alias("lane"), F.floor(F.col("id") / 30).alias("request_no"))):
        named = rows.repartition(7).withColumn("batch_no", number)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        try:
            sent = send_batches(named, answer_with_rows, "id", 10)
            found = {r["id"]: sorted(map(int, r["error"].split(","))) for r in sent.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        wanted = {r["id"]: sorted(r["all"]) for r in named.select(
            "id", F.collect_list("id").over(Window.partitionBy("batch_no")).alias("all")).collect()}
        assert found == wanted
        plan = sent._jdf.queryExecution().toString()
        assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
