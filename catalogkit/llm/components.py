"""Connected components of a link table, in rounds of joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogkit.session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every linked node, ``component`` being the smallest node reached.

    Each round points all neighbours of a node at its smallest neighbour, first the larger ones and then
    the smaller ones, until nothing moves; long chains shorten by a factor each time. A hub's rows meet only
    one row of minima, so its side of the join may be split. Null and looping links are ignored; an
    empty table gives no rows. Every round is stored reliably, which cuts the lineage.
    """
    a_, b_ = F.col(a), F.col(b)
    edges = links.select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v"))
    edges = cut_lineage(edges.filter("u > v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        # larger neighbours of each node go to the smallest of its neighbours and itself
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # smaller neighbours likewise
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        joined = moved.join(least, "u")
        down = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(down.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
