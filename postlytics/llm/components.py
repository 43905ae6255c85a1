"""Connected components over an edge table, for the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: longs) -> (node, component: smallest node of the component).

    Large-star and small-star rounds: every node points its larger (then its smaller)
    neighbours at its smallest one, until nothing changes; the rounds grow with the logarithm
    of the component size. Each round is written to the shared folder, so lost executors
    cost a round at most. Minima are partial aggregates and the join back on a hub has one
    row on the other side, so a hub doesn't fill a task.
    """
    now = stored(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
                 .filter("a < b").distinct())
    state = None
    while True:
        # large star: of u's neighbours, those above u point at min(u and its neighbours)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        # small star: u and its smaller neighbours point at the smallest of them
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low2, "b")
                 .select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
                 .filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = stored(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return (now.groupBy("b").agg(F.min("a").alias("component"))
            .select(F.col("b").alias("node"), "component")
            .unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component"))
                         .distinct()))
