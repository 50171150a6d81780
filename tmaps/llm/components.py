"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import stored


LINKS_A_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; the root is the least node it can reach.

    ``links`` has two long columns. Each round ties a node's larger neighbours, then its
    smaller ones, to the least of them, until all are tied to their root: rounds grow with
    the logarithm of a chain's length. No node's neighbours meet in one place: the rounds
    are minima by node (summed before the shuffle) and joins. Tasks follow the number of
    links, which only falls: small tables do not pay for many empty partitions."""
    a, b = links.columns
    now = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, now.count() // LINKS_A_TASK)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).coalesce(tasks)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        ties = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        now = stored(ties.union(least).distinct().coalesce(tasks), "ties")
        # done when every node has one tie, to a node that has none
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks)
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
