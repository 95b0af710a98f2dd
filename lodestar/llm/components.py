"""Connected components of a link table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._spark import materialize


def _star(links: DataFrame) -> DataFrame:
    """One large star, then one small star; every link is (u, v) with v < u before and after."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u")
    return small.select("u", F.col("m").alias("v")).union(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def component_labels(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    `links` has two comparable columns u and v; self-links, nulls and repeats are ignored. Hubs are
    handled by partial aggregation and skew joins, nothing is collected. Each round is written to
    the shared folder, so a lost executor costs one round. An empty link table gives an empty result.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, seen = materialize(links, "links"), None
    for _ in range(most_rounds):
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        links = materialize(_star(links), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", "root")
