"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import written


def _neighbour_min(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least node ``m`` among u and its neighbours; the aggregate combines
    map-side and the join can be split where one u has very many rows."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (u, v)``; root is the component's least node.

    Alternates large-star and small-star steps (a logarithmic number of rounds) until the
    link set no longer changes.  Self links and repeated links are allowed; nodes must not
    be null.  Every round's links are written to the shared folder.
    """
    edges = written(spark, links.select("u", "v").filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_neighbour_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _neighbour_min(down)
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = written(spark, small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
