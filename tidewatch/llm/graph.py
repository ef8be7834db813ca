"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import stage

ROWS_PER_TASK = 200_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) of longs to rows (node, component), component being the smallest node reachable.

    Only nodes with an edge to another node appear. Each step groups by node with a map-side minimum and joins the
    minimum back, so a node with very many edges is never collected; the edge table is written to the shared folder
    between steps. Ends when every node has one edge, to a root. Edges only get fewer, so each step uses as many tasks as
    ROWS_PER_TASK allows: a small graph is not dealt over the whole cluster in every step.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, name)
    tasks = e.count() // ROWS_PER_TASK + 1
    e = e.coalesce(tasks)
    while True:
        loose = e.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        roots = e.select(F.col("v").alias("r")).distinct()
        many, chained = loose.join(roots, loose.u == roots.r, "left").agg(F.count(F.when(F.col("n") > 1, 1)), F.count("r")).first()
        if many == 0 and chained == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("r").alias("node"), F.col("r").alias("component")))
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v")))
        large = stage(large.where("u <> v").distinct().coalesce(tasks), name).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), name).coalesce(tasks)
