"""Connected components over an edge table, with shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.shared import release
from lucerna.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (u, v longs); root is the least node of the component.

    Each round points every node to its least neighbour, follows pointers to their ends by doubling,
    and contracts the edges to the ends; nodes at least halve, so rounds grow with the logarithm."""
    spark = edges.sparkSession
    edges = settle(edges.where("u <> v").select("u", "v").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
        point = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "pointers")
        last = point
        while True:
            ahead = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = settle(point.join(ahead, "root").select("node", "root", "next"), "pointers")
            release(last)
            last = jumped
            moved = not jumped.where("root <> next").isEmpty()
            point = jumped.select("node", F.col("next").alias("root"))
            if not moved:
                break
        maps.append(point)
        u = point.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        v = point.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        done = edges
        edges = settle(edges.join(u, "u").join(v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        release(done)
    release(edges)
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[0]
    for later in maps[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
