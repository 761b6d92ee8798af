"""Connected components of an edge table by randomised contraction.

Each round every vertex moves to the neighbour of smallest random rank (or stays),
the edges are relabelled and deduplicated, and the loop ends when none is left:
a constant share of the vertices goes each round whatever the diameter.  Every
round is written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long edges -> ``(id, component)`` for every vertex, the component
    named by its smallest id.  Self-loops and repeated edges are harmless; no edges
    give an empty table."""
    live = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    maps, r = [], 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(r))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        step = written(best.select(F.col("a").alias("id"),
                                   F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to")),
                       "contraction")
        maps.append(step)
        live = written(
            live.join(step.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
                .join(step.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
                .filter("ta <> tb")
                .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        r += 1
    if not maps:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    root = maps[-1].select("id", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        root = (step.join(root.withColumnRenamed("id", "to"), "to", "left")
                    .select("id", F.coalesce("root", "to").alias("root")))
    root = written(root, "roots")
    names = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(names, "root").select("id", "component")
