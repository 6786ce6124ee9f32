"""Walks over an edge table, breadth first."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.session import settle

UP, DOWN = "up", "down"


def walk(
    edges: DataFrame, roots: DataFrame, *, direction: str = DOWN, depth: int | None = 4,
    source: str = "source", target: str = "target",
) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes with their hop, edges walked, whether more lay beyond the depth).

    Each hop joins the frontier to the edges and drops what was seen. The frontier
    is written per hop, so a hop never computes the earlier ones again. Without a
    depth the walk ends where the frontier is empty.
    """
    V.one_of("direction", direction, (UP, DOWN))
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    here, there = (source, target) if direction == DOWN else (target, source)
    frontier = roots.toDF("node").distinct().withColumn("hop", F.lit(0))
    nodes, walked = settle(frontier), None
    frontier = nodes
    for hop in count(1) if depth is None else range(1, depth + 1):
        steps = settle(
            edges.join(frontier.select(F.col("node").alias("_n")), F.col(f"`{here}`") == F.col("_n"))
            .select(source, target).distinct()
        )
        walked = steps if walked is None else walked.unionByName(steps)
        ahead = steps.select(F.col(f"`{there}`").alias("node")).distinct()
        frontier = settle(ahead.join(nodes, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            return nodes, walked.distinct(), False
        nodes = nodes.unionByName(frontier)
    return nodes, walked.distinct(), True
