"""Connected components by repeated contraction, as grouped joins.

Every round draws a priority for each node from a hash of the node and the round, points
each node at the one of least priority around it (itself included), moves both ends of
each edge one step along, and drops what became a loop or a repeat.  Priorities are new in
every round, so whatever the shape and the labels, a constant share of the nodes is
expected to go each time and the rounds grow with the logarithm of the nodes.

Once the edges left are so few, counted, that they would be broadcast, the last rounds are
taken in memory: a round costs seconds of jobs whatever little it moves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import BROADCAST_ROWS, materialize


def _contract(here: DataFrame) -> DataFrame:
    """(node, up) of few edges (hi, lo), ``up`` the smallest node reachable: roots hook onto smaller ones until no edge is open."""
    edges = here.toArrow()
    ends = [edges[c].to_numpy() for c in ("hi", "lo")]
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    hi, lo = at[: len(edges)], at[len(edges) :]
    up = np.arange(len(names))
    while len(hi):
        np.minimum.at(up, np.maximum(up[hi], up[lo]), np.minimum(up[hi], up[lo]))
        while (up != up[up]).any():
            up = up[up]
        still = up[hi] != up[lo]
        hi, lo = hi[still], lo[still]
    return here.sparkSession.createDataFrame(pa.table({"node": pa.array(names), "up": pa.array(names[up])})).select(
        F.col("node").cast(here.schema["hi"].dataType), F.col("up").cast(here.schema["hi"].dataType)
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list; root is the smallest node reachable.

    Loops and repeated edges are fine.  Nodes without an edge do not appear.  No edges
    give an empty table.
    """
    here = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct(), "cc-edges"
    )
    steps: list[DataFrame] = []
    while (edges_left := here.count()) > 0:
        if edges_left <= BROADCAST_ROWS:
            steps.append(materialize(_contract(here), "cc-step"))
            break

        def ranked(name: str):
            return F.struct(F.xxhash64(name, F.lit(len(steps))).alias("priority"), F.col(name).alias("at"))

        both = here.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(here.select("lo", "hi"))
        around = both.groupBy("node").agg(F.min(ranked("other")).alias("best"))
        step = materialize(around.select("node", F.least("best", ranked("node"))["at"].alias("up")), "cc-step")
        moved = (
            here.join(step.select(F.col("node").alias("hi"), F.col("up").alias("hi_up")), "hi")
            .join(step.select(F.col("node").alias("lo"), F.col("up").alias("lo_up")), "lo")
            .select(F.greatest("hi_up", "lo_up").alias("hi"), F.least("hi_up", "lo_up").alias("lo"))
            .filter("hi > lo")
            .distinct()
        )
        steps.append(step)
        here = materialize(moved, "cc-edges")
    if not steps:
        return here.select(F.col("hi").alias("node"), F.col("lo").alias("root"))

    def follow(roots: DataFrame, step: DataFrame) -> DataFrame:
        later = roots.select(F.col("node").alias("up"), F.col("root").alias("later"))
        return materialize(
            step.join(later, "up", "left").select("node", F.coalesce("later", "up").alias("root")), "cc-roots"
        )

    last = steps[-1].select("node", F.col("up").alias("root"))
    held = reduce(follow, reversed(steps[:-1]), last)
    # The node a component met in belongs to it; its smallest node gives the name.
    least = held.groupBy("root").agg(F.min("node").alias("least"))
    return materialize(held.join(least, "root").select("node", F.col("least").alias("root")), "cc-named")
