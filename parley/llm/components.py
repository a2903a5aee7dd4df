"""Connected components by random contraction, in DataFrame operations only.

A round points every node at the node of least random rank, drawn anew each round,
within two steps, and replaces edges by the edges between what their ends point at.
Connection is kept (the node between gives the edge), a star is one round, and in
expectation a constant part of the nodes goes, so rounds grow with the logarithm of
the longest path. Each round's pointers are a written
table; composing them from the last to the first gives every node its component.
All keys are aggregated before they move, and a hot node's rows are split by the
adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

#: Rows of a file: a round's tables shrink, and are written in no more files than they need.
FILE_ROWS = 250_000
#: Rounds after which something must be wrong: enough for paths of 10^9 nodes.
MOST_ROUNDS = 90


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (the least node reachable) for every node of edges (a, b), of one comparable type.

    Loops, repeated and null edges are allowed; an empty table gives no rows.
    """
    live = edges.select("a", "b").dropna()
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    live = scratch.save(live.filter("a <> b").distinct(), "edges")
    levels = []
    for turn in range(MOST_ROUNDS):
        if not (rows := live.count()):
            break
        save = lambda df, name: scratch.save(df.coalesce(1 + 2 * rows // FILE_ROWS), name)  # noqa: E731, B023
        both = live.union(live.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        near = save(best.select("a", F.least("best", rank("a")).alias("best")), "nearest")
        # The least rank within two steps: a hub's neighbours all point at one node.
        far = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("best").alias("best"))
        point = save(far.select(F.col("a").alias("node"), F.col("best.n").alias("to")), "pointers")
        levels.append(point)
        half = live.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b").distinct()
        whole = half.join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        live = save(whole.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    # From the last round back: where a node's pointer went on, follow it.
    root = None
    for point in reversed(levels):
        if root is None:
            root = point
        else:
            on = root.select(F.col("node").alias("to"), F.col("to").alias("further"))
            root = scratch.save(point.join(on, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "roots")
    if root is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = root.groupBy("to").agg(F.min(F.least("node", "to")).alias("component"))
    named = root.join(least, "to").select("node", "component")
    return scratch.save(nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
