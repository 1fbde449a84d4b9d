"""Connected components by contraction, with every round written down and no edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise, release


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node that links reach.

    Each round points every node to the one that comes first within two steps, in an order drawn anew for the round, and
    contracts the edges: stars and cliques are single nodes after a round, and what is left shrinks by a constant factor
    even along chains. A round is a few joins on node keys and partial minima, so a hub's edges can be split. Null ends
    are dropped; self-loops name a node of its own. An error is raised should max_rounds not be enough.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    live = materialise(both, "components-edges")
    of = materialise(live.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "components-nodes")
    for number in range(max_rounds):
        ends = live.filter("a != b")
        if ends.isEmpty():
            smallest = of.groupBy("component").agg(F.min("node").alias("smallest"))
            return of.join(smallest, "component").select("node", F.col("smallest").alias("component"))
        order = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = materialise(ends.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a"))).alias("m")), "components-near")
        beyond = ends.join(near.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("n"))
        down = near.join(beyond, "a").select(F.col("a").alias("node"), F.least("m", "n")["v"].alias("to"))
        down = materialise(down, "components-pointers")
        now = of.join(down.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        now = materialise(now, "components-nodes")
        moved = ends.join(down.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(down.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        moved = materialise(moved.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "components-edges")
        release(live, of, near, down)
        live, of = moved, now
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
