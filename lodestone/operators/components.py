"""Connected components of an undirected edge list, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.stages import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that an edge names; component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then jumps
    to that label's own label, so that long chains halve. A hub's rows are reduced by
    the partial minimum before the shuffle; each round is written to shared storage.
    Joins are told to merge, as small sides would be broadcast through the driver in every round.
    Null ends are left out; an empty edge list gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = materialise(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("seen"))
        )
        taken = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = materialise(
            taken.join(jump.hint("merge"), "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")),
            "labels",
        )
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels


def contracted_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """What :func:`connected_components` gives, for graphs of many edges and short ways.

    Every node is put together with its smallest neighbour, and edges go on between the nodes that are left, each once, twice and then while that at least
    halves the nodes; what is left goes by rounds. So all edges are read once and not in every round. A component's smallest node stays to
    the end, since it has no smaller neighbour. Joins are told to merge, as in the rounds.
    """
    pairs = materialise(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "edges")
    steps, halved = [], True
    while halved:
        ends = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        near = materialise(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "nodes")
        steps.append(near)
        x = pairs.join(near.toDF("a", "c").hint("merge"), "a").join(near.toDF("b", "d").hint("merge"), "b").where("c <> d")
        pairs = materialise(x.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
        # a node of many smaller neighbours draws them together only in the second step
        halved = not pairs.isEmpty() and (len(steps) < 2 or 2 * near.select("to").distinct().count() <= near.count())
    out = connected_components(pairs, "a", "b")
    for near in reversed(steps):
        found = near.join(out.select(F.col("node").alias("to"), "component").hint("merge"), "to", "left")
        out = found.select("node", F.coalesce("component", "to").alias("component"))
    return out
