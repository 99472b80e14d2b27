"""Classes of linked nodes: the least node of each connected component, computed as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the least node of its component.

    Randomised contraction: in each round every node goes to the first of itself and its neighbours, the links between
    the places they went to are the next round's, and those within one are gone. The order is that of the nodes in the
    first round, which settles stars whose centre is least, and random afterwards, so that a chain of any numbering is
    expected to lose a part of its nodes a round. Links and maps shrink from round to round: all rounds together make a
    few times the rows of the first. Neighbours are reduced by partial aggregation before the shuffle, so a node with
    very many links is no hot group; joins on such a node are plain equi joins, which Spark splits.
    """
    left = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while not maps or left.limit(1).count():
        order = (lambda c: F.xxhash64(c, F.lit(len(maps)))) if maps else F.col
        # equal hashes of two nodes are decided by the nodes
        rank = lambda c: F.struct(order(c).alias("at"), F.col(c).alias("node"))  # noqa: B023,E731
        to = materialize(left.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["node"].alias("to")))
        maps.append(to)
        ends = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("c")), "a").select("b", "c")
        ends = ends.join(to.select(F.col("node").alias("b"), F.col("to").alias("d")), "b")
        left = materialize(ends.filter("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
    # where a node went to goes on as the next rounds say, from the last round back to the first
    labels = maps.pop()
    while maps:
        on = labels.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = materialize(maps.pop().join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
    least = labels.groupBy("to").agg(F.min("node").alias("label"))
    return materialize(labels.join(least, "to").select("node", "label"))
