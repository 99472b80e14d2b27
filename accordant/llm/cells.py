"""Links between similar nodes of shared buckets, in a way that stays linear for large groups of copies.

Every bucket has one leader: the node with the most neighbours in all its buckets, which in a family of mutated copies is
the original or the copy nearest to it. All buckets of a family tend to have the same leader. The nodes that share a bucket
led by L are the cell of L. Each is compared with L, once, and its difference is kept as a set of tokens: what one of the
two has and the other has not. The answers of all other pairs of the cell follow from these differences:

1. The size of the symmetric difference of two nodes A and B is |d(A)| + |d(B)| - 2 |d(A) and d(B) in common|. They are
   similar if `a` times that is at most `b` (|A| + |B|), for a ratio a / b = (1 + t) / (1 - t) of the similarity t.
   If A is not similar to L, A and B must then have tokens of their differences in common, so an equi join on
   (cell, token) finds all such pairs. It is kept small by a prefix filter with places: tokens of each node are ordered
   from rare to frequent in the cell, and the first common token of a similar pair stands early enough in both for the
   rest to suffice. Tokens that a single node has (most changed words) only move the others back.
2. Before that, while it links at least an eighth of them, the nodes outside their leader's class are compared with one
   further leader each cell and round, so that a family without a centre leaves few pairs to the join.

Every pair of one bucket whose classes differ is thus compared or excluded exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: A further leader is worth a round if it links more than one in FEW of the nodes left.
FEW = 8


def alike(apart: Column, n: Column, m: Column, ratio: tuple[int, int]) -> Column:
    """Whether sets of n and m tokens that differ in `apart` are similar."""
    return ratio[0] * apart <= ratio[1] * (n + m)


def labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """rows with the label of a node, which is the node itself if it has no link."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def renewed(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels after further links found(label_a, label_b) between classes."""
    new = components(found.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    moved = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(old.unionByName(new).groupBy("node").agg(F.min("label").alias("label")))


def rivals(cells: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of cells(lead, node, n, diff, label, other) that can be similar: of different labels, one of them at least `other` (of another class than its lead)."""
    size, (up, down) = F.size("diff"), ratio
    rows = materialize(cells.select("lead", "node", "label", "other", "n", size.alias("d"), (up * size - down * F.col("n")).alias("x"), F.explode("diff").alias("token")))
    shared = rows.groupBy("lead", "token").agg(F.count("*").alias("times"), F.min("x").alias("x_any"), F.min(F.when(F.col("other"), F.col("x"))).alias("x_other"), F.min("label").alias("low"), F.max("label").alias("high")).filter("times > 1")
    own = Window.partitionBy("lead", "node")
    # tokens of this node only come first; `before` counts them and the rarer ones of several nodes
    placed = rows.join(shared, ["lead", "token"])
    before = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "token")) - 1
    placed = placed.withColumn("y", up * (F.col("d") - 2 * before) + down * F.col("n")).filter("low <> high and x_other is not null and y >= least(x_any, x_other)")
    placed = materialize(placed.select("lead", "token", "node", "label", "other", "x", "y", "x_any", "x_other"))
    left = placed.filter("other and y >= x_any").select("lead", "token", F.struct("node", "label", "x", "y").alias("l"))
    right = placed.filter("y >= x_other").select("lead", "token", F.struct("node", "label", "x", "y", "other").alias("r"))
    fits = (F.col("l.label") != F.col("r.label")) & (F.col("l.x") <= F.col("r.y")) & (F.col("r.x") <= F.col("l.y")) & (~F.col("r.other") | (F.col("l.node") < F.col("r.node")))
    return left.join(right, ["lead", "token"]).filter(fits).select("lead", F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def met(pairs: DataFrame, cells: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Those of pairs(lead, a, b) that are similar by their differences to the lead: (a, b, label_a, label_b)."""
    side = lambda c: cells.select("lead", F.col("node").alias(c), F.struct("n", "diff", "label").alias(f"of_{c}"))
    both = pairs.join(side("a"), ["lead", "a"]).join(side("b"), ["lead", "b"])
    apart = F.size("of_a.diff") + F.size("of_b.diff") - 2 * F.size(F.array_intersect("of_a.diff", "of_b.diff"))
    return both.filter(alike(apart, F.col("of_a.n"), F.col("of_b.n"), ratio)).select("a", "b", F.col("of_a.label").alias("label_a"), F.col("of_b.label").alias("label_b")).distinct()


def links(members: DataFrame, compare: Callable[[DataFrame], DataFrame], ratio: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes that share a bucket, and the classes (node, label) that they form.

    members(bucket, node, mass): mass is the sum of the sizes of a node's buckets. compare gives pairs(node, lead, mass)
    with n, n_lead and diff. Only links that join different classes at the time are looked for, so the links are not
    all there are; the classes are.
    """
    lead = members.groupBy("bucket").agg(F.max_by("node", F.struct("mass", -F.col("node"))).alias("lead"))
    pairs = materialize(members.join(lead, "bucket").filter("node <> lead").groupBy("node", "lead").agg(F.first("mass").alias("mass")))
    tried = materialize(compare(pairs))
    verified = tried.filter(alike(F.size("diff"), F.col("n"), F.col("n_lead"), ratio)).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    labels = components(verified)

    def cells(of: DataFrame) -> DataFrame:
        """The cells that still hold several classes, with their labels; a cell of one node has no pair left to look for."""
        known = labelled(labelled(of, labels), labels, "lead", "lead_label").withColumn("other", F.col("label") != F.col("lead_label")).drop("lead_label")
        open_ = known.groupBy("lead").agg(F.max("other").alias("open"), F.count("*").alias("nodes")).filter("open and nodes > 1").select("lead")
        return materialize(known.join(open_, "lead"))

    open_, spent = cells(tried.select("lead", "node", "mass", "n", "diff")), None
    while True:
        others = open_.filter("other")
        n = others.count()
        if not n:
            return verified, labels
        heads = others if spent is None else others.join(spent, ["lead", "node"], "left_anti")
        heads = materialize(heads.groupBy("lead").agg(F.max_by("node", F.struct("mass", -F.col("node"))).alias("b")))
        spent = heads.withColumnRenamed("b", "node") if spent is None else spent.unionByName(heads.withColumnRenamed("b", "node"))
        head_label = labelled(heads, labels, "b", "label_b")
        found = materialize(met(open_.join(head_label, "lead").filter("label <> label_b").select("lead", F.col("node").alias("a"), "b"), open_, ratio))
        more = found.count()
        if more:
            verified, labels = verified.unionByName(found.select("a", "b")), renewed(labels, found)
            open_ = cells(open_.drop("label", "other"))
        if more * FEW < n:
            break
    found = materialize(met(rivals(open_, ratio), open_, ratio))
    if found.limit(1).count():
        verified, labels = verified.unionByName(found.select("a", "b")), renewed(labels, found)
    return verified, labels
