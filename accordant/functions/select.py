"""Exact quantiles of groups of any size, without bringing a group's values together.

Values are counted first (partial sums before the shuffle), then every group is cut at approximate quantiles of its
distinct values, which only have to be balanced. Counts of the ranges tell which range holds a rank; only the rows of
such ranges are put in order, range by range, so a task orders about 1 / PARTS of a group's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.sources.stage import sized, staged

PARTS = 64
#: Groups of at most so many rows are left to one aggregation buffer each.
WHOLE = 1_000_000


def between(at: Column, low: Column, high: Column) -> Column:
    """The value at a place between two ranks, as `percentile` computes it."""
    return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def largest(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group; rows are read for it, so they should be a stage or a table."""
    return rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """(by..., name): the array of `percentile` of the value at the shares, for every group with a value that is not null.

    Where no group is large this is one aggregation; otherwise `selected`. Both are exact. by has no nulls.
    """
    known = rows.filter(F.col(value).isNotNull())
    if largest(known, by) <= WHOLE:
        return known.groupBy(*by).agg(F.percentile(value, shares).alias(name))
    return selected(known, by, value, shares, name)


def selected(known: DataFrame, by: list[str], value: str, shares: list[float], name: str) -> DataFrame:
    each = staged(known.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c")))
    cuts = each.groupBy(*by).agg(F.sum("__c").alias("__n"), F.array_distinct(F.approx_percentile("__v", [k / PARTS for k in range(1, PARTS)], 20 * PARTS)).alias("__cuts"))
    cuts = staged(cuts)
    part = F.size(F.filter("__cuts", lambda e: e < F.col("__v")))
    placed = staged(each.join(sized(cuts.select(*by, "__cuts")), by).select(*by, "__v", "__c", part.alias("__part")))
    # at most PARTS rows a group
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "__part").agg(F.sum("__c").alias("__k")).withColumn("__below", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(s) * (F.col("__n") - 1)), F.ceil(F.lit(s) * (F.col("__n") - 1))) for s in shares])))
    wanted = cuts.select(*by, F.explode(ranks).alias("__rank")).join(sizes, by).filter("__below <= __rank and __rank < __below + __k")
    wanted = staged(wanted.select(*by, "__part", "__rank", "__below"))
    inside = placed.join(sized(wanted.select(*by, "__part").distinct()), [*by, "__part"], "left_semi")
    upto = F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy("__v"))
    ordered = inside.withColumn("__upto", upto).join(sized(wanted), [*by, "__part"])
    found = ordered.filter("__rank >= __below + __upto - __c and __rank < __below + __upto")
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))  # two ranks a share at most
    at = [F.lit(s) * (F.col("__n") - 1) for s in shares]
    got = [between(p, F.element_at("__at", F.floor(p)), F.element_at("__at", F.ceil(p))) for p in at]
    return found.join(sized(cuts.select(*by, "__n")), by).select(*by, F.array(*got).alias(name))


def medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return quantiles(rows, by, value, [0.5], "__q").select(*by, F.col("__q")[0].alias(name))
