"""One estimate per entity from several sources: average, robust and weighted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.select import medians
from accordant.functions.stats import hodges_lehmann, mad, weighted_bounds
from accordant.sources.stage import sized, small, staged

KEYS = ("pos", "id")
#: Half the width of a 90 % interval in standard deviations.
HALF_WIDTH = 1.645


def average(scored: DataFrame) -> DataFrame:
    """Mean, sample sd, 5 and 95 % quantiles and number of sources of scored(pos, id, points)."""
    q = F.percentile("points", [0.05, 0.95])
    return scored.groupBy(*KEYS).agg(F.avg("points").alias("points"), F.stddev_samp("points").alias("sd_pts"), q[0].alias("floor"), q[1].alias("ceiling"), F.count("points").alias("sources"))


def robust(scored: DataFrame) -> DataFrame:
    """Hodges-Lehmann centre, scaled MAD and the same quantiles."""
    q = F.percentile("points", [0.05, 0.95])
    some = scored.groupBy(*KEYS).agg(F.collect_list("points").alias("v"), q[0].alias("floor"), q[1].alias("ceiling"), F.count("points").alias("sources"))
    return some.select(*KEYS, hodges_lehmann(F.col("v")).alias("points"), mad(F.col("v")).alias("sd_pts"), "floor", "ceiling", "sources")


def with_weights(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """scored with w from weights(data_src, weight); a group in which no weight is positive weighs all alike."""
    known = scored.join(sized(weights), "data_src", "left").withColumn("w", F.coalesce("weight", F.lit(0.0)))
    some = known.groupBy("pos").agg(F.max(F.col("w") > 0).alias("some"))
    return known.join(small(some), "pos").withColumn("w", F.when(F.col("some"), F.col("w")).otherwise(1.0)).drop("some", "weight")


def weighted(scored: DataFrame, weights: DataFrame, quantiles: bool = True) -> DataFrame:
    """Weighted mean, reliability-weighted sd and Harrell-Davis quantiles; weights of 0 or less drop out."""
    rows = with_weights(scored, weights)
    use = (F.col("w") > 0) & F.col("points").isNotNull()
    pair = F.collect_list(F.when(use, F.struct(F.col("points").alias("x"), "w")))
    some = rows.groupBy(*KEYS).agg(pair.alias("v"), F.count("points").alias("sources"))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, e: a + f(e))
    some = some.withColumns({"s1": total(lambda e: e["w"]), "s2": total(lambda e: e["w"] * e["w"]), "sx": total(lambda e: e["w"] * e["x"])})
    some = some.withColumn("points", F.col("sx") / F.nullif(F.col("s1"), F.lit(0.0)))
    spread = F.aggregate(F.transform("v", lambda e: e["w"] * (e["x"] - F.col("points")) * (e["x"] - F.col("points"))), F.lit(0.0), lambda a, x: a + x)
    under = F.col("s1") * F.col("s1") - F.col("s2")
    sd = F.when(F.size("v") > 1, F.sqrt(F.col("s1") / F.nullif(under, F.lit(0.0)) * spread))
    out = some.withColumn("sd_pts", sd)
    if quantiles:
        part = lambda f: F.transform("v", lambda e: e[f])
        out = out.withColumn("b", weighted_bounds(part("x"), part("w"))).select("*", "b.floor", "b.ceiling")
    return out.select(*KEYS, "points", "sd_pts", *(["floor", "ceiling"] if quantiles else []), "sources")


def borrow_spread(summary: DataFrame, group: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Entities of one source without a spread take the median spread of entities with several."""
    summary = staged(summary)
    typical = medians(summary.filter("sources > 1"), list(group), "sd_pts", "typical")
    solo = (F.col("sources") == 1) & F.col("sd_pts").isNull() & F.col("typical").isNotNull()
    out = summary.join(small(typical), list(group), "left")
    half = HALF_WIDTH * F.col("typical")
    new = {"floor": F.greatest(F.lit(0.0), F.col("points") - half), "ceiling": F.col("points") + half, "sd_pts": F.col("typical")}
    return out.withColumns({c: F.when(solo, v).otherwise(F.col(c)) for c, v in new.items()}).drop("typical")


#: Methods by name: (scored, weights) -> (pos, id, points, sd_pts, floor, ceiling, sources). A caller may add its own.
METHODS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "average": lambda scored, weights: average(scored),
    "robust": lambda scored, weights: robust(scored),
    "weighted": lambda scored, weights: weighted(scored, weights),
}


def by_entity(scored: DataFrame) -> DataFrame:
    """scored, dealt out by entity. The number of tasks is named: an entity is few bytes and much work, and Spark would join tasks by their bytes."""
    return scored.repartition(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)


def consensus(scored: DataFrame, weights: DataFrame, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """Methods as rows (avg_type), with borrowed spreads and entities of finite, positive points only."""
    # one exchange serves the aggregations of all methods
    scored, rows = by_entity(scored), None
    for name in methods:
        df = METHODS[name](scored, weights).withColumn("avg_type", F.lit(name))
        rows = df if rows is None else rows.unionByName(df)
    return finite_positive(borrow_spread(rows, ("avg_type", "pos")))


def finite_positive(table: DataFrame) -> DataFrame:
    """Rows whose points are a finite number above 0: NaN and infinity compare as greater, so both are named."""
    return table.filter((F.col("points") > 0) & ~F.isnan("points") & (F.col("points") < float("inf")))


def one_method(table: DataFrame, preferred: str = "weighted") -> DataFrame:
    """Rows of one averaging method: the preferred if it is there, else the first by name."""
    chosen = table.agg(F.coalesce(F.max(F.when(F.col("avg_type") == preferred, preferred)), F.min("avg_type")).alias("avg_type"))
    return table.join(F.broadcast(chosen), "avg_type", "left_semi")  # one row


def source_table(values: DataFrame, metric: str, sources: list[str]) -> DataFrame:
    """A column per source beside mean, sd and number: all sources meet in one aggregation, not in a chain of joins.

    Of several values of one source for an entity the least counts. Order the result by the metric, upwards for a draft
    position, downwards for a value.
    """
    each = values.filter(F.col("id").isNotNull()).groupBy("id", "data_src").agg(F.min(metric).alias(metric))
    per = [F.max(F.when(F.col("data_src") == s, F.col(metric))).alias(f"{metric}_{s.lower()}") for s in sources]
    each = each.filter(F.col("data_src").isin(*sources))
    # means halfway between two decimals are off by the last bit, to either side: 8 digits first, so that halves go up
    mean, sd = F.round(F.avg(metric), 8), F.round(F.stddev_samp(metric), 8)
    return each.groupBy("id").agg(*per, F.round(mean, 1).alias(metric), F.round(sd, 2).alias(f"{metric}_sd"))


def source_values(values: DataFrame, metric: str) -> DataFrame:
    """Mean (1 digit), sd (2 digits) and number over sources of values(id, data_src, metric)."""
    return values.groupBy("id").agg(F.round(F.avg(metric), 1).alias(metric), F.round(F.stddev_samp(metric), 2).alias(f"{metric}_sd"), F.count(metric).alias("sources"))
