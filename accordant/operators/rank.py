"""Ranks, tiers, drop-off, value over replacement and uncertainty. Groups are (avg_type, pos) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions import select
from accordant.functions.select import medians
from accordant.sources.stage import small, staged


def null_rank(value: str, by: list[str]) -> Column:
    """Dense rank, highest first; nulls have none."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.dense_rank().over(w))


def percent(value: Column, by: list[Column]) -> Column:
    """(least rank - 1) / (n - 1) among values that are not null; null for one value."""
    w = Window.partitionBy(*by, value.isNull())
    return F.when(value.isNotNull() & (F.count(value).over(w) > 1), F.percent_rank().over(w.orderBy(value)))


#: Ranges that the values of one large group are ranked in.
PARTS = 64


def spread_rank(table: DataFrame, value: str, by: list[str], name: str = "rank", parts: int = PARTS) -> DataFrame:
    """table with the dense rank of value within `by`, highest first, nulls without one: the same as null_rank, for groups of any size.

    Values are cut into `parts` ranges at approximate quantiles, which only have to be balanced. A value's rank is its
    rank in its range plus the distinct values of the ranges above: one window task a range, and one row a range for
    the sums. The quantiles are computed first, so table should be a stage or a table that is read cheaply.
    """
    edges = sorted(set(table.approxQuantile(value, [k / parts for k in range(1, parts)], 0.5 / parts)))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0)
    placed = table.withColumn("__part", F.when(F.col(value).isNotNull(), at))
    sizes = placed.filter(F.col(value).isNotNull()).groupBy(*by, "__part").agg(F.count_distinct(value).alias("__n"))
    above = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(sizes.withColumn("__above", above).drop("__n"), [*by, "__part"], "left")
    own = F.dense_rank().over(Window.partitionBy(*by, "__part").orderBy(F.col(value).desc()))
    return placed.withColumn(name, F.when(F.col(value).isNotNull(), (F.col("__above") + own).cast("int"))).drop("__part", "__above")


def ladder(table: DataFrame, value: str, by: list[str], parts: int = PARTS) -> DataFrame:
    """(by..., value, __count, __total, __rank, __above, __next): one row per distinct value of a group, for groups of any size.

    __count rows have the value, __total the group, __above are higher; __rank is the dense rank from the top, __next the
    next two lower values, each a struct of v and its rows c. Rows are counted by value first, so ties meet in no task.
    Each group is cut in ranges at approximate quantiles of its values; a range is put in order by itself, and the sums
    and the first two values of the ranges beside it are carried over its border. by has no nulls, null values are left out.
    """
    known = table.filter(F.col(value).isNotNull())
    values = staged(known.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c")))
    cuts = F.array_distinct(F.approx_percentile("__v", [k / parts for k in range(1, parts)], 20 * parts))
    groups = small(values.groupBy(*by).agg(cuts.alias("__cuts"), F.sum("__c").alias("__total")))
    part = F.size(F.filter("__cuts", lambda e: e < F.col("__v")))
    placed = values.join(groups, by).select(*by, "__v", "__c", "__total", part.alias("__part"))
    own = Window.partitionBy(*by, "__part").orderBy(F.col("__v").desc())
    pair = F.struct(F.col("__v").alias("v"), F.col("__c").alias("c"))
    ordered = staged(placed.withColumns({"__n": F.row_number().over(own), "__upto": F.sum("__c").over(own), "__own": F.collect_list(pair).over(own.rowsBetween(1, 2))}))
    ends = ordered.groupBy(*by, "__part").agg(F.max("__n").alias("__k"), F.max("__upto").alias("__rows"), F.sort_array(F.collect_list(F.when(F.col("__n") <= 2, pair)), asc=False).alias("__tops"))
    # at most `parts` rows a group
    across = Window.partitionBy(*by).orderBy(F.col("__part").desc())
    higher = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"__ranks": F.coalesce(F.sum("__k").over(higher), F.lit(0)), "__more": F.coalesce(F.sum("__rows").over(higher), F.lit(0)), "__low": F.flatten(F.collect_list("__tops").over(across.rowsBetween(1, 2)))}
    out = ordered.join(small(ends.select(*by, "__part", *[c.alias(n) for n, c in carried.items()])), [*by, "__part"])
    return out.select(
        *by, F.col("__v").alias(value), F.col("__c").alias("__count"), "__total", (F.col("__ranks") + F.col("__n")).cast("int").alias("__rank"), (F.col("__more") + F.col("__upto") - F.col("__c")).alias("__above"),
        F.slice(F.concat("__own", "__low"), 1, 2).alias("__next"),
    )


def zscored(table: DataFrame, values: dict[str, str], by: list[str]) -> DataFrame:
    """table with a z-score per name of values (name -> column): one aggregation, joined back; null where the spread is 0 or unknown."""
    stats = table.groupBy(*by).agg(*[f(c).alias(f"__{k}_{name}") for name, c in values.items() for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = table.join(stats, by)
    out = out.withColumns({name: (F.col(c) - F.col(f"__m_{name}")) / F.nullif(F.col(f"__s_{name}"), F.lit(0.0)) for name, c in values.items()})
    return out.drop(*[f"__{k}_{name}" for name in values for k in "ms"])


#: Steps of tiers, in typical spreads, of groups that differ from 1.
DEFAULT_THRESHOLDS = {"DST": 0.1}


def rank_and_tier(table: DataFrame, thresholds: dict[str, float], default: float = 1.0) -> DataFrame:
    """pos_rank, dropoff (points above the mean of the next two, 0 for the last) and tier; ids are unique in a group.

    Windows by group while no group has more than select.WHOLE rows; beyond it ladders, with the same result.
    """
    group = ["avg_type", "pos"]
    scale = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv]), F.col("pos")), F.lit(default)) if thresholds else F.lit(default)
    table = staged(table)
    stats = table.groupBy(*group).agg(F.max("points").alias("best")).join(medians(table, group, "sd_pts", "typical"), group, "left")
    stats = small(stats.withColumn("step", F.col("typical") * scale).drop("typical"))
    fallen = F.when(F.col("step") > 0, ((F.col("best") - F.col("points")) / F.col("step")).cast("bigint")).otherwise(0)
    if select.largest(table, group) > select.WHOLE:
        return _spread_tiers(table, stats, fallen, group)
    w = Window.partitionBy(*group).orderBy(F.col("points").desc(), "id")
    table = table.withColumn("pos_rank", null_rank("points", group))
    one, two = F.lead("points", 1).over(w), F.lead("points", 2).over(w)
    table = table.withColumn("dropoff", F.coalesce(F.col("points") - (one + F.coalesce(two, one)) / 2, F.lit(0.0)))
    table = table.join(stats, group).withColumn("fallen", fallen)
    return table.withColumn("tier", F.dense_rank().over(Window.partitionBy(*group).orderBy("fallen"))).drop("fallen", "step", "best")


def _spread_tiers(table: DataFrame, stats: DataFrame, fallen: Column, group: list[str]) -> DataFrame:
    """rank_and_tier by distinct values: of equal points only the two last ids are followed by lower ones."""
    key = [*group, "points"]
    steps = staged(ladder(table, "points", group).join(stats, group).withColumn("__left", -fallen))
    tiers = ladder(steps.select(*group, "__left").distinct(), "__left", group).select(*group, "__left", F.col("__rank").alias("tier"))
    ties = staged(table.groupBy(*key).agg(F.max("id").alias("__last"), F.min("id").alias("__first"), F.count("*").alias("__n")))
    third = table.join(ties.filter("__n > 2"), key).filter(F.col("id") < F.col("__last")).groupBy(*key).agg(F.max("id").alias("__before"))
    ties = ties.join(third, key, "left").withColumn("__second", F.when(F.col("__n") == 2, F.col("__first")).otherwise(F.col("__before")))
    values = steps.join(tiers, [*group, "__left"]).join(ties.select(*key, "__last", "__second"), key)
    out = table.join(values.select(*key, F.col("__rank").alias("pos_rank"), "tier", "__next", "__last", "__second"), key, "left")
    low, second = F.get("__next", 0), F.get("__next", 1)
    then = F.when(low["c"] > 1, low["v"]).otherwise(second["v"])
    one = F.when(F.col("id") == F.col("__last"), low["v"]).otherwise(F.col("points"))
    two = F.when(F.col("id") == F.col("__last"), then).when(F.col("id") == F.col("__second"), low["v"]).otherwise(F.col("points"))
    out = out.withColumn("dropoff", F.coalesce(F.col("points") - (one + F.coalesce(two, one)) / 2, F.lit(0.0)))
    return out.drop("__next", "__last", "__second")


#: Baselines of groups that a scope names none for.
DEFAULT_BASELINES = {"QB": 13, "RB": 35, "WR": 36, "TE": 13, "K": 8, "DST": 3, "DL": 10, "LB": 10, "DB": 10}


def over_replacement(table: DataFrame, baselines: DataFrame, defaults: dict[str, int] | None = None) -> DataFrame:
    """points_vor, floor_vor and ceiling_vor against the best value ranked beyond the group's baseline, else the worst.

    baselines(pos, baseline); groups without one take the default of their name (DEFAULT_BASELINES), else 1. The overall
    rank is spread_rank by points_vor within avg_type.
    """
    group = ["avg_type", "pos"]
    defaults = DEFAULT_BASELINES if defaults is None else defaults
    known = F.element_at(F.create_map(*[F.lit(v) for kv in defaults.items() for v in kv]), F.col("pos")) if defaults else F.lit(None).cast("int")
    table = table.join(baselines, "pos", "left").withColumn("baseline", F.coalesce("baseline", known, F.lit(1)))
    names = ("points", "floor", "ceiling")
    most = table.agg(F.max("baseline")).first()[0] or 1
    # one row a value before they are ranked, and of these the first of each group only: a task gives most + 1 rows a group
    values = table.select(*group, "baseline", F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in names])).alias("v")).select(*group, "baseline", "v.*")
    values = values.filter("value is not null").groupBy(*group, "of", "value").agg(F.max("baseline").alias("baseline"))
    first = F.row_number().over(Window.partitionBy(*group, "of").orderBy(F.col("value").desc()))
    beyond = values.withColumn("n", first).filter(F.col("n") <= int(most) + 1).filter("n > baseline").groupBy(*group, "of").agg(F.max("value").alias("base"))
    worst = values.groupBy(*group, "of").agg(F.min("value").alias("worst"))
    base = worst.join(beyond, [*group, "of"], "left").groupBy(*group).agg(*[F.max(F.when(F.col("of") == c, F.coalesce("base", "worst"))).alias(f"{c}_base") for c in names])
    table = table.join(small(base), group, "left")
    table = table.withColumns({f"{c}_vor": F.col(c) - F.col(f"{c}_base") for c in names}).drop("baseline", *[f"{c}_base" for c in names])
    return table


def uncertainty(table: DataFrame) -> DataFrame:
    """1 to 99 from the spreads sd_pts and sd_ecr, by group with all methods pooled.

    Means and spreads are aggregations joined back; the percent rank is a window while no group has more than
    select.WHOLE rows, and a ladder beyond it.
    """
    table = zscored(table, {"z1": "sd_pts", "z2": "sd_ecr"}, ["pos"])
    table = table.withColumn("z0", F.coalesce((F.col("z1") + F.col("z2")) / 2, "z1", "z2"))
    table = staged(zscored(table, {"z": "z0"}, ["pos"]).withColumn("z", F.round("z", 10)))
    if select.largest(table, ["pos"]) > select.WHOLE:
        below = F.col("__total") - F.col("__above") - F.col("__count")
        shares = ladder(table, "z", ["pos"]).select("pos", "z", F.when(F.col("__total") > 1, below / (F.col("__total") - 1)).alias("__share"))
        table, share = table.join(shares, ["pos", "z"], "left"), F.col("__share")
    else:
        share = percent(F.col("z"), [F.col("pos")])
    score = F.least(F.lit(99), F.greatest(F.lit(1), F.bround(share * 100).cast("int")))
    return table.withColumn("uncertainty", F.when(F.col("z").isNotNull() & share.isNotNull(), score)).drop("z0", "z1", "z2", "z", "__share")
