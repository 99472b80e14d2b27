"""Filling gaps of metrics: from the entity's other sources, from rates, from the group, from similar entities.

Frames hold one row per (pos, id, data_src). A null is a gap, a published zero stays. Windows are per entity (a few
rows each); numbers of a whole group come from an aggregation that is joined back by broadcast (one row per group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.select import medians, quantiles
from accordant.sources.stage import small

ENTITY = ("pos", "id")


def mean_fill(df: DataFrame, metric: str) -> DataFrame:
    """Gaps get the mean of the entity's other sources."""
    return df.withColumn(metric, F.coalesce(metric, F.avg(metric).over(Window.partitionBy(*ENTITY))))


def rate_fill(df: DataFrame, metric: str, reference: str, fallback: Column | None = None) -> DataFrame:
    """Gaps get the entity's mean of metric / reference times the row's reference.

    With no known value the fallback rate (of the group) counts. A known value over a reference of 0, or no known
    reference, makes rates useless: then the mean fills.
    """
    w = Window.partitionBy(*ENTITY)
    m, r = F.col(metric), F.col(reference)
    known = F.count(m).over(w)
    zero = F.max(F.coalesce(m.isNotNull() & (r == 0), F.lit(False))).over(w)
    rate = F.avg(m / F.nullif(r, F.lit(0.0))).over(w)
    mean = F.avg(m).over(w)
    fill = F.when(known == 0, r * (fallback if fallback is not None else F.lit(None).cast("double")))
    return df.withColumn(metric, F.coalesce(m, fill.when(zero | rate.isNull(), mean).otherwise(r * rate)))


def group_rates(df: DataFrame, metric: str, reference: Column, name: str = "group_rate") -> DataFrame:
    """Per group sum(metric) / sum(reference) over rows that have both; null where the latter is 0."""
    both = F.col(metric).isNotNull() & reference.isNotNull()
    total = F.sum(F.when(both, reference))
    return df.groupBy("pos").agg((F.sum(F.when(both, F.col(metric))) / F.nullif(total, F.lit(0.0))).alias(name))


def group_rate_fill(df: DataFrame, metric: str, reference: str) -> DataFrame:
    """rate_fill with the group's rate for entities that no source covers."""
    joined = df.join(small(group_rates(df, metric, F.col(reference))), "pos")
    return rate_fill(joined, metric, reference, F.col("group_rate")).drop("group_rate")


def touch_rate_fill(df: DataFrame, metric: str, touches: list[str]) -> DataFrame:
    """Gaps get the group's rate per touch times the row's touches (null if it has none)."""
    any_ = F.coalesce(*touches).isNotNull()
    touch = F.when(any_, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in touches[1:]), F.coalesce(F.col(touches[0]), F.lit(0.0))))
    joined = df.join(small(group_rates(df, metric, touch)), "pos")
    return joined.withColumn(metric, F.coalesce(metric, touch * F.col("group_rate"))).drop("group_rate")


def decile_fill(df: DataFrame, metric: str, by: str) -> DataFrame:
    """Gaps get the median of the rows in the same decile of `by` in the group, then the group's median.

    Deciles are cut at the group's exact quantiles, right-closed, equal cuts merged; rows without `by` are a bucket.
    """
    cuts = quantiles(df, ["pos"], by, [k / 10 for k in range(11)], "cuts")
    inner = F.filter(F.array_distinct("cuts"), lambda e: e < F.col(by))
    placed = df.join(small(cuts), "pos", "left").withColumn("bucket", F.when(F.col(by).isNull(), -1).otherwise(F.greatest(F.size(inner) - 1, F.lit(0))))
    near, whole = medians(placed, ["pos", "bucket"], metric, "near"), medians(df, ["pos"], metric, "whole")
    out = placed.join(small(near), ["pos", "bucket"], "left").join(small(whole), "pos", "left")
    return out.withColumn(metric, F.coalesce(metric, "near", "whole")).drop("cuts", "bucket", "near", "whole")


#: Shares of the ranges in a combined range.
COMBINED = {"fg_0019": 0.04, "fg_2029": 0.38, "fg_3039": 0.58}
RANGES = ("fg_0019", "fg_2029", "fg_3039", "fg_4049", "fg_50")


MISSES = ("fg_miss_0019", "fg_miss_2029", "fg_miss_3039", "fg_miss_4049", "fg_miss_50")


def total_of(columns: list[str]) -> Column:
    """Sum of what is there; null if nothing is."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    return F.when(F.coalesce(*columns).isNotNull(), sum(parts[1:], parts[0]))


def reconcile_kicking(df: DataFrame) -> DataFrame:
    """Totals, misses and attempts that sources publish in different forms, each derived from the others where it is absent."""
    def col(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")

    df = df.withColumns({c: F.coalesce(col(c), col("fg_0039") * share) for c, share in COMBINED.items()})
    df = df.withColumns({c: col(c) for c in (*RANGES, "fg", "fg_att", "fg_miss", "xp", "xp_att", "xp_miss")})
    df = df.withColumn("fg", F.coalesce("fg", total_of([*RANGES])))
    if missed := [c for c in MISSES if c in df.columns]:
        df = df.withColumn("fg_miss", F.coalesce("fg_miss", total_of(missed)))
    df = df.withColumn("fg_att", F.coalesce("fg_att", F.col("fg") / F.nullif(col("fg_pct") * 0.01, F.lit(0.0)), F.col("fg") + F.col("fg_miss")))
    df = df.withColumn("fg_miss", F.coalesce("fg_miss", F.col("fg_att") - F.col("fg")))
    df = df.withColumn("xp_miss", F.coalesce("xp_miss", F.col("xp_att") - F.col("xp")))
    return df.withColumn("xp_att", F.coalesce("xp_att", F.col("xp") + F.col("xp_miss"))).drop("fg_0039")


def missed_kicks_fill(df: DataFrame) -> DataFrame:
    """Misses are attempts less makes where both are known; the other gaps are filled by their rate to makes."""
    return group_rate_fill(df.withColumn("fg_miss", F.coalesce("fg_miss", F.col("fg_att") - F.col("fg"))), "fg_miss", "fg")


def floored(c: Column) -> Column:
    """At least 0; null stays null (greatest would skip it)."""
    return F.when(c < 0, 0.0).otherwise(c)


def linear_estimate(df: DataFrame, models: dict[str, tuple[float, str, float]], rollups: dict[str, list[str]]) -> DataFrame:
    """Counts of milestones: max(0, intercept + slope x metric) in gaps, then nested thresholds added up.

    All sums use the values from before any of them, so 300+ gets 300, 350 and 400 as estimated. Parts that are no
    column count as nothing, parts that are count whether they are scored or not.
    """
    have = df.columns
    new = {name: F.coalesce(*([F.col(name)] if name in have else []), floored(F.lit(a) + F.col(metric) * b)) for name, (a, metric, b) in models.items()}
    df = df.withColumns(new)
    have = df.columns
    return df.withColumns({n: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts if c in have), F.lit(0.0)) for n, parts in rollups.items() if n in models})


def first_downs(df: DataFrame, rates: dict[str, float], metric: str, source: str) -> DataFrame:
    """Gaps of metric get max(0, rate of the group x source); groups without a rate stay as they are."""
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in rates.items() for v in kv]), F.col("pos"))
    return df.withColumn(metric, F.coalesce(metric, floored(F.col(source) * rate)))


def carry_first_downs(df: DataFrame, attempts: str, games: Column, ladder: list[tuple[float, float]], last: float) -> Column:
    """Attempts times a rate that rises with attempts per game (at least one game); ladder of (per game up to, rate).

    Attempts per game are rounded before they meet the ladder: where they come from a mean, its last bits depend on the
    order of summation, and must not decide on which side of an edge a line falls.
    """
    per_game = F.round(F.col(attempts) / F.greatest(F.lit(1.0), games), 9)
    out = F.when(per_game < ladder[0][0], ladder[0][1])
    for top, rate in ladder[1:]:
        out = out.when(per_game <= top, rate)
    return floored(F.col(attempts) * out.otherwise(last))


#: First downs per yard by group, with the yardage they come from, and a passer's carries (per game up to, rate).
FIRST_DOWN_RATES = {
    "pass_fd": ({"QB": 0.0483}, "pass_yds"),
    "rush_fd": ({"RB": 0.0508, "WR": 0.0508, "TE": 0.0508}, "rush_yds"),
    "rec_fd": ({"RB": 0.045, "WR": 0.0483, "TE": 0.0503}, "rec_yds"),
}
CARRY_RATES, MOST_CARRIES, SEASON_GAMES = [(2.0, 0.261), (4.0, 0.342)], 0.378, 17.0


def scored_first_downs(df: DataFrame, scored: dict[str, list[str]], games: DataFrame | None = None, weekly: bool = False, passer: str = "QB") -> DataFrame:
    """First downs that rules score (scored: group -> metrics) in gaps: from yards, and for a passer's runs from carries per game.

    Games are those of games(id, games) for a season, else the line's own, else 17 (1 for a week), at least 1. Gaps of a
    passer's carries are filled at the mean rate of all passers' lines, or their mean where that rate is of no use.
    """
    for stat, (rates, source) in FIRST_DOWN_RATES.items():
        rates = {pos: rate for pos, rate in rates.items() if stat in scored.get(pos, [])}
        if rates and source in df.columns:
            have = df if stat in df.columns else df.withColumn(stat, F.lit(None).cast("double"))
            df = first_downs(have, rates, stat, source)
    if "rush_fd" not in scored.get(passer, []) or "rush_att" not in df.columns:
        return df
    own = F.col("pos") == passer
    attempts = F.col("rush_att")
    if "rush_yds" in df.columns:
        known, yards = F.col("rush_att").isNotNull(), F.col("rush_yds")
        rate = F.when(F.max(F.coalesce(known & (yards == 0), F.lit(False))), None).otherwise(F.avg(F.when(known, F.col("rush_att") / F.nullif(yards, F.lit(0.0)))))
        one = df.filter(own).agg(rate.alias("__rate"), F.avg("rush_att").alias("__mean"))
        df = df.join(F.broadcast(one))  # one row
        attempts = F.coalesce(attempts, F.when(F.col("__rate").isNotNull(), F.col("__rate") * yards).otherwise(F.col("__mean")))
    df = df.withColumn("__att", attempts)
    played = [F.when(F.col("games") > 0, F.col("games").cast("double"))] if "games" in df.columns else []
    if games is not None and not weekly:
        df = df.join(games.select("id", F.col("games").cast("double").alias("__games")), "id", "left")
        played.insert(0, F.col("__games"))
    estimate = carry_first_downs(df, "__att", F.coalesce(*played, F.lit(1.0 if weekly else SEASON_GAMES)), CARRY_RATES, MOST_CARRIES)
    have = F.col("rush_fd") if "rush_fd" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("rush_fd", F.coalesce(have, F.when(own & F.col("__att").isNotNull(), estimate)))
    return df.drop("__att", "__rate", "__mean", "__games")


def unfilled(df: DataFrame, scored: dict[str, list[str]]) -> DataFrame:
    """(pos, metric, n) of scored metrics (group -> metrics) that still have n gaps, from one aggregation; no rows if all are filled."""
    used = [m for m in dict.fromkeys(m for own in scored.values() for m in own) if m in df.columns]
    if not used:
        return df.sparkSession.createDataFrame([], "pos string, metric string, n long")
    counts = df.filter(F.col("pos").isin(*scored)).groupBy("pos").agg(*[F.count_if(F.col(m).isNull()).alias(m) for m in used])
    owned = F.create_map(*[x for pos, own in scored.items() for x in (F.lit(pos), F.array(*map(F.lit, own)).cast("array<string>"))])
    return counts.unpivot("pos", used, "metric", "n").filter((F.col("n") > 0) & F.array_contains(F.element_at(owned, F.col("pos")), F.col("metric")))
