"""Points from metrics under rule sets, bracket look-ups and rules derived from settings."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.sources.stage import sized, small, staged


def points(rules: dict[str, float]) -> Column:
    """Sum of metric x value over the rules that are not 0; gaps count as 0."""
    used = [(m, v) for m, v in rules.items() if v]
    return sum((F.coalesce(F.col(m), F.lit(0.0)) * v for m, v in used), F.lit(0.0))


#: Scopes of a block, blocks of a range.
BLOCK, RANGE = 1_000, 16


def many_rule_points(lines: DataFrame, rules: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Points of each line under each scope of rules(scope, pos, stat, points); pos null holds for every group.

    A rule of the group goes before the scope's base rule. A scope's rules are its base values, and a map of the
    values of groups that have their own. Lines meet blocks of scopes in a cross join and are scored where they meet, so the
    product of lines and scopes is neither shuffled nor aggregated. A task takes its lines through one block after the
    other: what comes out repeats the same few scopes line by line, which files hold in a fraction of the bytes that all
    scopes in a row take. A line without a metric that the scope scores is left out.
    """
    rules = rules.filter(F.col("stat").isin(metrics))
    values = F.struct(*[F.sum(F.when(F.col("stat") == m, F.col("points"))).alias(f"v{n}") for n, m in enumerate(metrics)])
    each = rules.groupBy("scope", "pos").agg(values.alias("v"))
    own = F.map_from_entries(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "v"))))
    scopes = each.groupBy("scope").agg(F.max_by("v", F.when(F.col("pos").isNull(), 1)).alias("__base"), own.alias("__own"))
    scopes = staged(scopes)
    # alike scopes are neighbours; many blocks are cut from each range, as ranges differ in size and whole blocks do not
    dealt = scopes.repartitionByRange(-(-scopes.count() // (RANGE * BLOCK)) or 1, "__base", "scope").sortWithinPartitions("__base", "scope").withColumn("__at", F.spark_partition_id())
    ranges = dealt.groupBy("__at").agg(F.collect_list(F.struct("scope", "__base", "__own")).alias("__all"))
    blocks = staged(ranges.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("__all"), F.lit(BLOCK)), lambda k: F.slice("__all", k, BLOCK))).alias("__block"))).coalesce(1)
    # a Cartesian product goes through the rows of its left side, here one partition, and for each through all lines of a task
    rows = blocks.hint("shuffle_replicate_nl").crossJoin(lines.select(*keys, "pos", *[F.col(m).alias(f"__m{n}") for n, m in enumerate(metrics)]))
    rows = rows.select(*keys, "pos", *[f"__m{n}" for n in range(len(metrics))], F.inline("__block"))
    rows = rows.withColumn("__v", F.try_element_at("__own", F.col("pos")))
    rate = [F.coalesce(F.col(f"__v.v{n}"), F.col(f"__base.v{n}")) for n in range(len(metrics))]
    scores = [F.col(f"__m{n}").isNotNull() & (F.col(f"__v.v{n}").isNotNull() | (F.col(f"__base.v{n}") != 0)) for n in range(len(metrics))]
    total = sum((F.coalesce(F.col(f"__m{n}") * r, F.lit(0.0)) for n, r in enumerate(rate)), F.lit(0.0))
    return rows.filter(F.coalesce(reduce(or_, scores), F.lit(False))).select("scope", "pos", *keys, total.alias("points"))


def bracket(value: Column, tiers: list[tuple[float, float]]) -> Column:
    """Points of the first tier whose maximum is not below value, of the last one above all; null stays null."""
    out = F.when(value.isNull(), None)
    for top, pts in sorted(tiers):
        out = out.when(value <= top, pts)
    return out.otherwise(sorted(tiers)[-1][1]) if tiers else F.lit(0.0)


#: Bins that tiers and values meet in.
BINS = 64


def tier_join(rows: DataFrame, value: str, tiers: DataFrame, name: str = "points") -> DataFrame:
    """rows(scope, value, ...) with the points of their scope's tier of tiers(scope, max_allowed, points), as `bracket` gives them.

    Tiers are intervals above the ceiling of the tier before up to their own, the last one without end. Intervals and
    values meet in bins, cut at quantiles of all ceilings, so a scope's values spread over its bins and no tier is
    compared with a value of another bin. Null values have no points, scopes without tiers give 0. Of tiers with one ceiling the one with least
    points counts, above all the one with most.
    """
    cuts = tiers.agg(F.array_distinct(F.approx_percentile("max_allowed", [k / BINS for k in range(1, BINS)], 20 * BINS)).alias("c")).first()["c"] or []
    edges = F.array(*map(F.lit, cuts)).cast("array<double>")
    bin_of = lambda c: F.size(F.filter(edges, lambda e: e < c))
    each = Window.partitionBy("scope").orderBy("max_allowed", "points")  # the tiers of one scope
    spans = tiers.select("scope", F.col("points").alias("__p"), F.lag("max_allowed").over(each).alias("__low"), F.when(F.lead("max_allowed").over(each).isNotNull(), F.col("max_allowed")).alias("__high"))
    first, last = F.coalesce(F.when(F.col("__low").isNotNull(), bin_of(F.col("__low"))), F.lit(0)), F.coalesce(F.when(F.col("__high").isNotNull(), bin_of(F.col("__high"))), F.lit(len(cuts)))
    binned = small(spans.filter("__low is null or __high is null or __low < __high").withColumn("__bin", F.explode(F.sequence(first, last))))
    at = F.when(F.col(value).isNotNull(), bin_of(F.col(value).cast("double")))
    x = rows.withColumn("__bin", at).alias("x")
    t = binned.alias("t")
    on = (F.col("x.scope") == F.col("t.scope")) & (F.col("x.__bin") == F.col("t.__bin")) & F.coalesce(F.col(f"x.{value}") > F.col("t.__low"), F.lit(True)) & F.coalesce(F.col(f"x.{value}") <= F.col("t.__high"), F.lit(True))
    known = sized(tiers.select(F.col("scope").alias("__scope")).distinct())
    out = x.join(t, on, "left").join(known, F.col("x.scope") == F.col("__scope"), "left")
    points = F.when(F.col("__scope").isNull(), 0.0).when(F.col(f"x.{value}").isNotNull(), F.col("t.__p"))
    return out.select(*[F.col(f"x.`{c}`") for c in rows.columns], points.alias(name))


def game_draw(keys: list[str], game: Column, mean: Column, sd: Column, seed: int) -> Column:
    """A normal draw for a game, rounded. It comes from a digest of key, game and seed (Box-Muller), so it doesn't depend on the order of rows."""
    uniform = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("|", *keys, game, F.lit(seed), F.lit(k))), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    return F.bround(mean + sd * (F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))))


def game_value(draw: Column) -> Column:
    """A draw, floored at 0; an unknown mean or spread leaves none, and so no total."""
    return F.when(draw < 0, 0.0).otherwise(draw)


def season_total(keys: list[str], mean: Column, sd: Column, tiers: list[tuple[float, float]], games: int = 17, seed: int = 1) -> Column:
    """The total of season_bracket for the row itself, without more rows or a shuffle; repeated rows have the same."""
    # the bracket names a value once a tier: draws are an array first, so that each is worked out once
    draws = F.transform(F.sequence(F.lit(1), F.lit(games)), lambda g: game_draw(keys, g, mean, sd, seed))
    each = F.transform(draws, lambda x: bracket(game_value(x), tiers))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def season_bracket(df: DataFrame, keys: list[str], season: Column, sd: Column, tiers: list[tuple[float, float]], games: int = 17, seed: int = 1) -> DataFrame:
    """Season total of bracket points over simulated games: normal draws around season / games, rounded, floored at 0."""
    each = df.withColumns({"mean_": season / games, "sd_": sd}).withColumn("game", F.explode(F.sequence(F.lit(1), F.lit(games))))
    value = game_value(game_draw(keys, F.col("game"), F.col("mean_"), F.col("sd_"), seed))
    return each.groupBy(*keys).agg(F.sum(bracket(value, tiers)).alias("points"))


def rules_from_settings(settings: DataFrame, direct: dict[str, str], first_present: dict[str, list[str]], largest: dict[str, list[str]], flat: tuple[str, dict[str, list[str]]], shares: tuple[str, str, dict[str, float]]) -> DataFrame:
    """(scope, stat, points) of settings(scope, key, value), one row per key.

    direct: key -> stat. first_present: stat -> keys, the first that is set counts, even if it is 0. largest: the value
    largest in size, the first of equals. flat: a key whose value is added to the largest bonus of each stat. shares:
    (stat, key, key -> share), a flat value plus the shares of others, rounded to 4 digits. Values of 0 give no rule.
    """
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))

    def top(keys: list[str]) -> Column:
        own = F.col("key").isin(keys)
        place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
        return F.max_by("value", F.when(own, F.struct(F.abs("value"), -place)))

    def first(keys: list[str]) -> Column:
        place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
        return F.min_by("value", F.when(F.col("key").isin(keys), place))

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = {s: value(k) for k, s in direct.items()} | {s: first(k) for s, k in first_present.items()} | {s: top(k) for s, k in largest.items()}
    stats |= {s: zero(value(flat[0])) + zero(top(k)) for s, k in flat[1].items()}
    stat, key, parts = shares
    stats[stat] = F.round(sum((zero(value(k)) * share for k, share in parts.items()), zero(value(key))), 4)
    wide = settings.groupBy("scope").agg(*[c.alias(s) for s, c in stats.items()])
    return wide.unpivot("scope", list(stats), "stat", "points").filter("points <> 0")


def unscored(settings: DataFrame, used: list[str]) -> DataFrame:
    """Settings with points that no rule uses."""
    known = settings.sparkSession.createDataFrame([(k,) for k in used], "key string")
    return settings.filter("value <> 0").join(F.broadcast(known), "key", "left_anti").select("scope", "key", "value")
