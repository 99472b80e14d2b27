"""Rule sets as tables: vocabulary, defaults, overrides, and what a platform's settings say beyond plain values.

rules(scope, pos, stat, points): pos null holds for every group, others are overlays. settings(scope, key, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every stat that can carry points, by kind.
VOCABULARY = {
    "passing": "pass_att pass_comp pass_inc pass_yds pass_tds pass_int pass_40_yds pass_300_yds pass_350_yds pass_400_yds pass_fd",
    "rushing": "rush_att rush_yds rush_tds rush_40_yds rush_100_yds rush_150_yds rush_200_yds rush_fd",
    "receiving": "rec rec_tgt rec_yds rec_tds rec_40_yds rec_100_yds rec_150_yds rec_200_yds rec_fd",
    "misc": "fumbles_lost fumbles_total sacks two_pts",
    "kicking": "xp xp_miss fg_0019 fg_2029 fg_3039 fg_4049 fg_50 fg_miss",
    "returns": "return_tds return_yds",
    "idp": "idp_solo idp_asst idp_sack idp_int idp_fum_force idp_fum_rec idp_pd idp_td idp_safety",
    "dst": "dst_sacks dst_int dst_fum_rec dst_fum_force dst_safety dst_td dst_blk dst_ret_yds dst_pts_allowed",
}
#: Points of the default rule set, and its brackets (up to, points).
DEFAULTS = {
    "pass_yds": 0.04, "pass_tds": 4.0, "pass_int": -3.0, "rush_yds": 0.1, "rush_tds": 6.0, "rec": 0.0, "rec_yds": 0.1, "rec_tds": 6.0, "fumbles_lost": -3.0, "two_pts": 2.0,
    "xp": 1.0, "fg_0019": 3.0, "fg_2029": 3.0, "fg_3039": 3.0, "fg_4049": 4.0, "fg_50": 5.0, "return_tds": 6.0, "idp_solo": 1.0, "idp_asst": 0.5, "idp_sack": 2.0, "idp_int": 3.0,
    "idp_fum_force": 3.0, "idp_fum_rec": 2.0, "idp_pd": 1.0, "idp_td": 6.0, "idp_safety": 2.0, "dst_sacks": 1.0, "dst_int": 2.0, "dst_fum_rec": 2.0, "dst_safety": 2.0, "dst_td": 6.0, "dst_blk": 1.5,
}
DEFAULT_BRACKETS = [(0.0, 10.0), (6.0, 7.0), (20.0, 4.0), (34.0, 0.0), (float("inf"), -4.0)]


def unknown_stats(rules: DataFrame, vocabulary: dict[str, str] = VOCABULARY) -> DataFrame:
    """(scope, stat) of rules whose stat is no word of the vocabulary; a valid table gives no rows."""
    known = [s for words in vocabulary.values() for s in words.split()]
    return rules.filter(~F.col("stat").isin(*known)).select("scope", "stat").distinct()


def checked(rules: DataFrame, vocabulary: dict[str, str] = VOCABULARY) -> DataFrame:
    """rules, or an error that names stats that are not in the vocabulary (at most ten of them are read)."""
    bad = [r.stat for r in unknown_stats(rules, vocabulary).select("stat").distinct().orderBy("stat").limit(10).collect()]
    if bad:
        raise ValueError(f"stats that are not in the vocabulary: {', '.join(bad)}")
    return rules


def for_groups(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """(scope, pos, stat, points) of every group of groups(scope, pos): the overlay's value, else the base one."""
    base = groups.join(rules.filter("pos is null").select("scope", "stat", F.col("points").alias("base")), "scope")
    own = groups.join(rules.filter("pos is not null").select("scope", "pos", "stat", F.col("points").alias("own")), ["scope", "pos"])
    return base.join(own, ["scope", "pos", "stat"], "full").select("scope", "pos", "stat", F.coalesce("own", "base").alias("points"))


def format_labels(rules: DataFrame, groups: DataFrame, stat: str = "rec") -> DataFrame:
    """(scope, pos, per_reception, label) of groups(scope, pos): PPR above 0.5 points, Half above 0, else Std."""
    known = for_groups(rules, groups).filter(F.col("stat") == stat).select("scope", "pos", F.col("points").alias("per_reception"))
    out = groups.join(known, ["scope", "pos"], "left").withColumn("per_reception", F.coalesce("per_reception", F.lit(0.0)))
    return out.withColumn("label", F.when(F.col("per_reception") > 0.5, "PPR").when(F.col("per_reception") > 0, "Half").otherwise("Std"))


def overridden(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules with base values replaced or added by changes(scope, stat, points)."""
    new = changes.select("scope", F.lit(None).cast("string").alias("pos"), "stat", "points")
    kept = rules.join(changes.select("scope", "stat", F.lit(True).alias("__new")), ["scope", "stat"], "left").filter("pos is not null or __new is null")
    return kept.select("scope", "pos", "stat", "points").unionByName(new)


def tier_table(settings: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """(scope, max_allowed, points) of the settings that are brackets, a row a tier, for `score.tier_join`."""
    top = F.element_at(F.create_map(*[F.lit(v) for kv in ceilings.items() for v in kv]), F.col("key"))
    return settings.filter(F.col("key").isin(*ceilings)).select("scope", top.alias("max_allowed"), F.col("value").alias("points"))


def bracket_tiers(settings: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """(scope, tiers array<struct<max_allowed, points>>) of the settings that are brackets, in rising order; a setting of 0 is a tier."""
    rows = tier_table(settings, ceilings).select("scope", F.struct("max_allowed", "points").alias("tier"))
    return rows.groupBy("scope").agg(F.array_sort(F.collect_list("tier")).alias("tiers"))


def tier_points(value: Column, tiers: Column) -> Column:
    """Points of the first tier that holds value, of the last one above all; null stays null, and no tiers give 0."""
    fits = F.filter(tiers, lambda t: value <= t["max_allowed"])
    found = F.coalesce(F.get(fits, 0)["points"], F.element_at(tiers, -1)["points"])
    return F.when(F.coalesce(F.size(tiers), F.lit(0)) < 1, 0.0).when(value.isNotNull(), found)


def overlays_from_settings(settings: DataFrame, rules: DataFrame, bonuses: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(scope, pos, stat, points) for bonuses: key -> (pos, stats). Each adds the setting to the scope's base value of the stat (0 without one); 0 adds no overlay."""
    named = F.create_map(*[x for k, (pos, stats) in bonuses.items() for x in (F.lit(k), F.struct(F.lit(pos).alias("pos"), F.array(*map(F.lit, stats)).alias("stats")))])
    rows = settings.filter("value <> 0").withColumn("b", F.element_at(named, F.col("key")))
    rows = rows.filter("b is not null").select("scope", "b.pos", F.explode("b.stats").alias("stat"), "value")
    base = rules.filter("pos is null").select("scope", "stat", F.col("points").alias("base"))
    return rows.join(base, ["scope", "stat"], "left").select("scope", "pos", "stat", (F.coalesce("base", F.lit(0.0)) + F.col("value")).alias("points"))


def left_over(settings: DataFrame, used: list[str], unprojectable: list[str], prefixes: list[str]) -> DataFrame:
    """(scope, key, value, reason) of settings with points that no rule uses: known to have no metric, by key or by prefix, or not mapped."""
    by_prefix = F.lit(False)
    for p in prefixes:
        by_prefix = by_prefix | F.startswith("key", F.lit(p))
    reason = F.when(F.col("key").isin(*unprojectable), "no_metric").when(by_prefix, "prefix").otherwise("unmapped")
    return settings.filter((F.col("value") != 0) & ~F.col("key").isin(*used)).select("scope", "key", "value", reason.alias("reason"))
