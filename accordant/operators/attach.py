"""Joins that put attributes, rankings, draft values and holders beside a board. Every joined side has one row a key, so rows never multiply.

Sides are dimension tables whose size is not known here, so no join is hinted: Spark broadcasts by size and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import display_name, recode


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by `order`, other columns breaking ties: an aggregation, no sort. Null keys drop out."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.dropna(subset=keys)
    if not rest:
        return rows.distinct()
    least = F.min(F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], F.struct(*rest).alias("row")))
    return rows.groupBy(*keys).agg(least.alias("f")).select(*keys, "f.row.*")


def with_attributes(board: DataFrame, entities: DataFrame) -> DataFrame:
    """board with team, listed_pos, age, exp and player (display name) of entities(id, first_name, last_name, position, ...)."""
    own = entities.select("id", "team", F.col("position").alias("listed_pos"), "age", "exp", display_name("first_name", "last_name").alias("player"))
    return board.join(own, "id", "left")


def with_ranking(board: DataFrame, rankings: DataFrame, order: str) -> DataFrame:
    """board with pos_ecr and sd_ecr of rankings(id, avg, std_dev), the first by `order` of an id."""
    one = first_per_key(rankings.select("id", order, "avg", "std_dev"), ["id"], [order])
    return board.join(one.select("id", F.col("avg").alias("pos_ecr"), F.col("std_dev").alias("sd_ecr")), "id", "left")


def with_draft_value(board: DataFrame, values: DataFrame) -> DataFrame:
    """board with adp and adp_sd of values(id, adp, adp_sd), and how far its rank is from it."""
    return board.join(values.select("id", "adp", "adp_sd"), "id", "left").withColumn("adp_diff", F.col("rank") - F.col("adp"))


def with_context(board: DataFrame, crosswalk: DataFrame, rosters: DataFrame | None, teams: dict[str, str], order: str) -> DataFrame:
    """board with the platform's id and injury status, who holds the entity, and its team in common spelling.

    crosswalk(id, platform_id, platform_team, injury_status) and rosters(platform_id, team_name, manager, is_starter) give
    their first row of a key by `order`. Without rosters the holder's columns are null.
    """
    one = first_per_key(crosswalk.select("id", order, "platform_id", "platform_team", "injury_status"), ["id"], [order]).drop(order)
    out = board.join(one, "id", "left")
    if rosters is None:
        out = out.withColumns({"rostered_by": F.lit(None).cast("string"), "manager": F.lit(None).cast("string"), "starting": F.lit(None).cast("boolean")})
    else:
        held = first_per_key(rosters.select("platform_id", order, "team_name", "manager", "is_starter"), ["platform_id"], [order]).drop(order)
        out = out.join(held.withColumnsRenamed({"team_name": "rostered_by", "is_starter": "starting"}), "platform_id", "left")
    own = F.col("team") if "team" in board.columns else F.lit(None).cast("string")
    return out.withColumn("team", recode(F.coalesce(own, "platform_team"), teams)).drop("platform_team")


def ownership(picks: DataFrame, rosters: DataFrame, managers: DataFrame, names: DataFrame) -> DataFrame:
    """Who holds whom: the last pick of each entity over all seasons, or the rosters where there is no pick at all.

    picks(platform_id, season, draft_pick, draft_round, drafted_by), rosters(platform_id, roster_id, owner_id, is_starter),
    managers(owner_id, manager, team_name), names(platform_id, id, player). Whether any pick exists is a one-row side.
    """
    latest = picks.groupBy("platform_id").agg(F.max_by(F.struct("draft_round", "draft_pick", "drafted_by"), F.struct("season", "draft_pick")).alias("p"))
    starter = rosters.groupBy("platform_id").agg(F.min_by(F.struct("is_starter", "owner_id"), "roster_id").alias("r"))
    drafted = latest.join(starter, "platform_id", "left").select("platform_id", "p.draft_round", "p.draft_pick", F.col("p.drafted_by").alias("owner_id"), "r.is_starter")
    none = picks.agg((F.count(F.lit(1)) == 0).alias("none"))
    kept = starter.join(F.broadcast(none)).filter("none")  # one row
    rostered = kept.select("platform_id", F.lit(None).cast("int").alias("draft_round"), F.lit(None).cast("long").alias("draft_pick"), "r.owner_id", "r.is_starter")
    out = with_managers(drafted.unionByName(rostered), managers)
    one = first_per_key(names.select("platform_id", "id", "player"), ["platform_id"], ["id"])
    return out.join(one, "platform_id", "left").select("platform_id", "id", "player", "team_name", "manager", "draft_round", "draft_pick", "is_starter")


def with_managers(df: DataFrame, managers: DataFrame, key: str = "owner_id") -> DataFrame:
    """df with manager and team_name of the owner in column `key`, whatever it is called."""
    own = managers.select(F.col("owner_id").alias("__owner"), "manager", "team_name")
    return df.join(own, F.col(key) == F.col("__owner"), "left").drop("__owner")


def with_holder(board: DataFrame, held: DataFrame) -> DataFrame:
    """board with drafted_by (the team's name, else its manager), drafted_manager, draft_round and draft_pick of held(platform_id, ...)."""
    own = held.select("platform_id", F.coalesce("team_name", "manager").alias("drafted_by"), F.col("manager").alias("drafted_manager"), "draft_round", "draft_pick")
    return board.join(own, "platform_id", "left")


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with a value looked up by the first key that has one: table(key, value) meets each key in turn."""
    found = []
    for n, key in enumerate(keys):
        df = df.join(table.select(F.col("key").alias(key), F.col("value").alias(f"__v{n}")), key, "left")
        found.append(f"__v{n}")
    return df.withColumn(value, F.coalesce(*found)).drop(*found)


def reverse_lookup(df: DataFrame, crosswalk: DataFrame, column: str) -> DataFrame:
    """df(id) with a source's own id for it, the least of several."""
    return df.join(crosswalk.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(column).alias(column)), "id", "left")


def matches_filter(board: DataFrame, group: str | None = None, text: str = "", hide_taken: bool = False) -> DataFrame:
    """Rows of a group whose name contains a text in any case, without those that somebody holds."""
    keep: Column = F.lit(True)
    if group:
        keep = keep & (F.col("pos") == group)
    if text:
        keep = keep & F.contains(F.lower("player"), F.lit(text.lower()))
    if hide_taken:
        keep = keep & F.col("drafted_by").isNull()
    return board.filter(keep)
