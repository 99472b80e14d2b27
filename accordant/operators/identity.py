"""Identity resolution: normalised keys and ordered match passes against a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import recode


#: Fixed value: a trailing suffix of a name.
SUFFIX = r"\s+(defense|jr|sr|[iv]+)\.?$"


def normal(c: Column, recodes: list[dict[str, str]]) -> Column:
    """Upper case, whole-value recodes one after the other (groups, then teams), lower case, without one trailing suffix, punctuation and spaces."""
    out = F.upper(F.trim(c))
    for mapping in recodes:
        out = recode(out, mapping) if mapping else out
    out = F.regexp_replace(F.lower(out), SUFFIX, "")
    return F.regexp_replace(out, r"[\p{Punct}\s]", "")


def first_name(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\S*)", 1)


def last_name(name: Column) -> Column:
    return F.when(F.instr(name, " ") > 0, F.regexp_replace(name, r"^\S*\s+", "")).otherwise("")


def key(parts: list[Column]) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("~")) for p in parts])


#: Columns of each pass, in order.
PASSES = (("name", "pos", "team"), ("last", "pos", "team"), ("name", "team"), ("name", "pos"), ("first", "pos", "team"))


def keyed(df: DataFrame, recodes: list[dict[str, str]]) -> DataFrame:
    """df(name, pos, team) with one key column per pass."""
    own = {"name": F.col("name"), "first": first_name(F.col("name")), "last": last_name(F.col("name")), "pos": F.col("pos"), "team": F.col("team")}
    own = {k: normal(v, recodes) for k, v in own.items()}
    return df.withColumns({f"k{n}": key([own[c] for c in cols]) for n, cols in enumerate(PASSES)})


def resolve(rows: DataFrame, reference: DataFrame, recodes: list[dict[str, str]] | None = None, team_group: str | None = None) -> DataFrame:
    """rows(name, pos, team, ...) with ref_id from reference(ref_id, name, pos, team).

    Passes only fill what earlier ones left open, so the result is a coalesce over left joins. Keys that several
    reference rows share are no match. Rows of team_group match by team alone, the least ref_id of the team.
    """
    left, right = keyed(rows, recodes or []), keyed(reference, recodes or [])
    found = []
    if team_group:
        teams = reference.filter(F.col("pos") == team_group).groupBy(F.col("team").alias("t")).agg(F.min("ref_id").alias("id_team"))
        left = left.join(teams, (F.col("team") == F.col("t")) & (F.col("pos") == team_group), "left").drop("t")
        found.append("id_team")
    for n in range(len(PASSES)):
        single = right.groupBy(f"k{n}").agg(F.min("ref_id").alias(f"id{n}"), F.count("*").alias("n")).filter("n = 1").drop("n")
        left = left.join(single, f"k{n}", "left")
        found.append(f"id{n}")
    return left.withColumn("ref_id", F.coalesce(*found)).drop(*found, *[f"k{n}" for n in range(len(PASSES))])


def from_crosswalk(rows: DataFrame, crosswalk: DataFrame, column: str, id_column: str = "id", order: str | None = None) -> DataFrame:
    """rows with ref_id for a source's own id: of the crosswalk's rows for it the first by `order` (the least id without one)."""
    if column not in crosswalk.columns:
        raise ValueError(f"the crosswalk has no column {column}")
    first = F.min_by(id_column, F.struct(order, id_column)) if order else F.min(id_column)
    return rows.join(crosswalk.filter(F.col(column).isNotNull()).groupBy(column).agg(first.alias("ref_id")), column, "left")


def by_id_or_name(rows: DataFrame, crosswalk: DataFrame, column: str, reference: DataFrame, id_column: str = "id", recodes: list[dict[str, str]] | None = None, team_group: str | None = None) -> DataFrame:
    """rows(column, name, pos, team, ...) with ref_id: that of the crosswalk for the source's own id, else found by name as `resolve` does."""
    known = from_crosswalk(rows, crosswalk, column, id_column).withColumnRenamed("ref_id", "__known")
    return resolve(known, reference, recodes, team_group).withColumn("ref_id", F.coalesce("__known", "ref_id")).drop("__known")
