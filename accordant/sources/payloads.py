"""Payloads as they land (JSON text, one document a row; files of parameters) to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.operators.clean import header_map, nan_to_null, number, recode, renamed
from accordant.operators.identity import by_id_or_name, resolve

from .readers import delimited, tables
from .stage import staged


def first_stat_block(df: DataFrame, payload: str, codes: dict[str, str], keep: list[str]) -> DataFrame:
    """Metrics of the first stat block of each player object of an array; objects without a block drop out.

    payload: [{"id":, "player": {"fullName":, "proTeamId":, "stats": [{"stats": {code: number}}]}}]. Codes that no metric
    names are ignored.
    """
    block = "struct<stats:map<string,double>>"
    shape = f"array<struct<id:string,player:struct<fullName:string,proTeamId:string,stats:array<{block}>>>>"
    each = df.select(*keep, F.explode(F.from_json(payload, shape)).alias("e"))
    each = each.filter(F.size("e.player.stats") > 0).withColumn("m", F.element_at("e.player.stats", 1)["stats"])
    metrics = [F.element_at("m", code).alias(name) for code, name in codes.items()]
    return each.select(*keep, F.col("e.id").alias("src_id"), F.col("e.player.fullName").alias("player"), F.col("e.player.proTeamId").alias("team_code"), *metrics)


def objects_with(df: DataFrame, payload: str, marks: tuple[str, ...], fields: str, keep: list[str]) -> DataFrame:
    """Objects that hold all keys of `marks`, at any depth of a JSON document, with their `fields`.

    A document is parsed once, to a Variant. Each level is one pass: values of an object that is no match, and elements of an array, go on to
    the next, until none is left. A match is not searched further. Rows only grow by what the document holds. A text that
    is no JSON, or an object with a key twice, gives no rows.
    """
    level = df.select(*keep, F.try_parse_json(payload).alias("__v"))
    out = None
    while True:
        as_map, as_list = F.try_variant_get("__v", "$", "map<string,variant>"), F.try_variant_get("__v", "$", "array<variant>")
        level = level.withColumns({"__map": as_map, "__list": as_list}).filter("__map is not null or __list is not null")
        keys = F.map_keys("__map")
        is_match = F.coalesce(F.forall(F.array(*map(F.lit, marks)), lambda m: F.array_contains(keys, m)), F.lit(False))
        level = staged(level.select(*keep, "__v", F.coalesce(F.map_values("__map"), "__list").alias("__parts"), is_match.alias("__match")), "nested")
        if level.isEmpty():
            break
        found = level.filter("__match").select(*keep, F.from_json(F.to_json("__v"), fields).alias("__o")).select(*keep, "__o.*")
        out = found if out is None else out.unionByName(found)
        level = level.filter("not __match").select(*keep, F.explode("__parts").alias("__v"))
    if out is None:
        out = level.select(*keep, F.from_json(F.lit(None).cast("string"), fields).alias("__o")).select(*keep, "__o.*")
    return out


def managers(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """(owner_id, manager, team_name) of an array of users; the team's name falls back to the user's."""
    shape = "array<struct<user_id:string,display_name:string,metadata:struct<team_name:string>>>"
    each = df.select(*keep, F.explode(F.from_json(payload, shape)).alias("u"))
    name = F.coalesce(F.nullif("u.metadata.team_name", F.lit("")), "u.display_name")
    return each.select(*keep, F.col("u.user_id").alias("owner_id"), F.col("u.display_name").alias("manager"), name.alias("team_name"))


def player_map(df: DataFrame, payload: str, order: str, groups: dict[str, str]) -> DataFrame:
    """One row per key of several JSON maps key -> object, of equal keys that of the last payload by `order`.

    Entries that are no objects or have no position drop out, positions are recoded, and the name falls back to first and last.
    """
    fields = "position:string,full_name:string,first_name:string,last_name:string,team:string,status:string,injury_status:string"
    rows = df.select(order, F.explode(F.from_json(payload, f"map<string,struct<{fields}>>")).alias("platform_id", "o")).filter("o is not null")
    last = rows.groupBy("platform_id").agg(F.max_by("o", order).alias("o")).filter("o.position is not null")
    name = F.coalesce(F.nullif("o.full_name", F.lit("")), F.nullif(F.concat_ws(" ", F.nullif("o.first_name", F.lit("")), F.nullif("o.last_name", F.lit(""))), F.lit("")))
    return last.select("platform_id", name.alias("name"), recode(F.col("o.position"), groups).alias("pos"), "o.team", "o.status", "o.injury_status")


def started_picks(df: DataFrame, picks: str, keep: list[str], one_draft: bool = False) -> DataFrame:
    """Picks of drafts(status, ...) that have started: payload [{"player_id":, "round":, "pick_no":, "picked_by":}]. A single named draft counts in any state."""
    shape = "array<struct<player_id:string,round:int,pick_no:long,picked_by:string>>"
    rows = df if one_draft else df.filter(~F.col("status").eqNullSafe("pre_draft"))
    each = rows.select(*keep, F.explode(F.from_json(picks, shape)).alias("p"))
    return each.select(*keep, F.col("p.player_id").alias("platform_id"), F.col("p.round").alias("draft_round"), F.col("p.pick_no").alias("draft_pick"), F.col("p.picked_by").alias("drafted_by"))


def draft_values(feeds: dict[str, DataFrame], metric: str) -> DataFrame:
    """(id, data_src, metric) of several feeds as one long table, rows without id or value left out."""
    out = None
    for name, df in feeds.items():
        rows = df.select("id", F.lit(name).alias("data_src"), F.col(metric).cast("double").alias(metric)).filter(F.col("id").isNotNull() & F.col(metric).isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


#: What a draft feed says of a player.
FEED = ("src_id", "name", "pos", "team", "value")


def json_feed(df: DataFrame, payload: str, at: str, fields: dict[str, str]) -> DataFrame:
    """FEED columns as text of a feed in JSON: under the key `at` an array of objects, or a map of them; fields: FEED column -> the object's key.

    A payload without that key, or that is no JSON, gives no rows.
    """
    inner = F.get_json_object(payload, f"$.{at}")
    each = F.coalesce(F.map_values(F.from_json(inner, "map<string,map<string,string>>")), F.from_json(inner, "array<map<string,string>>"))
    is_list = F.startswith(F.ltrim(inner), F.lit("["))
    each = F.when(is_list, F.from_json(inner, "array<map<string,string>>")).otherwise(each)
    rows = df.select(F.explode(each).alias("__o")).filter("__o is not null")
    return rows.select(*[(F.element_at("__o", fields[c]) if c in fields else F.lit(None).cast("string")).alias(c) for c in FEED])


def table_feed(pages: DataFrame, headers: dict[str, str]) -> DataFrame:
    """FEED columns as text of tables in pages(page_id, html); headers: FEED column -> the table's header. Rows of other tables have no value and stay out."""
    cells = headed(tables(pages), ["page_id", "table_no"]).filter(F.col("header").isin(*headers.values()))
    own = cells.groupBy("page_id", "table_no", "row_no").agg(*[F.max(F.when(F.col("header") == h, F.col("value"))).alias(c) for c, h in headers.items()])
    return own.filter("value is not null").select(*[(F.col(c) if c in headers else F.lit(None).cast("string")).alias(c) for c in FEED])


def with_feed_ids(feeds: dict[str, tuple[DataFrame, str]], crosswalk: DataFrame, players: DataFrame, metric: str) -> DataFrame:
    """(id, data_src, metric) of feeds: source -> (FEED rows, the crosswalk's column of its ids), ids by crosswalk and else by name."""
    known = {}
    for name, (rows, column) in feeds.items():
        found = by_id_or_name(rows.withColumnRenamed("src_id", column), crosswalk, column, players)
        known[name] = found.select(F.col("ref_id").alias("id"), number(F.col("value")).alias(metric))
    return draft_values(known, metric)


def page_files(spark: SparkSession, path: str, pattern: str = r"-p(\d+)\.") -> DataFrame:
    """Lines of text files that are pages of one listing, with the page number from the file's name; all files are one dataset."""
    rows = spark.read.text(path)
    page = F.nullif(F.regexp_extract(F.input_file_name(), pattern, 1), F.lit("")).cast("int")
    return rows.select(F.coalesce(page, F.lit(1)).alias("page"), "value")


def numbered(pages: DataFrame, order: str) -> DataFrame:
    """pages(source, page, ...) stacked, each row with its number over all pages of its source.

    Rows of earlier pages are counted by an aggregation; a page is numbered by itself, so no listing meets in one task.
    """
    from pyspark.sql import Window

    sizes = pages.groupBy("source", "page").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("source", "page").orderBy(order))
    return pages.withColumn("__own", place).join(sizes.withColumn("__before", before).drop("n"), ["source", "page"]).withColumn("number", F.col("__before") + F.col("__own")).drop("__own", "__before")


def regression_models(spark: SparkSession, path: str) -> DataFrame:
    """(name, intercept, metric, slope) of a JSON file name -> [intercept, metric, slope]."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "m"))
    return each.select("name", F.get("m", 0).cast("double").alias("intercept"), F.get("m", 1).alias("metric"), F.get("m", 2).cast("double").alias("slope"))


def team_spreads(landed: DataFrame) -> DataFrame:
    """(id, intercept, slope) of landed(id, nfl_id, team, Intercept, season_mean): a team is found by either key, by its own id first.

    The slope is one for all teams, that of the first by team.
    """
    keys = F.array(F.struct(F.col("id").alias("key"), F.lit(0).alias("n")), F.struct(F.col("nfl_id").alias("key"), F.lit(1).alias("n")))
    each = landed.select(F.explode(keys).alias("k"), "team", F.col("Intercept").cast("double").alias("a")).filter("k.key is not null")
    slope = landed.agg(F.min_by(F.col("season_mean").cast("double"), "team").alias("slope"))
    one = each.groupBy(F.col("k.key").alias("id")).agg(F.min_by("a", F.struct("k.n", "team")).alias("intercept"))
    return one.join(F.broadcast(slope))  # one row on the right


def passer_games(landed: DataFrame, players: DataFrame, group: str = "QB") -> DataFrame:
    """(id, games) of landed(name, team, games), whose ids are found by name in players(ref_id, name, pos, team); names without one are left out."""
    rows = landed.select(F.xxhash64("name", "team").alias("row_id"), "name", F.lit(group).alias("pos"), "team", F.col("games").cast("double").alias("games"))
    return resolve(rows, players).filter("ref_id is not null").groupBy(F.col("ref_id").alias("id")).agg(F.max("games").alias("games"))


def stat_file(spark: SparkSession, path: str, data_src: str, mapping: list[tuple[str, str | None, str, str]], variant: str | None = None, drop: tuple[str, ...] = ("Rank",)) -> DataFrame:
    """A landed delimited file as text columns: ranks dropped, headers mapped for its source and group."""
    df = delimited(spark, path).drop(*drop)
    return renamed(df, header_map(mapping, data_src, variant)).withColumn("data_src", F.lit(data_src))


def headed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Table rows (keys, row_no, cells, heads) as (keys, row_no, place, header, value): names from a first row of header cells only, else X1, X2 ..."""
    # the first row reaches the others by a window, so that rows are made and dealt out once; it is a list, for keys with several tables
    first = F.collect_list(F.when(F.col("row_no") == 0, F.struct(F.when(F.col("heads"), F.col("cells")).alias("names"))))
    known = rows.dropna(subset=keys).withColumn("first", first.over(Window.partitionBy(*keys)))
    known = known.select(*keys, "row_no", "cells", F.explode("first").alias("first")).select(*keys, "row_no", "cells", "first.names")
    each = known.filter("names is null or row_no > 0").select(*keys, "row_no", "names", F.posexplode("cells").alias("at", "value"))
    name = F.coalesce(F.get("names", F.col("at")), F.concat(F.lit("X"), (F.col("at") + 1).cast("string")))
    return each.select(*keys, "row_no", (F.col("at") + 1).alias("place"), name.alias("header"), "value")


def first_line(c: Column) -> Column:
    """The first line of a cell that holds a label and more below it."""
    return F.trim(F.get(F.split(F.regexp_replace(c, r"^\s+", ""), "\n"), 0))


def load_stat_lines(frames: list[DataFrame], metrics: list[str], catalogue: DataFrame, season_long: bool, order: str = "ingest_seq") -> DataFrame:
    """Frames of several sources as one table of stat lines: ragged columns stacked, sources that do not cover the group or the period left out, lines without any metric dropped, NaN to null, and one line per entity and source.

    catalogue(data_src, positions array, draft boolean, weekly boolean). Lines without an id all stay. Of equal keys the
    first by `order` counts, taken by an aggregation.
    """
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    pairs = catalogue.filter("draft" if season_long else "weekly").select("data_src", F.explode("positions").alias("pos"))
    out = nan_to_null(out).join(pairs, ["data_src", "pos"], "left_semi").dropna("all", subset=[m for m in metrics if m in out.columns])
    rest = [c for c in out.columns if c not in ("id", "pos", "data_src")]
    known = out.filter("id is not null").groupBy("id", "pos", "data_src").agg(F.min(F.struct(order, F.struct(*rest).alias("row"))).alias("f")).select("id", "pos", "data_src", "f.row.*")
    return known.unionByName(out.filter("id is null"))
