"""Registered queries over many scopes and many frames at once: baselines, turns, tiers, decisions on columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accordant.operators import board as boards
from accordant.operators import clean, impute, scope, score
from accordant.operators import settings as settings_of

from accordant.sources import payloads, publish
from accordant.sources.stage import RUN, shared_dir

from .queries import LINES, ONE, PICKS, SCORED, SLOTTED, SQL, TEAMS, TIERS, lines, over, picks, published_board, query, rounded, table, weights
from .rules import CEILINGS, scope_settings

ROUNDS = 12


def scope_slots(spark, sf):
    """Slots of scopes (suppliers): three dedicated ones, a flex one unless 5 divides the number, a wider one unless 3 does."""
    g = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]
    each = [(0, [g[0]], 1), (1, [g[1]], 1), (2, [g[2]], 1), (3, g[:3], 5), (4, g[1:5], 3)]
    slot = F.array(*[F.struct(F.lit(n).alias("slot_order"), F.array(*map(F.lit, own)).alias("eligible"), F.lit(unless).alias("unless")) for n, own, unless in each])
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scope"), (F.col("s_suppkey") % 9 + 4).cast("int").alias("teams"), F.explode(slot).alias("s")).select("scope", "teams", "s.*")
    return rows.filter("unless = 1 or scope % unless <> 0").drop("unless")


@query(LINES + ONE + """, t as (select p_type as pos, row_number() over (order by p_type) as k from (select distinct p_type from part)),
n0 as (select pos, points, k, row_number() over (partition by pos order by points desc, id) as n from one join t using (pos) where k <= 5),
leagues as (select s_suppkey as scope, s_suppkey % 9 + 4 as teams, s_suppkey % 5 <> 0 as flex, s_suppkey % 3 <> 0 as wide from supplier),
cand as (select *, case when k <= 3 then teams else 0 end as own from leagues, n0 where n <= 3 * teams),
flexed as (select scope, pos, count(*) as f from (select *, row_number() over (partition by scope order by points desc, k, n) as r from cand where flex and k <= 3 and n > own) where r <= teams group by all),
wider as (select scope, pos, count(*) as w from (select cand.*, row_number() over (partition by scope order by points desc, k, n) as r from cand left join flexed using (scope, pos) where wide and k between 2 and 5 and n > own + coalesce(f, 0)) where r <= teams group by all)
select scope, pos, (case when k <= 3 then teams else 0 end + coalesce(f, 0) + coalesce(w, 0))::int as baseline from leagues cross join t left join flexed using (scope, pos) left join wider using (scope, pos) where k <= 3 or w > 0""")
def scope_baselines(spark, sf):
    """Baselines of all scopes in one plan, flex slots filled best first."""
    return scope.replacement_ranks_of_all(published_board(spark, sf), scope_slots(spark, sf))


@query(LINES + ONE + f""", o as (select pos, points_vor as v, row_number() over (order by points_vor desc, id) as n from one), g as (select distinct pos from o),
turns as (select slot, round, (round - 1) * {TEAMS} + case when round % 2 = 1 then slot else {TEAMS} + 1 - slot end as pick from range(1, {TEAMS} + 1) a(slot), range(1, {ROUNDS} + 1) b(round)),
u as (select *, coalesce(lead(pick) over (partition by slot order by pick), {TEAMS * ROUNDS} + 1) as until from turns),
w as (select u.*, g.pos, (select min(n) from o where o.pos <> g.pos and n >= u.pick) as other from u, g),
y as (select *, case when other is null or other >= until then until - 1 else until end as gone from w),
z as (select slot, round, pick, until, pos, (select max(v) from o where o.pos = y.pos and n >= y.pick) as now, (select max(v) from o where o.pos = y.pos and n >= y.gone) as later from y)
select slot::int as slot, round::int as round, pick::int as pick, until::int as until, pos, round(now, 8) as now, round(later, 8) as later, round(now - later, 8) as cost from z""")
def turn_costs(spark, sf):
    """The waiting cost of every slot, turn and group of a draft."""
    return rounded(scope.turn_costs(published_board(spark, sf), "points_vor", TEAMS, ROUNDS))


@query(SQL["setting_brackets"])
def setting_tiers(spark, sf):
    """setting_brackets by a join of values with the tiers as a table."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("scope"), F.when(F.col("l_linenumber") % 6 != 0, F.col("l_quantity")).alias("q"))
    return score.tier_join(rows, "q", settings_of.tier_table(scope_settings(spark, sf), CEILINGS)).drop("q")


#: A frame is a pair of source and group; a column is a number or not by frame.
_CELLS = """with c as (select 's' || l_suppkey % 10 as data_src, p_type as pos, l_orderkey, l_linenumber, l_suppkey % 10 as s, l_quantity as q, l_tax as t, l_returnflag as f from lineitem join part on p_partkey = l_partkey)"""


def frame_cells(spark, sf):
    """Cells of 60 frames: numbers with separators and blanks, numbers in even sources beside text in odd ones, one text, none at all."""
    s, n = F.col("l_suppkey") % 10, F.col("l_linenumber")
    qty = F.when(n % 3 == 0, "--").otherwise(F.format_number(F.col("l_quantity") * 1000, 1))
    mixed = F.when(s % 2 == 0, F.col("l_tax").cast("string")).otherwise(F.col("l_returnflag"))
    cells = F.create_map(F.lit("qty"), qty, F.lit("mixed"), mixed, F.lit("same"), F.when(n % 2 == 0, "x"), F.lit("none"), F.when(n % 2 == 0, " N/A "))
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.concat(F.lit("s"), s).alias("data_src"), F.col("p_type").alias("pos"), "l_orderkey", n, F.explode(cells).alias("column", "value"))


@query(_CELLS + """, v as (select data_src, pos, min(f) < max(f) as v from c group by all)
select data_src, pos, l_orderkey, l_linenumber, 'qty' as "column", q * 1000 as number, null as text from c where l_linenumber % 3 <> 0
union all select data_src, pos, l_orderkey, l_linenumber, 'mixed', case when s % 2 = 0 then t end, case when s % 2 = 1 then f end from c join v using (data_src, pos) where s % 2 = 0 or v""")
def typed_cells(spark, sf):
    """Types and dropped columns of all frames, decided by one aggregation."""
    return clean.typed_cells(frame_cells(spark, sf), ["data_src", "pos"])


#: Groups of the given types, in the same order.
NAMES = {"ECONOMY": "DST", "LARGE": "K", "MEDIUM": "QB", "PROMO": "RB", "SMALL": "TE", "STANDARD": "WR"}
_NAMED = "(case p_type " + " ".join(f"when '{k}' then '{v}'" for k, v in NAMES.items()) + " end)"
SEASON_RULES = {
    "pass_yds": 0.04, "rush_yds": 0.1, "rec_yds": 0.1, "pass_300_yds": 3.0, "pass_350_yds": 2.0, "pass_fd": 0.5, "rush_fd": 0.5, "rec_fd": 0.5,
    "fg_0019": 3.0, "fg_2029": 3.0, "fg_3039": 3.0, "fg_4049": 4.0, "fg_miss": -1.0, "dst_sacks": 1.0,
}
MILESTONES = {"pass_300_yds": (-0.5, "pass_yds", 0.001), "pass_350_yds": (-0.2, "pass_yds", 0.0004)}
SEASON = """,
sl as (select id, pos, data_src, case when pos = 'QB' then yds / 7 end as pass_yds, case when pos not in ('K', 'DST') then tax * 1000 / 3 + 10 end as rush_yds, case when pos = 'QB' then qty end as att, case when pos in ('RB', 'WR', 'TE') then yds / 13 end as rec_yds,
  case when pos = 'K' then tax * 500 / 7 end as short, case when pos = 'K' then yds / 1300 end as far, case when pos = 'K' then qty + 40 end as tried, case when pos = 'DST' then coalesce(qty, avg(qty) over (partition by pos, id)) end as sacks, case when pos = 'DST' then yds / 200 end as allowed from lines),
run as (select avg(att / rush_yds) as rate from sl where pos = 'QB' and att is not null),
fd as (select sl.*, pos = 'QB' as qb, coalesce(att, rate * rush_yds) as carries, greatest(1, coalesce(case when id % 2 = 0 then id % 18 end, 17)) as played from sl, run),
fk as (select *, short * 0.04 + short * 0.38 + short * 0.58 + far as made from fd), fm as (select *, tried - made as missed from fk),
fr as (select pos, sum(case when missed is not null then missed end) / nullif(sum(case when missed is not null then made end), 0) as g from fm group by pos),
fs as (select fm.*, g, count(missed) over w as n, max(case when missed is not null and made = 0 then 1 else 0 end) over w as z, avg(missed / nullif(made, 0)) over w as r, avg(missed) over w as mean from fm join fr using (pos) window w as (partition by pos, id)),
spreads as (select p_partkey as id, 4.0 + p_partkey % 5 as intercept from part where p_partkey % 13 <> 0),
games as (select id, data_src, allowed / 17 as mean, intercept + 0.1 * (allowed / 17) as sd, unnest(range(1, 18)) as game from sl join spreads using (id) where pos = 'DST'),
draws as (select *, (('0x' || substr(md5(concat_ws('|', id, data_src, game, 1, 1)), 1, 10))::bigint + 0.5) / 1099511627776 as a, (('0x' || substr(md5(concat_ws('|', id, data_src, game, 1, 2)), 1, 10))::bigint + 0.5) / 1099511627776 as b from games),
played as (select id, data_src, round_even(mean + sd * (sqrt(-2 * ln(a)) * cos(2 * pi() * b)), 0) as x from draws),
bracket as (select id, data_src, sum(case when x <= 5 then 10.0 when x <= 15 then 7.0 when x <= 25 then 4.0 when x <= 35 then 1.0 else -1.0 end::double) as bracket from played group by all),
scored as (select id, pos, data_src, case pos
  when 'QB' then pass_yds * 0.04 + rush_yds * 0.1 + 3 * (greatest(0, pass_yds * 0.001 - 0.5) + greatest(0, pass_yds * 0.0004 - 0.2)) + 2 * greatest(0, pass_yds * 0.0004 - 0.2) + 0.5 * pass_yds * 0.0483 + 0.5 * carries * case when round(carries / played, 9) < 2 then 0.261 when round(carries / played, 9) <= 4 then 0.342 else 0.378 end
  when 'K' then 3 * short + 4 * far - coalesce(missed, case when n = 0 then made * g when z = 1 or r is null then mean else made * r end)
  when 'DST' then coalesce(sacks, 0) + bracket
  else rush_yds * 0.1 + rec_yds * case when pos = 'TE' then 0.15 else 0.1 end + 0.5 * rush_yds * 0.0508 + 0.5 * rec_yds * case pos when 'RB' then 0.045 when 'WR' then 0.0483 else 0.0503 end end as points
  from fs left join bracket using (id, data_src) where pos <> 'DST' or bracket is not null)
"""


def season_lines(spark, sf):
    """Stat lines of six groups from the common input, each with the metrics of its group and gaps in some."""
    pos = F.element_at(F.create_map(*[F.lit(v) for kv in NAMES.items() for v in kv]), F.col("pos"))
    rows = lines(spark, sf).withColumn("pos", pos)
    of = lambda groups, c: F.when(F.col("pos").isin(*groups), c)
    run, catch = ("QB", "RB", "WR", "TE"), ("RB", "WR", "TE")
    metrics = {
        "pass_yds": of(["QB"], F.col("yds") / 7), "rush_yds": of(run, F.col("tax") * 1000 / 3 + 10), "rush_att": of(["QB"], F.col("qty")), "rec_yds": of(catch, F.col("yds") / 13),
        "fg_0039": of(["K"], F.col("tax") * 500 / 7), "fg_4049": of(["K"], F.col("yds") / 1300), "fg_att": of(["K"], F.col("qty") + 40), "dst_sacks": of(["DST"], F.col("qty")), "dst_pts_allowed": of(["DST"], F.col("yds") / 200),
    }
    return rows.select("id", "pos", "data_src", *[c.alias(k) for k, c in metrics.items()])


def season(spark, sf):
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    games = part.filter(key % 2 == 0).select(key.alias("id"), (key % 18).alias("games"))
    # a seventh of the teams is only known by the second key
    landed = part.filter(key % 13 != 0).select(F.when(key % 7 != 0, key).alias("id"), F.when(key % 7 == 0, key).alias("nfl_id"), key.alias("team"), (key % 5 + 4).cast("double").alias("Intercept"), F.lit(0.1).alias("season_mean"))
    return boards.Season(MILESTONES, {"pass_300_yds": ["pass_300_yds", "pass_350_yds"]}, games, TIERS, payloads.team_spreads(landed))


def of_season(sql: str) -> str:
    """SQL over the season's points and groups, with the step of a defence's tiers."""
    own = "median(sd_pts) * any_value(case when pos = 'DST' then 0.1 else 1 end) as step"
    sql = sql.replace("(select distinct p_type from part)", "(select distinct p_type as kind from part)").replace("select p_type as pos, row_number() over (order by p_type)", "select kind as pos, row_number() over (order by kind)")
    return sql.replace(SCORED, SEASON).replace("p_type", _NAMED).replace("median(sd_pts) as step", own)



def season_scored(spark, sf):
    return boards.scored_lines(season_lines(spark, sf), SEASON_RULES, {"TE": {"rec_yds": 0.15}}, boards.Fills(level="none"), season(spark, sf))


@query(of_season(LINES + SCORED + "select id, pos, data_src, round(points, 8) as points from scored"))
def season_points(spark, sf):
    """Points of stat lines of all groups: kickers reconciled, gaps filled, milestones, first downs and the defences' bracket."""
    return season_scored(spark, sf).withColumn("points", F.round("points", 8))


@query(of_season(LINES + ONE + SLOTTED + ", final_lines as (select pos, baseline from slotted)" + over("coalesce(baseline, case pos when 'QB' then 13 when 'RB' then 35 when 'WR' then 36 when 'TE' then 13 when 'K' then 8 else 3 end)", "final")) + " select avg_type, rank, pos, id, points, points_vor, tier from final")
def board_from_lines(spark, sf):
    """The whole board in one call, from stat lines of all groups."""
    g = list(NAMES.values())
    slots = [(x, [x]) for x in g[:3]] + [("flex", g[:3]), ("super", g[1:5])]
    out = boards.board_from_lines(season_lines(spark, sf), SEASON_RULES, weights(spark), slots, TEAMS, {"TE": {"rec_yds": 0.15}}, boards.Fills(level="none"), season(spark, sf))
    return out.select("avg_type", "rank", "pos", "id", "points", "points_vor", "tier")


@query(of_season(LINES + """ select 'K' as pos, 'fg_att' as metric, count(*) as n from lines where pos = 'K' and qty is null having count(*) > 0 union all select 'DST', 'dst_sacks', count(*) from lines where pos = 'DST' and qty is null having count(*) > 0"""))
def unfilled_metrics(spark, sf):
    """Gaps of scored metrics by group, here before they are filled."""
    return impute.unfilled(season_lines(spark, sf), {"K": ["fg_att"], "DST": ["dst_sacks", "dst_pts_allowed"], "QB": ["pass_yds"]})


@query("select c_custkey as id, case when c_nationkey % 3 = 0 then 'list' when c_nationkey % 3 = 1 then 'map' else 'page' end as data_src, c_acctbal as adp from customer")
def draft_feeds(spark, sf):
    """Draft values of three feeds as they land (a list and a map in JSON, a table in a page), ids by crosswalk and else by name."""
    customer, key = table(spark, sf, "customer"), F.col("c_custkey")
    players = customer.select(key.alias("ref_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("pos"), F.concat(F.lit("t"), "c_nationkey").alias("team"))
    crosswalk = customer.filter(key % 3 != 0).select(key.alias("id"), *[F.concat(F.lit(k), key).alias(f"{k}_id") for k in "abc"])
    where = f"{shared_dir(spark)}/{RUN}/feeds-{uuid.uuid4().hex}"
    kind, team = F.col("c_nationkey") % 3, F.concat(F.lit("t"), "c_nationkey")
    o = lambda k: F.struct(F.concat(F.lit(k), key).alias("player_id"), F.upper("c_name").alias("name"), F.col("c_mktsegment").alias("position"), team.alias("team"), F.col("c_acctbal").alias("avg"))
    as_list = customer.filter(kind == 0).groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(o("a")).alias("player_list"))).alias("value"))
    as_map = customer.filter(kind == 1).groupBy("c_nationkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(key.cast("string"), o("b")))).alias("player_list"))).alias("value"))
    row = F.concat(F.lit("<tr><td>c"), key, F.lit("<td> "), "c_name", F.lit("<td>"), "c_mktsegment", F.lit("<td>"), team, F.lit("<td>"), F.format_number("c_acctbal", 2), F.lit("</tr>"))
    page = customer.filter(kind == 2).groupBy("c_nationkey").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    page = page.select(F.concat(F.lit("<table><tr><td>other</table><table><tr><th>Id<th>Player<th>Pos<th>Team<th>Avg Pos</tr>"), "rows", F.lit("</table>")).alias("value"))
    for name, df in (("list", as_list), ("map", as_map), ("page", page)):
        df.select("value").write.text(f"{where}/{name}")
    fields = {"src_id": "player_id", "name": "name", "pos": "position", "team": "team", "value": "avg"}
    read = lambda name: spark.read.text(f"{where}/{name}")
    pages = read("page").select(F.xxhash64("value").alias("page_id"), F.col("value").alias("html"))
    feeds = {
        "list": (payloads.json_feed(read("list"), "value", "player_list", fields), "a_id"), "map": (payloads.json_feed(read("map"), "value", "player_list", fields), "b_id"),
        "page": (payloads.table_feed(pages, {"src_id": "Id", "name": "Player", "pos": "Pos", "team": "Team", "value": "Avg Pos"}), "c_id"),
    }
    return payloads.with_feed_ids(feeds, crosswalk, players, "adp")


@query("with " + PICKS + ", mid as (select max(event_id) // 2 as m from events), old as (select distinct entity from picks, mid where pick <= m) select held.entity as platform_id, manager, old.entity is null as new, (select count(distinct user_id) from events) as slots, '2024-09-05T00:20:00+00:00' as written_at from held left join old using (entity)")
def refreshed_ownership(spark, sf):
    """A snapshot with the holders of half of the picks, refreshed with all of them, the order and the stamp by one commit."""
    where = f"{shared_dir(spark)}/{RUN}/refresh-{uuid.uuid4().hex}"
    rows = picks(spark, sf)
    mid = table(spark, sf, "events").agg(F.floor(F.max("event_id") / 2).alias("m"))
    owned = lambda df: scope.latest_holder(df).select(F.col("entity").alias("platform_id"), "manager")
    early = rows.join(F.broadcast(mid)).filter("pick <= m")  # one row on the right
    publish.publish({"board": rows.select("pick"), "ownership": owned(early)}, where, facts={"written_at": "before"})
    order = table(spark, sf, "events").select(F.col("user_id").alias("manager")).distinct()
    new = publish.refresh(where, owned(rows), order, "2024-09-05T00:20:00+00:00")
    slots = publish.published(spark, where, "draft").agg(F.count("*").alias("slots"))
    out = publish.published(spark, where, "ownership").join(new.withColumn("new", F.lit(True)), "platform_id", "left").join(F.broadcast(slots))
    return out.select("platform_id", "manager", F.coalesce("new", F.lit(False)).alias("new"), "slots", F.lit(publish.manifest(spark, where)[1]["written_at"]).alias("written_at"))
