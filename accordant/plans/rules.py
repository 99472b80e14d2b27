"""Registered queries of rule sets, settings, fills and landed payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import board as boards
from accordant.operators import impute, score, settings
from accordant.sources import payloads, publish, readers

from accordant.sources.stage import staged

from .queries import LINES, SCORED, lines, query, rounded, table

KINDS = ["rec", "pass_yds", "xp", "fg_50", "rush_fd", "jumps", "dst_sacks"]
_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
RULES = f"""rules as (select l_suppkey as scope, null::varchar as pos, {_KIND}[l_linenumber] as stat, max(l_discount * 10 - 0.2) as points from lineitem group by all),
own as (select l_suppkey as scope, p_type as pos, {_KIND}[l_linenumber] as stat, max(l_tax * 10) as points from lineitem join part on p_partkey = l_partkey where l_quantity > 48 group by all),
every as (select * from rules union all select * from own), groups as (select s_suppkey as scope, p_type as pos from supplier, (select distinct p_type from part))"""


def rules(spark, sf):
    """Base rules of scopes (suppliers), and overlays of some groups."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("l_linenumber")).alias("stat")
    items = table(spark, sf, "lineitem")
    base = items.groupBy(F.col("l_suppkey").alias("scope"), kind).agg(F.max(F.col("l_discount") * 10 - 0.2).alias("points")).withColumn("pos", F.lit(None).cast("string"))
    typed = items.filter("l_quantity > 48").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    own = typed.groupBy(F.col("l_suppkey").alias("scope"), F.col("p_type").alias("pos"), kind).agg(F.max(F.col("l_tax") * 10).alias("points"))
    return base.select("scope", "pos", "stat", "points").unionByName(own)


def groups(spark, sf):
    names = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scope"), F.explode(F.array(*map(F.lit, names))).alias("pos"))


@query(f"with {RULES} select distinct scope, stat from every where stat = 'jumps'")
def unknown_stats(spark, sf):
    return settings.unknown_stats(rules(spark, sf))


_RESOLVED = "resolved as (select scope, pos, stat, coalesce(o.points, b.points) as points from (select g.scope, g.pos, r.stat, r.points from groups g join rules r using (scope)) b full join (select own.* from own join groups using (scope, pos)) o using (scope, pos, stat))"


@query(f"with {RULES}, {_RESOLVED} select scope, pos, stat, round(points, 8) as points from resolved")
def resolved_rules(spark, sf):
    return rounded(settings.for_groups(rules(spark, sf), groups(spark, sf)))


@query(f"with {RULES}, {_RESOLVED}, r as (select scope, pos, coalesce(points, 0) as p from groups left join (select * from resolved where stat = 'rec') using (scope, pos)) select scope, pos, round(p, 8) as per_reception, case when p > 0.5 then 'PPR' when p > 0 then 'Half' else 'Std' end as label from r")
def format_labels(spark, sf):
    return rounded(settings.format_labels(rules(spark, sf), groups(spark, sf)))


@query(f"with {RULES}, ch as (select s_suppkey as scope, unnest(['rec', 'new']) as stat, unnest([1.5::double, s_nationkey::double]) as points from supplier where s_suppkey % 2 = 0) select scope, pos, stat, round(points, 8) as points from every where pos is not null or not exists (select 1 from ch where ch.scope = every.scope and ch.stat = every.stat) union all select scope, null, stat, points from ch")
def overridden_rules(spark, sf):
    changes = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("scope"), F.explode(F.create_map(F.lit("rec"), F.lit(1.5), F.lit("new"), F.col("s_nationkey").cast("double"))).alias("stat", "points"))
    return rounded(settings.overridden(rules(spark, sf), changes))


KEYS = ["allow_0", "allow_6", "allow_13", "allow_over", "bonus_b", "bonus_c", "yds_allow_9"]
_KEY = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
SETTINGS = f"settings as (select l_suppkey as scope, {_KEY}[l_linenumber] as key, max(floor(l_discount * 100) - l_orderkey % 7)::double as value from lineitem where l_partkey % 3 = 0 group by all)"
CEILINGS = {"allow_0": 10.0, "allow_6": 20.0, "allow_13": 30.0, "allow_over": float("inf")}


def scope_settings(spark, sf):
    key = F.element_at(F.array(*map(F.lit, KEYS)), F.col("l_linenumber")).alias("key")
    value = (F.floor(F.col("l_discount") * 100) - F.col("l_orderkey") % 7).cast("double")
    return table(spark, sf, "lineitem").filter("l_partkey % 3 = 0").groupBy(F.col("l_suppkey").alias("scope"), key).agg(F.max(value).alias("value"))


@query(f"""with {SETTINGS}, t as (select scope, case key when 'allow_0' then 10.0 when 'allow_6' then 20.0 when 'allow_13' then 30.0 else 'infinity'::double end as top, value from settings where key like 'allow%'),
x as (select row_number() over () as r, l_orderkey, l_linenumber, l_suppkey as scope, case when l_linenumber % 6 <> 0 then l_quantity end as q from lineitem),
m as (select r, l_orderkey, l_linenumber, x.scope, q, arg_min(value, top) filter (where q <= top) as fit, arg_max(value, top) as last, count(top) as n from x left join t using (scope) group by all)
select l_orderkey, l_linenumber, scope, case when n = 0 then 0.0 when q is not null then coalesce(fit, last) end as points from m""")
def setting_brackets(spark, sf):
    """Points of line items by the tiers of their scope's settings."""
    tiers = settings.bracket_tiers(scope_settings(spark, sf), CEILINGS)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("scope"), F.when(F.col("l_linenumber") % 6 != 0, F.col("l_quantity")).alias("q"))
    return rows.join(tiers, "scope", "left").select("l_orderkey", "l_linenumber", "scope", settings.tier_points(F.col("q"), F.col("tiers")).alias("points"))


@query(f"""with {RULES}, {SETTINGS}, b as (select * from (values ('bonus_b', 'TE', 'rec'), ('bonus_c', 'QB', 'pass_yds'), ('bonus_c', 'QB', 'rush_fd')) t(key, pos, stat))
select s.scope, b.pos, b.stat, round(coalesce(r.points, 0) + s.value, 8) as points from settings s join b using (key) left join rules r on r.scope = s.scope and r.stat = b.stat where s.value <> 0""")
def setting_overlays(spark, sf):
    bonuses = {"bonus_b": ("TE", ["rec"]), "bonus_c": ("QB", ["pass_yds", "rush_fd"])}
    return rounded(settings.overlays_from_settings(scope_settings(spark, sf), rules(spark, sf), bonuses))


@query(f"with {SETTINGS} select scope, key, value, case when key = 'bonus_b' then 'no_metric' when starts_with(key, 'yds_allow_') then 'prefix' else 'unmapped' end as reason from settings where value <> 0 and key not in ('allow_0', 'allow_6')")
def leftover_settings(spark, sf):
    return settings.left_over(scope_settings(spark, sf), ["allow_0", "allow_6"], ["bonus_b"], ["yds_allow_"])


@query(f"with {RULES}, {SETTINGS} select 'ALL' as pos, scope || ' ' || stat as stat, round(points, 8) as points, 1 as projected from rules union all select pos, scope || ' ' || stat, round(points, 8), 1 from own union all select 'ALL', scope || ' ' || key, value, 0 from settings where value <> 0")
def flat_rules(spark, sf):
    """Rules of all scopes as one flat table, with the settings that no rule uses."""
    named = lambda df, c: df.withColumn(c, F.concat_ws(" ", "scope", c))
    every = named(rules(spark, sf), "stat")
    left = named(settings.left_over(scope_settings(spark, sf), [], [], []), "key")
    return rounded(publish.flat_rules(every.filter("pos is null"), every.filter("pos is not null"), left))


@query("""with k as (select l_orderkey, l_linenumber, l_partkey % 3 as pos, l_partkey as id, l_suppkey as data_src, l_quantity as fg, case when l_linenumber % 3 <> 0 then l_quantity + l_tax * 100 end as att, case when l_linenumber % 5 = 0 then l_discount * 10 end as m from lineitem),
b as (select *, coalesce(m, att - fg) as miss from k),
g as (select pos, sum(case when miss is not null then miss end) / nullif(sum(case when miss is not null then fg end), 0) as g from b group by pos),
s as (select *, count(miss) over w as n, max(case when miss is not null and fg = 0 then 1 else 0 end) over w as z, avg(miss / nullif(fg, 0)) over w as r, avg(miss) over w as mean from b join g using (pos) window w as (partition by pos, id))
select l_orderkey, l_linenumber, round(coalesce(miss, case when n = 0 then fg * g when z = 1 or r is null then mean else fg * r end), 6) as fg_miss from s""")
def missed_kicks(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", n, (F.col("l_partkey") % 3).alias("pos"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("fg"), F.when(n % 3 != 0, F.col("l_quantity") + F.col("l_tax") * 100).alias("fg_att"), F.when(n % 5 == 0, F.col("l_discount") * 10).alias("fg_miss"))
    return impute.missed_kicks_fill(rows).select("l_orderkey", "l_linenumber", F.round("fg_miss", 6).alias("fg_miss"))


@query("""select l_orderkey, l_linenumber, l_quantity as fg, round(coalesce(case when l_linenumber % 4 = 0 then l_quantity + 2 end, l_quantity + coalesce(case when l_linenumber % 2 = 0 then 1.0 end, case when l_linenumber % 3 = 0 then l_tax * 10 + l_discount end)), 8) as fg_att,
round(coalesce(case when l_linenumber % 2 = 0 then 1.0 end, case when l_linenumber % 3 = 0 then l_tax * 10 + l_discount end, case when l_linenumber % 4 = 0 then 2.0 end), 8) as fg_miss,
case when l_linenumber % 2 = 0 then 2.0::double end as xp_miss, case when l_linenumber % 2 = 0 then 32.0::double end as xp_att from lineitem""")
def kicking_misses(spark, sf):
    """Published misses stay, misses of ranges add up, attempts follow from makes and misses."""
    n = F.col("l_linenumber")
    third = lambda c: F.when(n % 3 == 0, c)
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", n, F.col("l_quantity").alias("fg"), F.when(n % 4 == 0, F.col("l_quantity") + 2).alias("fg_att"), F.when(n % 2 == 0, 1.0).alias("fg_miss"), third(F.col("l_tax") * 10).alias("fg_miss_3039"), third(F.col("l_discount")).alias("fg_miss_50"),
        F.lit(30.0).alias("xp"), F.when(n % 2 == 0, 2.0).alias("xp_miss"), F.lit(None).cast("double").alias("xp_att"),
    )
    return rounded(impute.reconcile_kicking(rows).select("l_orderkey", "l_linenumber", "fg", "fg_att", "fg_miss", "xp_miss", "xp_att"))


@query(LINES + """, q as (select pos, sum(case when qty is not null then qty end) / nullif(sum(case when qty is not null then yds end), 0) as g from lines group by pos),
s1 as (select *, count(qty) over w as n, max(case when qty is not null and yds = 0 then 1 else 0 end) over w as z, avg(qty / nullif(yds, 0)) over w as r, avg(qty) over w as m from lines join q using (pos) window w as (partition by pos, id)),
f1 as (select * exclude (n, z, r, m, g) replace (coalesce(qty, case when n = 0 then yds * g when z = 1 or r is null then m else yds * r end) as qty) from s1),
d as (select pos, sum(case when disc is not null then disc end) / nullif(sum(case when disc is not null and qty is not null then qty end), 0) as g from f1 group by pos),
s2 as (select *, count(disc) over w as n, max(case when disc is not null and qty = 0 then 1 else 0 end) over w as z, avg(disc / nullif(qty, 0)) over w as r, avg(disc) over w as m from f1 join d using (pos) window w as (partition by pos, id)),
f2 as (select * exclude (n, z, r, m, g) replace (coalesce(disc, case when n = 0 then qty * g when z = 1 or r is null then m else qty * r end) as disc) from s2)
select id, pos, data_src, round(coalesce(qty, 0) + coalesce(yds, 0) * 0.001 + coalesce(disc, 0) * case when pos = 'SMALL' then 5 else 2 end, 6) as points from f2""")
def scored_lines(spark, sf):
    """Fills in the order of their rates (disc needs qty, qty needs yds), then points with an overlay for one group."""
    fills = boards.Fills(rates={"disc": "qty", "qty": "yds"}, touches={}, level="none")
    rows = staged(lines(spark, sf).select("id", "pos", "data_src", "qty", "yds", "disc"), "lines")
    out = boards.scored_lines(rows, {"disc": 2.0, "qty": 1.0, "yds": 0.001}, {"SMALL": {"disc": 5.0}}, fills)
    return out.withColumn("points", F.round("points", 6))


@query("select l_orderkey, l_linenumber::varchar as src_id, 'p' || l_linenumber as player, l_suppkey::varchar as team_code, l_quantity as qty, case when l_linenumber % 2 = 0 then l_tax end as tax from lineitem where l_linenumber % 5 <> 0")
def stat_blocks(spark, sf):
    """Payloads per order with nested player objects: the first stat block counts, objects without one drop out."""
    n = F.col("l_linenumber")
    block = F.struct(F.when(n % 2 == 0, F.create_map(F.lit("7"), "l_quantity", F.lit("9"), "l_tax")).otherwise(F.create_map(F.lit("7"), F.col("l_quantity"))).alias("stats"))
    other = F.struct(F.create_map(F.lit("7"), F.lit(-1.0)).alias("stats"))
    player = F.struct(F.concat(F.lit("p"), n).alias("fullName"), F.col("l_suppkey").alias("proTeamId"), F.when(n % 5 != 0, F.array(block, other)).otherwise(F.array().cast("array<struct<stats:map<string,double>>>")).alias("stats"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct(n, "l_quantity", "l_tax").alias("o"), F.struct(n.cast("string").alias("id"), player.alias("player")).alias("e"))
    sent = rows.groupBy("l_orderkey").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("o", F.to_json("e").alias("e")))), lambda x: x["e"])).alias("texts"))
    # an array of objects as text
    sent = sent.select("l_orderkey", F.concat(F.lit("["), F.array_join(F.from_json("texts", "array<string>"), ","), F.lit("]")).alias("payload"))
    return payloads.first_stat_block(sent, "payload", {"7": "qty", "9": "tax"}, ["l_orderkey"])


@query("select o_orderkey, o_orderkey::varchar as player_id, o_orderpriority as name, o_totalprice as value from orders union all select o_orderkey, 'b' || o_orderkey, null, o_custkey::double from orders where o_orderkey % 2 = 0")
def nested_objects(spark, sf):
    """Objects at differing depths of a payload, in arrays and under changing keys; others hold only one of the marks."""
    key = F.col("o_orderkey")
    stats = F.struct(F.col("o_totalprice").alias("value"))
    one = F.to_json(F.struct(key.cast("string").alias("player_id"), F.col("o_orderpriority").alias("name"), stats.alias("stats")))
    two = F.to_json(F.struct(F.concat(F.lit("b"), key).alias("player_id"), F.struct(F.col("o_custkey").cast("double").alias("value")).alias("stats")))
    payload = F.concat(F.lit('{"a": {"list": [[1, null], '), one, F.lit(']}, "player_id": "none"'), F.when(key % 2 == 0, F.concat(F.lit(', "deep": {"x": {"y": '), two, F.lit("}}"))).otherwise(""), F.lit("}"))
    rows = table(spark, sf, "orders").select("o_orderkey", payload.alias("payload"))
    out = payloads.objects_with(rows, "payload", ("player_id", "stats"), "player_id string, name string, stats struct<value:double>", ["o_orderkey"])
    return out.select("o_orderkey", "player_id", "name", F.col("stats.value").alias("value"))


@query("""with p as (select (c_custkey % 300)::varchar as platform_id, c_nationkey * 100000 + c_custkey as seq, case c_mktsegment when 'BUILDING' then 'DST' when 'MACHINERY' then null else c_mktsegment end as pos, case when c_custkey % 3 = 0 then c_name else 'f' || c_custkey || case when c_custkey % 2 = 0 then ' l' else '' end end as name, 't' || c_nationkey as team from customer),
l as (select platform_id, arg_max(struct_pack(n := name, p := pos, t := team), seq) as o from p group by platform_id) select platform_id, o.n as name, o.p as pos, o.t as team from l where o.p is not null""")
def player_maps(spark, sf):
    """Maps of players in several payloads: the last of a key counts, one without a position drops out, names fall back to their parts."""
    key = F.col("c_custkey")
    pos = F.when(F.col("c_mktsegment") == "BUILDING", "DEF").when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    o = F.struct(pos.alias("position"), F.when(key % 3 == 0, F.col("c_name")).alias("full_name"), F.concat(F.lit("f"), key).alias("first_name"), F.when(key % 2 == 0, "l").alias("last_name"), F.concat(F.lit("t"), "c_nationkey").alias("team"))
    sent = table(spark, sf, "customer").select((F.col("c_nationkey") * 100000 + key).alias("seq"), F.to_json(F.create_map((key % 300).cast("string"), o)).alias("payload"))
    return payloads.player_map(sent, "payload", "seq", {"DEF": "DST"}).select("platform_id", "name", "pos", "team")


@query("select l_orderkey, l_partkey::varchar as platform_id, l_linenumber as draft_round, l_orderkey * 10 + l_linenumber as draft_pick, l_suppkey::varchar as drafted_by from lineitem where l_orderkey % 3 <> 0")
def started_picks(spark, sf):
    """Picks of drafts (orders) in JSON; drafts that have not started are left out."""
    one = F.struct(F.col("l_partkey").cast("string").alias("player_id"), F.col("l_linenumber").alias("round"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pick_no"), F.col("l_suppkey").cast("string").alias("picked_by"))
    drafts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("picks"))
    drafts = drafts.withColumn("status", F.when(F.col("l_orderkey") % 3 == 0, "pre_draft").when(F.col("l_orderkey") % 3 == 1, "complete"))
    return payloads.started_picks(drafts, "picks", ["l_orderkey"])


@query("select l_orderkey as roster_id, 'o' || l_orderkey as owner_id, player, bool_or(l_linenumber % 2 = 0) as is_starter, bool_or(l_linenumber % 3 = 0) as is_reserve from (select l_orderkey, 'p' || l_partkey as player, l_linenumber from lineitem) group by all")
def roster_rows(spark, sf):
    """Rosters (orders) with arrays of players, starters and reserve; starters also hold blanks."""
    player, n = F.concat(F.lit("p"), "l_partkey"), F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("roster_id")).agg(F.collect_set(player).alias("players"), F.collect_set(F.when(n % 2 == 0, player)).alias("s"), F.collect_set(F.when(n % 3 == 0, player)).alias("reserve"))
    rows = rows.withColumns({"owner_id": F.concat(F.lit("o"), "roster_id"), "starters": F.concat("s", F.array(F.lit("0"), F.lit(None).cast("string")))})
    return readers.roster_rows(rows)


@query("select page_id, page_id * 2 as n, url as u from pages")
def script_objects(spark, sf):
    """Objects that a script of each page assigns."""
    script = F.concat("html", F.lit("<script>\nvar board = "), F.to_json(F.struct((F.col("page_id") * 2).alias("n"), F.col("url").alias("u"))), F.lit(";\nrun();</script>"))
    return readers.script_json(table(spark, sf, "pages").withColumn("html", script), "board", "n long, u string").select("page_id", "value.n", "value.u")


@query(LINES + SCORED + ", d as (select pos, count(*) as n, round(sum(points), 4) as total from scored group by pos) select pos, n, total, round(total / n, 6) as mean from d")
def group_totals(spark, sf):
    """Points of groups, over the same fills as the board."""
    from .queries import scored

    out = scored(spark, sf).groupBy("pos").agg(F.count("*").alias("n"), F.round(F.sum("points"), 4).alias("total"))
    return out.withColumn("mean", F.round(F.col("total") / F.col("n"), 6))


@query("select l_orderkey, l_linenumber, round(coalesce(l_quantity * 0.04 + l_tax * 4 - 3 * l_linenumber, 0), 8) as points from lineitem")
def default_rules(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("pass_yds"), F.col("l_tax").alias("pass_tds"), F.col("l_linenumber").cast("double").alias("pass_int"))
    used = {m: v for m, v in settings.DEFAULTS.items() if m in rows.columns}
    return rounded(rows.select("l_orderkey", "l_linenumber", score.points(used).alias("points")))


@query("""with k as (select l_orderkey, l_linenumber, l_partkey as id, ['QB', 'RB', 'WR', 'TE'][l_suppkey % 4 + 1] as pos, l_extendedprice / 100 as pass_yds, l_quantity * 10 as rush_yds, l_discount * 1000 as rec_yds,
  case when l_linenumber % 3 <> 0 then l_quantity end as att, case when l_linenumber % 5 = 0 then l_tax * 10 end as fd, case when l_partkey % 2 = 0 then (l_partkey % 18)::double end as games from lineitem),
r as (select case when max(case when att is not null and rush_yds = 0 then 1 else 0 end) = 1 then null else avg(case when att is not null then att / nullif(rush_yds, 0) end) end as rate, avg(att) as mean from k where pos = 'QB'),
a as (select *, coalesce(att, case when rate is not null then rate * rush_yds else mean end) as c, greatest(1, coalesce(games, 17)) as g from k, r)
select l_orderkey, l_linenumber, pos, round(case when pos = 'QB' then greatest(0, pass_yds * 0.0483) end, 9) as pass_fd,
  round(coalesce(fd, case pos when 'RB' then rush_yds * 0.0508 when 'QB' then c * case when round(c / g, 9) < 2 then 0.261 when round(c / g, 9) <= 4 then 0.342 else 0.378 end end), 9) as rush_fd,
  round(case pos when 'RB' then rec_yds * 0.045 when 'TE' then rec_yds * 0.0503 end, 9) as rec_fd from a""")
def scored_first_downs(spark, sf):
    """First downs only where the rules score them: all three kinds, the passer's runs by games of a table."""
    n, items = F.col("l_linenumber"), table(spark, sf, "lineitem")
    pos = F.element_at(F.array(*map(F.lit, ("QB", "RB", "WR", "TE"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = items.select(
        "l_orderkey", n, F.col("l_partkey").alias("id"), pos.alias("pos"), (F.col("l_extendedprice") / 100).alias("pass_yds"), (F.col("l_quantity") * 10).alias("rush_yds"), (F.col("l_discount") * 1000).alias("rec_yds"),
        F.when(n % 3 != 0, F.col("l_quantity")).alias("rush_att"), F.when(n % 5 == 0, F.col("l_tax") * 10).alias("rush_fd"),
    )
    games = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 18).alias("games"))
    out = impute.scored_first_downs(rows, {"QB": ["pass_fd", "rush_fd"], "RB": ["rush_fd", "rec_fd"], "WR": [], "TE": ["rec_fd"]}, games)
    return out.select("l_orderkey", "l_linenumber", "pos", *[F.round(c, 9).alias(c) for c in ("pass_fd", "rush_fd", "rec_fd")])
