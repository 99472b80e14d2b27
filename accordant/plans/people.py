"""Registered queries of joins, ownership, slots and published tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accordant.operators import attach, consensus, identity, rank, scope
from accordant.sources import payloads, publish, readers
from accordant.sources.stage import RUN, shared_dir
from accordant.streaming import live

from .queries import LINES, ONE, PICKS, TEAMS, lines, picks, published_board, query, table

ENTITIES = "entities as (select p_partkey as id, case when p_partkey % 7 <> 0 then split_part(p_name, ' ', 1) end as first_name, case when p_partkey % 5 <> 0 then split_part(p_name, ' ', 2) end as last_name, p_brand as team, p_type as position, p_size as age, (p_partkey % 20)::int as exp from part where p_partkey % 11 <> 0)"


def entities(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").filter(key % 11 != 0).select(
        key.alias("id"), F.when(key % 7 != 0, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("first_name"), F.when(key % 5 != 0, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("last_name"),
        F.col("p_brand").alias("team"), F.col("p_type").alias("position"), F.col("p_size").alias("age"), (key % 20).cast("int").alias("exp"),
    )


def ids(spark, sf):
    """Entities of a board with a rank: every part, by its number."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("rank"))


@query("with " + ENTITIES + " select p_partkey as id, p_partkey + 1 as rank, team, position as listed_pos, age, exp, case when e.id is not null then trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) end as player from part left join entities e on e.id = p_partkey")
def attributes(spark, sf):
    return attach.with_attributes(ids(spark, sf), entities(spark, sf))


RANKINGS = "rankings as (select l_partkey as id, l_orderkey * 10 + l_linenumber as seq, l_quantity as avg, l_tax as std_dev from lineitem where l_partkey % 3 <> 0)"


@query("with " + RANKINGS + ", one as (select id, arg_min(struct_pack(a := avg, s := std_dev), (seq, avg, std_dev)) as r from rankings group by id) select p_partkey as id, p_partkey + 1 as rank, r.a as pos_ecr, r.s as sd_ecr from part left join one on one.id = p_partkey")
def rankings(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("avg"), F.col("l_tax").alias("std_dev"))
    return attach.with_ranking(ids(spark, sf), rows, "seq")


@query(LINES + """, v as (select id, round(round(avg(site_pts), 8)::decimal(28, 8), 1)::double as adp, round(round(stddev_samp(site_pts), 8)::decimal(28, 8), 2)::double as adp_sd from lines where data_src in ('1-URGENT', '5-LOW') group by id)
select p_partkey as id, p_partkey + 1 as rank, adp, adp_sd, round(p_partkey + 1 - adp, 6) as adp_diff from part left join v on id = p_partkey""")
def draft_difference(spark, sf):
    feeds = {s: lines(spark, sf).filter(F.col("data_src") == s).withColumnRenamed("site_pts", "adp") for s in ("1-URGENT", "5-LOW")}
    values = consensus.source_table(payloads.draft_values(feeds, "adp"), "adp", list(feeds))
    out = attach.with_draft_value(ids(spark, sf), values)
    return out.withColumn("adp_diff", F.round("adp_diff", 6))


@query(LINES + """select id, max(case when data_src = '1-URGENT' then site_pts end) as site_pts_urgent, max(case when data_src = '5-LOW' then site_pts end) as site_pts_low, round(round(avg(site_pts), 8)::decimal(28, 8), 1)::double as site_pts, round(round(stddev_samp(site_pts), 8)::decimal(28, 8), 2)::double as site_pts_sd
from lines where data_src in ('1-URGENT', '5-LOW') group by id""")
def values_by_source(spark, sf):
    rows = lines(spark, sf).withColumn("data_src", F.when(F.col("data_src") == "1-URGENT", "urgent").when(F.col("data_src") == "5-LOW", "low"))
    return consensus.source_table(rows, "site_pts", ["urgent", "low"])


CROSSWALK = """crosswalk as (select p_partkey as id, p_partkey * 2 + 1 as seq, 'x' || p_partkey as platform_id, case when p_partkey % 4 <> 0 then p_brand end as platform_team, case when p_partkey % 9 = 0 then 'Out' end as injury_status from part
  union all select p_partkey, p_partkey * 2, 'x' || p_partkey, 'Brand#1', 'Doubtful' from part where p_partkey % 10 = 0),
cross1 as (select id, arg_min(struct_pack(p := platform_id, t := platform_team, i := injury_status), seq) as c from crosswalk group by id),
rosters as (select 'x' || l_partkey as platform_id, l_orderkey * 10 + l_linenumber as seq, 'S' || l_suppkey as team_name, 'm' || l_suppkey as manager, l_linenumber % 2 = 0 as is_starter from lineitem where l_partkey % 2 = 0),
roster1 as (select platform_id, arg_min(struct_pack(t := team_name, m := manager, s := is_starter), seq) as r from rosters group by platform_id)"""


def crosswalk(spark, sf):
    key, part = F.col("p_partkey"), table(spark, sf, "part")
    name = F.concat(F.lit("x"), key).alias("platform_id")
    one = part.select(key.alias("id"), (key * 2 + 1).alias("seq"), name, F.when(key % 4 != 0, F.col("p_brand")).alias("platform_team"), F.when(key % 9 == 0, "Out").alias("injury_status"))
    return one.unionByName(part.filter(key % 10 == 0).select(key.alias("id"), (key * 2).alias("seq"), name, F.lit("Brand#1").alias("platform_team"), F.lit("Doubtful").alias("injury_status")))


def rosters(spark, sf):
    return table(spark, sf, "lineitem").filter("l_partkey % 2 = 0").select(
        F.concat(F.lit("x"), "l_partkey").alias("platform_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("S"), "l_suppkey").alias("team_name"),
        F.concat(F.lit("m"), "l_suppkey").alias("manager"), (F.col("l_linenumber") % 2 == 0).alias("is_starter"),
    )


_CONTEXT = "id, rank, c.p as platform_id, c.i as injury_status, case coalesce(team, c.t) when 'Brand#1' then 'ONE' when 'Brand#2' then 'TWO' else coalesce(team, c.t) end as team"
_TEAMED = "b as (select p_partkey as id, p_partkey + 1 as rank, case when p_partkey % 3 = 0 then p_brand end as team from part)"


def teamed(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("rank"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("team"))


@query(f"with {CROSSWALK}, {_TEAMED} select {_CONTEXT}, r.t as rostered_by, r.m as manager, r.s as starting from b left join cross1 using (id) left join roster1 on roster1.platform_id = c.p")
def league_context(spark, sf):
    return attach.with_context(teamed(spark, sf), crosswalk(spark, sf), rosters(spark, sf), {"Brand#1": "ONE", "Brand#2": "TWO"}, "seq")


@query(f"with {CROSSWALK}, {_TEAMED} select {_CONTEXT}, null::varchar as rostered_by, null::varchar as manager, null::boolean as starting from b left join cross1 using (id)")
def league_context_before_rosters(spark, sf):
    return attach.with_context(teamed(spark, sf), crosswalk(spark, sf), None, {"Brand#1": "ONE", "Brand#2": "TWO"}, "seq")


OWNED = "picks as (select cast(json_extract_string(props, '$.k') as bigint)::varchar as platform_id, (event_id // 5000)::int as season, event_id as draft_pick, (event_id // 100)::int as draft_round, user_id as drafted_by from events where event_type = 'purchase')"
ROSTERED = """starter as (select cast(json_extract_string(props, '$.k') as bigint)::varchar as platform_id, arg_min(struct_pack(s := user_id % 2 = 0, o := user_id), event_id) as r from events where event_type = 'view' group by 1),
managers as (select distinct user_id as owner_id, 'm' || user_id as manager, case when user_id % 4 <> 0 then 'T' || user_id else 'm' || user_id end as team_name from events where user_id % 6 <> 0),
names as (select p_partkey::varchar as platform_id, p_partkey as id, p_name as player from part where p_partkey % 3 <> 0)"""
_COLUMNS = "platform_id, id, player, team_name, manager, draft_round, draft_pick, is_starter"


def owners(spark, sf):
    events = table(spark, sf, "events").withColumn("platform_id", F.get_json_object("props", "$.k").cast("long").cast("string"))
    drafted = events.filter("event_type = 'purchase'").select("platform_id", F.floor(F.col("event_id") / 5000).cast("int").alias("season"), F.col("event_id").alias("draft_pick"), F.floor(F.col("event_id") / 100).cast("int").alias("draft_round"), F.col("user_id").alias("drafted_by"))
    held = events.filter("event_type = 'view'").select("platform_id", F.col("event_id").alias("roster_id"), F.col("user_id").alias("owner_id"), (F.col("user_id") % 2 == 0).alias("is_starter"))
    users = F.to_json(F.array(F.struct(F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("m"), "user_id").alias("display_name"), F.struct(F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("T"), "user_id")).otherwise("").alias("team_name")).alias("metadata"))))
    known = payloads.managers(events.filter("user_id % 6 <> 0").select("user_id").distinct().select(users.alias("payload")), "payload", []).withColumn("owner_id", F.col("owner_id").cast("long"))
    names = table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("platform_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("player"))
    return drafted, held, known, names


@query(f"""with {OWNED}, {ROSTERED}, last as (select platform_id, arg_max(struct_pack(d := draft_round, p := draft_pick, b := drafted_by), (season, draft_pick)) as p from picks group by platform_id)
select platform_id, id, player, team_name, manager, p.d as draft_round, p.p as draft_pick, r.s as is_starter from last left join starter using (platform_id) left join managers on owner_id = p.b left join names using (platform_id)""")
def ownership(spark, sf):
    return attach.ownership(*owners(spark, sf))


@query(f"with {ROSTERED} select platform_id, id, player, team_name, manager, null::int as draft_round, null::bigint as draft_pick, r.s as is_starter from starter left join managers on owner_id = r.o left join names using (platform_id)")
def ownership_before_picks(spark, sf):
    """The same league before its draft: no pick at all, so the rosters count."""
    drafted, *rest = owners(spark, sf)
    return attach.ownership(drafted.filter("draft_pick < 0"), *rest)


@query("""with o as (select o_custkey % 20 as draft_id, (o_orderkey % 12 + 1)::int as slot, min(o_custkey) as user_id from orders where o_orderkey % 3 <> 0 group by all),
f as (select draft_id, user_id, min(slot) as slot from o group by all), s as (select distinct draft_id, unnest(range(1, 13))::int as slot from o)
select s.draft_id, s.slot, f.user_id, c_name as manager, c_mktsegment as team_name from s left join f using (draft_id, slot) left join customer on c_custkey = f.user_id""")
def draft_order(spark, sf):
    """Slots of drafts with the managers of the users in them; some slots have no user."""
    rows = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").groupBy((F.col("o_custkey") % 20).alias("draft_id"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("slot")).agg(F.min("o_custkey").alias("user_id"))
    rows = rows.groupBy("draft_id", "user_id").agg(F.min("slot").alias("slot"))
    drafts = rows.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("user_id", "slot"))).alias("order")).withColumn("teams", F.lit(12))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("manager"), F.col("c_mktsegment").alias("team_name"))
    return attach.with_managers(readers.draft_slots(drafts), known, "user_id").select("draft_id", "slot", "user_id", "manager", "team_name")


@query("""select p_partkey as id, coalesce(case when p_partkey % 3 = 0 then (p_partkey * 2)::double end, case when split_part(p_brand, '#', 2)::int % 2 = 0 then 1000.0 + split_part(p_brand, '#', 2)::int end) as spread from part""")
def fallback_lookup(spark, sf):
    """A value by id, and by team where the id has none."""
    part = table(spark, sf, "part")
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    by_id = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("i"), "p_partkey").alias("key"), (F.col("p_partkey") * 2).cast("double").alias("value"))
    by_team = part.filter(number % 2 == 0).select(F.col("p_brand").alias("key"), (1000.0 + number).alias("value")).distinct()
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("i"), "p_partkey").alias("own"), F.col("p_brand").alias("team"))
    return attach.looked_up(rows, by_id.unionByName(by_team), ["own", "team"], "spread").select("id", "spread")


@query("select p_partkey as id, p_partkey + 1 as rank, (select min('s' || l_suppkey) from lineitem where l_partkey = p_partkey) as src_id from part")
def source_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("src_id"))
    return attach.reverse_lookup(ids(spark, sf), rows, "src_id")


_HELD = f", {OWNED}, {ROSTERED}, last as (select platform_id, arg_max(struct_pack(d := draft_round, p := draft_pick, b := drafted_by), (season, draft_pick)) as p from picks group by platform_id), own as (select platform_id, coalesce(team_name, manager) as drafted_by, manager as drafted_manager, p.d as draft_round, p.p as draft_pick from last left join managers on owner_id = p.b)"


@query(LINES + ONE + _HELD + "select pos, id, points_vor, drafted_by, drafted_manager, draft_round, draft_pick from one left join own on own.platform_id = id::varchar")
def held_board(spark, sf):
    drafted, held, known, names = owners(spark, sf)
    rows = published_board(spark, sf).select("pos", "id", "points_vor", F.col("id").cast("string").alias("platform_id"))
    return attach.with_holder(rows, attach.ownership(drafted, held, known, names)).drop("platform_id")


@query(LINES + ONE + _HELD + "select pos, id, p_name as player from one join part on p_partkey = id left join own on own.platform_id = id::varchar where pos = 'SMALL' and contains(lower(p_name), 'ri') and drafted_by is null")
def filtered_board(spark, sf):
    rows = published_board(spark, sf).select("pos", "id", F.col("id").cast("string").alias("platform_id"))
    rows = attach.with_holder(rows, attach.ownership(*owners(spark, sf)))
    rows = rows.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("player")), "id")
    return attach.matches_filter(rows, "SMALL", "Ri", hide_taken=True).select("pos", "id", "player")


@query(f"with {OWNED} select platform_id, draft_pick from picks order by draft_pick desc limit 30")
def latest_thirty(spark, sf):
    return scope.latest_picks(owners(spark, sf)[0]).select("platform_id", "draft_pick")


@query(LINES + ONE.replace("where avg_type = 'weighted'", "") + "select avg_type, rank, id from one")
def board_order(spark, sf):
    from .queries import board

    return scope.output_order(board(spark, sf)).select("avg_type", "rank", "id")


SHARED = "slots as (select c_custkey % 40 as scope, c_custkey as slot_order, case when c_custkey % 4 = 0 then ['RB', 'WR', 'TE'] when c_custkey % 4 = 1 then ['QB'] when c_custkey % 4 = 2 then ['TE', 'WR'] else [c_mktsegment] end as eligible, 10 as teams from customer)"


def scope_slots(spark, sf):
    key = F.col("c_custkey")
    words = lambda *w: F.array(*map(F.lit, w))
    eligible = F.when(key % 4 == 0, words("RB", "WR", "TE")).when(key % 4 == 1, words("QB")).when(key % 4 == 2, words("TE", "WR")).otherwise(F.array("c_mktsegment"))
    return table(spark, sf, "customer").select((key % 40).alias("scope"), key.alias("slot_order"), eligible.alias("eligible"), F.lit(10).alias("teams"))


@query(f"with {SHARED} select scope, pos, greatest(1, round_even(sum(share), 0))::int as baseline from (select scope, unnest(eligible) as pos, teams / len(eligible) as share from slots) group by all")
def share_ranks(spark, sf):
    return scope.share_ranks(scope_slots(spark, sf))


@query(f"with {SHARED}, e as (select scope, slot_order, unnest(eligible) as pos, unnest(range(len(eligible))) as n from slots), f as (select scope, pos, min((slot_order, n)) as f from e group by all) select scope, pos, (row_number() over (partition by scope order by f))::int as place from f")
def startable_groups(spark, sf):
    return scope.startable_groups(scope_slots(spark, sf))


@query(f"with s as (select distinct (l_suppkey % {TEAMS} + 1)::int as slot from lineitem), r as (select slot, unnest(range(1, 16))::int as round from s) select slot, round, (round - 1) * {TEAMS} + case when round % 2 = 1 then slot else {TEAMS} + 1 - slot end as pick from r")
def picks_of_slots(spark, sf):
    return scope.picks_of(table(spark, sf, "lineitem").select((F.col("l_suppkey") % TEAMS + 1).cast("int").alias("slot")).distinct(), TEAMS, 15)


@query(f"""with m as (select distinct case when user_id % 3 = 0 then 'm' || user_id else 'T' || user_id end as me from events),
o as (select ('m' || user_id) as manager, ('T' || user_id) as team_name, min(event_id) % {TEAMS} + 1 as slot from events where user_id % 5 = 0 group by user_id),
p as (select ('m' || user_id) as manager, ('T' || user_id) as team_name, event_id + 1 as draft_pick from events where event_type = 'purchase' and user_id % 7 <> 0),
a as (select me, min(slot) as slot from (select manager as me, slot from o union all select team_name, slot from o) group by me), b as (select me, min(draft_pick) as d from (select manager as me, draft_pick from p union all select team_name, draft_pick from p) group by me)
select me, coalesce(slot, case when ((d - 1) // {TEAMS}) % 2 = 1 then {TEAMS} - (d - 1) % {TEAMS} else (d - 1) % {TEAMS} + 1 end)::int as slot from m left join a using (me) left join b using (me)""")
def my_slots(spark, sf):
    events = table(spark, sf, "events")
    manager, team = F.concat(F.lit("m"), "user_id"), F.concat(F.lit("T"), "user_id")
    me = events.select(F.when(F.col("user_id") % 3 == 0, manager).otherwise(team).alias("me")).distinct()
    order = events.filter("user_id % 5 = 0").groupBy("user_id").agg((F.min("event_id") % TEAMS + 1).alias("slot")).select(manager.alias("manager"), team.alias("team_name"), "slot")
    own = events.filter("event_type = 'purchase' and user_id % 7 <> 0").select(manager.alias("manager"), team.alias("team_name"), (F.col("event_id") + 1).alias("draft_pick"))
    return scope.my_slot(me, order, own, TEAMS)


@query("""with c as (select s_suppkey as id, 'k' || (s_suppkey % 60) as src, s_nationkey as seq from supplier) select c_custkey, c_custkey % 80 as n, (select arg_min(id, (seq, id)) from c where src = 'k' || (c_custkey % 80)) as ref_id from customer""")
def crosswalk_ids(spark, sf):
    cross = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("k"), F.col("s_suppkey") % 60).alias("src"), F.col("s_nationkey").alias("seq"))
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 80).alias("n"), F.concat(F.lit("k"), F.col("c_custkey") % 80).alias("src"))
    return identity.from_crosswalk(rows, cross, "src", "id", "seq").select("c_custkey", "n", "ref_id")


@query("""with r as (select s_suppkey as ref_id, 't' || s_nationkey as team from supplier where s_suppkey % 2 = 0)
select s_suppkey as row_id, case when s_suppkey % 3 = 0 then (select min(ref_id) from r where r.team = 't' || s_nationkey) end as ref_id from supplier""")
def team_ids(spark, sf):
    """Rows of one group get their id from the team alone; names match nothing here."""
    team = F.concat(F.lit("t"), "s_nationkey").alias("team")
    reference = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ref_id"), F.lit("A B").alias("name"), F.lit("DST").alias("pos"), team)
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("z"), "s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "DST").otherwise("QB").alias("pos"), team)
    return identity.resolve(rows, reference, [{}, {}], "DST").select("row_id", "ref_id")


@query(r"""with n as (select c_custkey, case c_custkey % 6 when 0 then 'Malcolm X' when 1 then 'Henry IX' when 2 then 'A.J. Brown Jr.' when 3 then 's' when 4 then 'Eagles Defense' else 'KCC' end as name from customer)
select c_custkey, case name when 'Malcolm X' then 'malcolmx' when 'Henry IX' then 'henryix' when 'A.J. Brown Jr.' then 'ajbrown' when 's' then 'db' when 'Eagles Defense' then 'eagles' else 'kc' end as key from n""")
def normal_names(spark, sf):
    names = ["Malcolm X", "Henry IX", "A.J. Brown Jr.", "s", "Eagles Defense", "KCC"]
    rows = table(spark, sf, "customer").withColumn("name", F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 6 + 1).cast("int")))
    return rows.select("c_custkey", identity.normal(F.col("name"), [{"S": "DB"}, {"KCC": "KC"}]).alias("key"))


@query("select 'slot' as kind, c_mktsegment as name, count(*) as count from customer group by all union all select 'replacement', p_type, max(p_size)::bigint from part group by all")
def slots_table(spark, sf):
    return publish.slots_table(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("slot")), table(spark, sf, "part").groupBy(F.col("p_type").alias("pos")).agg(F.max("p_size").alias("baseline")))


@query(LINES + "select (select max(n) from (select count(*) as n from lines group by pos)) as entities, (select string_agg(distinct data_src, ', ' order by data_src) from lines) as sources")
def run_summary(spark, sf):
    rows = lines(spark, sf)
    return publish.run_summary(rows.withColumnRenamed("pos", "avg_type"), rows).drop("written_at")


@query(LINES + "select 'lines' as name, count(*) as rows, count(distinct data_src) as parts from lines union all select 'none', 0, 0")
def published_snapshot(spark, sf):
    """Tables published, replaced, and read back; an empty one keeps its columns."""
    path = f"{shared_dir(spark)}/{RUN}/snapshot-{uuid.uuid4().hex}"
    rows = lines(spark, sf).select("id", "pos", "data_src", "qty")
    publish.publish({"lines": rows.limit(0), "none": rows}, path)
    publish.publish({"lines": rows, "none": rows.limit(0)}, path, {"lines": "data_src"}, {"lines": ["pos", "id"]})
    counts = [publish.published(spark, path, t).agg(F.lit(t).alias("name"), F.count("*").alias("rows"), F.count_distinct("data_src").alias("parts")) for t in ("lines", "none")]
    return counts[0].unionByName(counts[1])


@query(LINES + "select pos, data_src, count(*) as n, round(avg(qty), 6) as qty from lines group by all having count(*) > 10")
def adhoc_sql(spark, sf):
    publish.as_views({"accordant_lines": lines(spark, sf)})
    return spark.sql("select pos, data_src, count(*) as n, round(avg(qty), 6) as qty from accordant_lines group by pos, data_src having count(*) > 10")


_WIDE = ", ".join(f"max(case when data_src = '{s}' then value end) as \"{s}\"" for s in ("1-URGENT", "5-LOW"))


@query(LINES + f", long as (select id, data_src, unnest(['qty', 'disc']) as stat, unnest([qty, disc]) as value from lines) select id, stat, {_WIDE} from long where value is not null group by all")
def wide_drilldown(spark, sf):
    return publish.wide(publish.drill_down(lines(spark, sf), ["qty", "disc"]), ["1-URGENT", "5-LOW"])


@query("with m as (select max(ts) as top from events), s as (select user_id as scope, max(ts) as last from events group by 1) select scope, last, epoch_us(top) - epoch_us(last) > 3600 * 1000000::bigint as stale from s, m")
def freshness(spark, sf):
    """Scopes of a feed polled every quarter of an hour, as of its last event: those without one for an hour are stale."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("scope"), "ts")
    top = rows.agg(F.max("ts")).first()[0]
    return live.freshness(rows, 900.0, F.lit(top), ["scope"])


def _both(c: str) -> str:
    return f"dense_rank() over (partition by l_returnflag order by {c} desc)"


@query(f"select l_orderkey, l_linenumber, l_quantity, case when l_linenumber % 5 <> 0 then {_both('case when l_linenumber % 5 <> 0 then l_extendedprice end')} end::int as rank from (select * from lineitem order by 1) where true".replace("desc)", "desc nulls last)"))
def spread_ranks(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice")).alias("v"))
    return rank.spread_rank(rows, "v", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_quantity", "rank")


