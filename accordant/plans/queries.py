"""The registered queries over the given tables, each with its SQL where SQL can express it.

`lines` is the common input: one row per (id, pos, data_src), the first line item of a part under an order priority,
with gaps made by rule. Doubles are rounded to 8 digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.operators import board as boards
from accordant.operators import clean, consensus, identity, impute, rank, scope, score
from accordant.sources import payloads, publish, readers
from accordant.sources.stage import RUN, shared_dir, staged
from accordant.streaming import live

RULES = {"qty": 1.0, "yds": 0.001}
WEIGHTS = {"1-URGENT": 0.3, "2-HIGH": 0.25, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.15, "5-LOW": 0.0}
TIERS = [(5.0, 10.0), (15.0, 7.0), (25.0, 4.0), (35.0, 1.0), (45.0, -1.0)]
BASELINE, TEAMS = 12, 6
COVERED = {"1-URGENT": 3, "2-HIGH": 6, "3-MEDIUM": 6, "4-NOT SPECIFIED": 2, "5-LOW": 6}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, 8) for f in df.schema if f.dataType.simpleString() == "double"})


#: Columns of `lines` beside its keys, in the order that decides between rows of one line item.
METRICS = ("qty", "yds", "disc", "tax", "site_pts")


def lines(spark: SparkSession, sf: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The common input with the first of METRICS that are asked for: the least struct reads and deals what it names, whatever is selected of it later."""
    if not metrics or metrics != METRICS[: len(metrics)]:
        raise ValueError("metrics must be the first of METRICS")  # without one before them others would decide
    items, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("id"), F.col("p_type").alias("pos"), F.col("o_orderpriority").alias("data_src"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("yds"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), (F.col("l_extendedprice") / 1000).alias("site_pts"), "l_orderkey", "l_linenumber",
    )
    # the first row of each key without a sort: the least struct, aggregated before the shuffle
    first = rows.groupBy("id", "pos", "data_src").agg(F.min(F.struct("l_orderkey", "l_linenumber", *metrics)).alias("f")).select("id", "pos", "data_src", "f.*")
    gap = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return first.withColumns({m: F.when(gap % k != 0, F.col(m)) for m, k in (("qty", 5), ("disc", 3)) if m in metrics})


LINES = """
with firsts as (select l_partkey as id, p_type as pos, o_orderpriority as data_src, l_quantity as qty, l_extendedprice as yds, l_discount as disc, l_tax as tax,
  l_extendedprice / 1000 as site_pts, l_orderkey, l_linenumber,
  row_number() over (partition by l_partkey, p_type, o_orderpriority order by l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) as rn
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
lines as (select id, pos, data_src, case when (l_orderkey * 7 + l_linenumber) % 5 <> 0 then qty end as qty, yds,
  case when (l_orderkey * 7 + l_linenumber) % 3 <> 0 then disc end as disc, tax, site_pts, l_orderkey, l_linenumber from firsts where rn = 1)
"""
FILLED = """,
rates as (select pos, sum(case when qty is not null and yds is not null then qty end) / nullif(sum(case when qty is not null and yds is not null then yds end), 0) as g from lines group by pos),
stat as (select *, count(qty) over w as n, max(case when qty is not null and yds = 0 then 1 else 0 end) over w as z, avg(qty / nullif(yds, 0)) over w as r, avg(qty) over w as m from lines join rates using (pos) window w as (partition by pos, id)),
filled as (select id, pos, data_src, coalesce(qty, case when n = 0 then yds * g when z = 1 or r is null then m else yds * r end) as qty, yds, disc, tax, site_pts from stat)
"""
SCORED = FILLED + """,
scored as (select id, pos, data_src, coalesce(qty, 0) * 1.0 + coalesce(yds, 0) * 0.001 as points from filled)
"""
AVERAGE = SCORED + """,
summary as (select pos, id, avg(points) as points, stddev_samp(points) as sd_pts, quantile_cont(points, 0.05) as floor, quantile_cont(points, 0.95) as ceiling, count(points) as sources from scored group by pos, id)
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.group_rate_fill(staged(lines(spark, sf), "lines"), "qty", "yds")
    return filled.select("id", "pos", "data_src", score.points(RULES).alias("points"))


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "data_src string, weight double")


@query(LINES + "select id, pos, data_src, qty, yds, disc from lines where coalesce(qty, disc) is not null")
def source_first_row(spark, sf):
    return clean.drop_empty_rows(lines(spark, sf), ["qty", "disc"]).select("id", "pos", "data_src", "qty", "yds", "disc")


_CAT = ", ".join(f"('{k}', {v})" for k, v in COVERED.items())


@query(LINES + f", types as (select p_type as pos, row_number() over (order by p_type) as k from (select distinct p_type from part)) select pos, data_src, count(*) as n from lines join types using (pos) join (values {_CAT}) c(data_src, top) using (data_src) where k <= top group by all")
def source_summary(spark, sf):
    groups = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]
    catalogue = spark.createDataFrame([(s, groups[:n]) for s, n in COVERED.items()], "data_src string, positions array<string>")
    return readers.covered(lines(spark, sf), catalogue).groupBy("pos", "data_src").agg(F.count("*").alias("n"))


@query(LINES + "select id, pos, data_src, round(coalesce(disc, avg(disc) over (partition by pos, id)), 8) as disc from lines")
def mean_fill(spark, sf):
    return rounded(impute.mean_fill(lines(spark, sf), "disc").select("id", "pos", "data_src", "disc"))


@query(LINES + """, stat as (select *, count(disc) over w as n, max(case when disc is not null and tax = 0 then 1 else 0 end) over w as z, avg(disc / nullif(tax, 0)) over w as r, avg(disc) over w as m from lines window w as (partition by pos, id))
select id, pos, data_src, round(coalesce(disc, case when n = 0 then null when z = 1 or r is null then m else tax * r end), 8) as disc from stat""")
def rate_fill(spark, sf):
    return rounded(impute.rate_fill(lines(spark, sf), "disc", "tax").select("id", "pos", "data_src", "disc"))


@query(LINES + FILLED + "select id, pos, data_src, round(qty, 8) as qty from filled")
def group_rate_fill(spark, sf):
    return rounded(impute.group_rate_fill(staged(lines(spark, sf), "lines"), "qty", "yds").select("id", "pos", "data_src", "qty"))


@query(LINES + """, rates as (select pos, sum(case when disc is not null and coalesce(qty, tax) is not null then disc end) / nullif(sum(case when disc is not null and coalesce(qty, tax) is not null then coalesce(qty, 0) + coalesce(tax, 0) end), 0) as g from lines group by pos)
select id, pos, data_src, round(coalesce(disc, case when coalesce(qty, tax) is not null then (coalesce(qty, 0) + coalesce(tax, 0)) * g end), 8) as disc from lines join rates using (pos)""")
def touch_rate_fill(spark, sf):
    return rounded(impute.touch_rate_fill(staged(lines(spark, sf), "lines"), "disc", ["qty", "tax"]).select("id", "pos", "data_src", "disc"))


_CUTS = ", ".join(f"{k / 10}" for k in range(11))


@query(LINES + f""", cuts as (select pos, list_distinct(quantile_cont(site_pts, [{_CUTS}])) as cuts from lines group by pos),
placed as (select lines.*, greatest(len([e for e in cuts if e < site_pts]) - 1, 0) as bucket from lines join cuts using (pos)),
near as (select pos, bucket, median(qty) as near from placed group by all), whole as (select pos, median(qty) as whole from lines group by pos)
select id, pos, data_src, round(coalesce(qty, near, whole), 8) as qty from placed join near using (pos, bucket) join whole using (pos)""")
def decile_fill(spark, sf):
    return rounded(impute.decile_fill(staged(lines(spark, sf), "lines"), "qty", "site_pts").select("id", "pos", "data_src", "qty"))


def kicks(spark, sf):
    k, v = F.col("l_orderkey") + F.col("l_linenumber"), lambda c, m: F.when(k % m != 0, c)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", v(F.col("l_quantity"), 2).alias("fg_0039"), v(F.col("l_tax") * 10, 3).alias("fg_0019"), F.lit(None).cast("double").alias("fg_2029"), v(F.col("l_discount") * 10, 5).alias("fg_3039"),
        v(F.col("l_linenumber") * 1.0, 3).alias("fg_4049"), v(F.col("l_discount") * 20, 7).alias("fg_50"), v(F.col("l_quantity") + 5, 11).alias("fg"), v(F.col("l_quantity") + 9, 4).alias("fg_att"),
        F.lit(None).cast("double").alias("fg_miss"), (F.col("l_discount") * 1000).alias("fg_pct"), (F.col("l_quantity") + 3).alias("xp_att"), F.col("l_quantity").alias("xp"),
    )


@query("""with k as (select l_orderkey, l_linenumber, l_orderkey + l_linenumber as k, l_quantity as q, l_tax as t, l_discount as d from lineitem),
a as (select l_orderkey, l_linenumber, q, d, case when k % 2 <> 0 then q end as c, case when k % 3 <> 0 then t * 10 end as a1, case when k % 5 <> 0 then d * 10 end as a3, case when k % 3 <> 0 then l_linenumber * 1.0::double end as a4,
  case when k % 7 <> 0 then d * 20 end as a5, case when k % 11 <> 0 then q + 5 end as fg, case when k % 4 <> 0 then q + 9 end as att from k),
b as (select *, coalesce(a1, c * 0.04::double) as b1, c * 0.38::double as b2, coalesce(a3, c * 0.58::double) as b3 from a),
e as (select *, coalesce(fg, case when coalesce(b1, b2, b3, a4, a5) is not null then coalesce(b1, 0) + coalesce(b2, 0) + coalesce(b3, 0) + coalesce(a4, 0) + coalesce(a5, 0) end) as g from b),
f as (select *, coalesce(att, g / nullif(d * 1000 * 0.01::double, 0)) as h from e)
select l_orderkey, l_linenumber, round(b1, 8) as fg_0019, round(b2, 8) as fg_2029, round(b3, 8) as fg_3039, round(g, 8) as fg, round(h, 8) as fg_att, round(h - g, 8) as fg_miss, round(q + 3 - q, 8) as xp_miss from f""")
def kicking_reconcile(spark, sf):
    return rounded(impute.reconcile_kicking(kicks(spark, sf)).select("l_orderkey", "l_linenumber", "fg_0019", "fg_2029", "fg_3039", "fg", "fg_att", "fg_miss", "xp_miss"))


MODELS = {"m30": (-0.5, "yds", 0.0001), "m35": (-0.2, "yds", 0.00004), "m40": (-0.1, "yds", 0.00002), "q40": (-1.0, "qty", 0.1)}


@query(LINES + """, e as (select id, pos, data_src, greatest(0, -0.5 + yds * 0.0001) as a, greatest(0, -0.2 + yds * 0.00004) as b, greatest(0, -0.1 + yds * 0.00002) as c, case when qty is null then 0 else greatest(0, -1.0 + qty * 0.1) end as q from lines)
select id, pos, data_src, round(a + b + c, 8) as m30, round(b + c, 8) as m35, round(c, 8) as m40, round(q, 8) as q40 from e""")
def milestone_rollup(spark, sf):
    out = impute.linear_estimate(lines(spark, sf), MODELS, {"m30": ["m30", "m35", "m40"], "m35": ["m35", "m40"]})
    return rounded(out.select("id", "pos", "data_src", "m30", "m35", "m40", F.coalesce("q40", F.lit(0.0)).alias("q40")))


@query("""with t as (select p_type as pos, row_number() over (order by p_type) as k from (select distinct p_type from part)), """ + LINES.strip()[5:] + """
select id, pos, data_src, round(coalesce(qty, greatest(0, case k when 1 then yds * 0.0508 when 2 then yds * 0.045 when 3 then yds * 0.0503 end)), 8) as fd,
  round(greatest(0, qty * case when round(qty / greatest(1, tax * 100), 9) < 2 then 0.261 when round(qty / greatest(1, tax * 100), 9) <= 4 then 0.342 else 0.378 end), 8) as carry_fd from lines join t using (pos)""")
def first_downs(spark, sf):
    groups = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]
    rows = lines(spark, sf).withColumn("fd", F.col("qty"))
    carry = F.when(F.col("qty").isNotNull(), impute.carry_first_downs(rows, "qty", F.col("tax") * 100, [(2.0, 0.261), (4.0, 0.342)], 0.378))
    zero = F.when(F.col("fd").isNull() & ~F.col("pos").isin(groups[:3]), 0.0).otherwise(F.col("fd"))
    out = impute.first_downs(rows, dict(zip(groups, (0.0508, 0.045, 0.0503))), "fd", "yds").withColumn("fd", zero)
    return rounded(out.select("id", "pos", "data_src", "fd", F.coalesce(carry, F.lit(0.0)).alias("carry_fd")))


@query(LINES + SCORED + "select id, pos, data_src, round(points, 8) as points from scored")
def score_lines(spark, sf):
    return rounded(scored(spark, sf))


def supplier_rules(spark, sf, suppliers="s_suppkey <= 20"):
    """A rule set per supplier: base rules, and an overlay for one group."""
    supp = table(spark, sf, "supplier").filter(suppliers)
    base = supp.select(F.col("s_suppkey").alias("scope"), F.explode(F.create_map(F.lit("qty"), F.col("s_suppkey") / 10.0, F.lit("yds"), F.lit(0.001), F.lit("disc"), F.col("s_nationkey") * 1.0)).alias("stat", "points"))
    own = supp.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("scope"), F.lit("ECONOMY").alias("p"), F.lit("qty").alias("stat"), F.lit(9.0).alias("points"))
    first = table(spark, sf, "part").agg(F.min("p_type").alias("pos"))
    own = own.join(F.broadcast(first)).select("scope", "pos", "stat", "points")  # one row on the right
    return base.withColumn("pos", F.lit(None).cast("string")).select("scope", "pos", "stat", "points").unionByName(own)


@query(LINES + """, s as (select s_suppkey as scope, s_suppkey / 10.0::double as q, 0.001::double as y, s_nationkey * 1.0::double as d, s_suppkey % 3 = 0 as own from supplier where s_suppkey <= 20), f as (select min(p_type) as first from part)
select scope, pos, id, data_src, round(sum(coalesce(qty * case when own and pos = first then 9.0::double else q end, 0) + yds * y + coalesce(disc * d, 0)), 8) as points from lines, s, f group by all""")
def score_many_rules(spark, sf):
    return rounded(score.many_rule_points(lines(spark, sf, METRICS[:3]), supplier_rules(spark, sf), ["qty", "yds", "disc"], ["id", "data_src"]))


@query(SQL["score_many_rules"].replace(" where s_suppkey <= 20", ""))
def score_all_rules(spark, sf):
    """score_many_rules for all suppliers: rows grow with lines times suppliers."""
    return rounded(score.many_rule_points(lines(spark, sf, METRICS[:3]), supplier_rules(spark, sf, "true"), ["qty", "yds", "disc"], ["id", "data_src"]))


@query("select l_orderkey, l_linenumber, case when q is null then null when q <= 5 then 10.0 when q <= 15 then 7.0 when q <= 25 then 4.0 when q <= 35 then 1.0 else -1.0 end::double as points from (select *, case when l_linenumber % 4 <> 0 then l_quantity end as q from lineitem)")
def bracket_points(spark, sf):
    q = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.bracket(q, TIERS).alias("points"))


@query("""with m as (select l_suppkey, avg(l_quantity) * 17 as season, stddev_samp(l_quantity) as sd from lineitem group by all), g as (select *, unnest(range(1, 18)) as game from m),
u as (select *, (('0x' || substr(md5(concat_ws('|', l_suppkey, game, 1, 1)), 1, 10))::bigint + 0.5) / 1099511627776 as a, (('0x' || substr(md5(concat_ws('|', l_suppkey, game, 1, 2)), 1, 10))::bigint + 0.5) / 1099511627776 as b from g),
x as (select *, round_even(season / 17 + sd * (sqrt(-2 * ln(a)) * cos(2 * pi() * b)), 0) as x from u)
select l_suppkey, sum(case when x <= 5 then 10.0 when x <= 15 then 7.0 when x <= 25 then 4.0 when x <= 35 then 1.0 else -1.0 end::double) as points from x group by l_suppkey""")
def bracket_monte_carlo(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") * 17).alias("season"), F.stddev_samp("l_quantity").alias("sd"))
    return score.season_bracket(means, ["l_suppkey"], F.col("season"), F.col("sd"), TIERS)


KEYS = ("rec", "rush", "bonus_a", "bonus_b", "fgm", "fgm_50", "miss_30")


def settings(spark, sf):
    """Settings of a scope (supplier): keys by line number, values from the line items; the largest counts."""
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("scope"), key.alias("key"), (F.floor(F.col("l_discount") * 100) - F.col("l_orderkey") % 7).cast("double").alias("value"))
    return rows.groupBy("scope", "key").agg(F.max("value").alias("value"))


SETTINGS = f"with settings as (select l_suppkey as scope, [{', '.join(repr(k) for k in KEYS)}][l_linenumber] as key, max(floor(l_discount * 100) - l_orderkey % 7)::double as value from lineitem group by all)"
SETTINGS_WIDE = SETTINGS + ", w as (select scope, " + ", ".join(f"max(case when key = '{k}' then value end) as {k}" for k in KEYS) + " from settings group by scope)"


@query(SETTINGS_WIDE + """, r as (select scope, unnest([{'s': 'reception', 'p': rec}, {'s': 'first', 'p': coalesce(rush, bonus_a)}, {'s': 'bonus', 'p': case when bonus_b is null or abs(bonus_a) >= abs(bonus_b) then bonus_a else bonus_b end},
  {'s': 'long', 'p': coalesce(fgm, 0) + coalesce(fgm_50, 0)}, {'s': 'miss', 'p': round(coalesce(miss_30, 0) * 0.4 + coalesce(rush, 0), 4)}]) as x from w)
select scope, x.s as stat, round(x.p, 8) as points from r where x.p <> 0""")
def rules_from_settings(spark, sf):
    return rounded(score.rules_from_settings(settings(spark, sf), {"rec": "reception"}, {"first": ["rush", "bonus_a"]}, {"bonus": ["bonus_a", "bonus_b"]}, ("fgm", {"long": ["fgm_50"]}), ("miss", "rush", {"miss_30": 0.4})))


@query(SETTINGS + "select scope, key, value from settings where value <> 0 and key not in ('rec', 'rush', 'fgm', 'fgm_50')")
def unscored_settings(spark, sf):
    return score.unscored(settings(spark, sf), ["rec", "rush", "fgm", "fgm_50"])


_ROUND = "select pos, id, round(points, 8) as points, round(sd_pts, 8) as sd_pts, round(floor, 8) as floor, round(ceiling, 8) as ceiling, sources from "


@query(LINES + AVERAGE + _ROUND + "summary")
def consensus_average(spark, sf):
    return rounded(consensus.average(scored(spark, sf)))


ROBUST = """, n as (select *, row_number() over (partition by pos, id order by points, data_src) as k from scored),
pairs as (select a.pos, a.id, (a.points + b.points) / 2 as m from n a join n b on a.pos = b.pos and a.id = b.id and a.k <= b.k),
hl as (select pos, id, median(m) as h from pairs group by all), med as (select pos, id, median(points) as m from scored group by all),
dev as (select pos, id, 1.4826 * median(abs(points - m)) as d from scored join med using (pos, id) group by all),
robust as (select pos, id, case when sources <= 2 then points else h end as points, case when sources > 1 then d end as sd_pts, floor, ceiling, sources from summary join hl using (pos, id) join dev using (pos, id))
"""


@query(LINES + AVERAGE + ROBUST + _ROUND + "robust")
def consensus_robust(spark, sf):
    return rounded(consensus.robust(scored(spark, sf)))


_W = ", ".join(f"('{k}', {v}::double)" for k, v in WEIGHTS.items())


@query(LINES + SCORED + f""", v as (select * from (values {_W}) t(data_src, w)), s as (select * from scored join v using (data_src)),
c as (select pos, id, sum(case when w > 0 then points * w end) / sum(case when w > 0 then w end) as c, sum(case when w > 0 then w end) as s1, sum(case when w > 0 then w * w end) as s2, count(case when w > 0 then 1 end) as n, count(*) as sources from s group by all)
select pos, id, round(any_value(c), 8) as points, round(case when any_value(n) > 1 then sqrt(any_value(s1) / nullif(any_value(s1) * any_value(s1) - any_value(s2), 0) * sum(case when w > 0 then w * (points - c) * (points - c) end)) end, 8) as sd_pts, any_value(c.sources) as sources
from s join c using (pos, id) group by pos, id""")
def consensus_weighted(spark, sf):
    return rounded(consensus.weighted(scored(spark, sf), weights(spark), quantiles=False))


# Harrell-Davis quantiles: the regularised incomplete beta function by its power series
WEIGHTED = f""", v as (select * from (values {_W}) t(data_src, w)), s as (select * from scored join v using (data_src)),
c as (select pos, id, sum(case when w > 0 then points * w end) / sum(case when w > 0 then w end) as c, sum(case when w > 0 then w end) as s1, sum(case when w > 0 then w * w end) as s2, count(case when w > 0 then 1 end) as n, count(*) as sources from s group by all),
wsd as (select pos, id, any_value(c) as points, case when any_value(n) > 1 then sqrt(any_value(s1) / nullif(any_value(s1) * any_value(s1) - any_value(s2), 0) * sum(case when w > 0 then w * (points - c) * (points - c) end)) end as sd_pts, any_value(c.sources) as sources
  from s join c using (pos, id) group by pos, id),
hdw as (select pos, id, points as x, case when row_number() over (partition by pos, id order by points, w, data_src) = count(*) over p then 1 else sum(w) over (partition by pos, id order by points, w, data_src rows unbounded preceding) / sum(w) over p end as hi, sum(w) over p * sum(w) over p / sum(w * w) over p as n, count(*) over p as k
  from s where w > 0 window p as (partition by pos, id)),
hdp as (select *, (n + 1) * p as a0, (n + 1) * (1 - p) as b0, least(hi, 1.0::double) as x1 from hdw, (values (0.05::double), (0.95::double)) q(p)),
hds as (select *, x1 > (a0 + 1) / (a0 + b0 + 2) as swap from hdp),
hda as (select *, case when swap then 1 - x1 else x1 end as t, case when swap then b0 else a0 end as a, case when swap then a0 else b0 end as b from hds),
hdf as (select *, case when t > 0 and t < 1 then list_sum([exp((a + i) * ln(t) + b * ln(1 - t) + lgamma(a + b + i) - lgamma(b) - lgamma(a + 1 + i)) for i in range(0, 200)]) end as f from hda),
hdc as (select *, case when x1 <= 0 then 0 when x1 >= 1 then 1 when swap then 1 - f else f end as cdf from hdf),
hdq as (select pos, id, p, case when any_value(k) > 1 then sum(x * (cdf - prev)) end as q from (select *, coalesce(lag(cdf) over (partition by pos, id, p order by hi), 0) as prev from hdc) group by all),
weighted as (select w.pos, w.id, points, sd_pts, a.q as floor, b.q as ceiling, sources from wsd w left join hdq a on w.pos = a.pos and w.id = a.id and a.p < 0.5 left join hdq b on w.pos = b.pos and w.id = b.id and b.p > 0.5)
"""


@query(LINES + AVERAGE + WEIGHTED + "select pos, id, round(floor, 7) as floor, round(ceiling, 7) as ceiling from weighted")
def weighted_quantiles(spark, sf):
    return consensus.weighted(scored(spark, sf), weights(spark)).select("pos", "id", F.round("floor", 7).alias("floor"), F.round("ceiling", 7).alias("ceiling"))


SOLO = AVERAGE + """,
typical as (select pos, median(case when sources > 1 then sd_pts end) as t from summary group by pos),
solo as (select pos, id, points, case when b then t else sd_pts end as sd_pts, case when b then greatest(0, points - 1.645 * t) else floor end as floor, case when b then points + 1.645 * t else ceiling end as ceiling, sources
  from (select *, sources = 1 and sd_pts is null and t is not null as b from summary join typical using (pos)))
"""


@query(LINES + SOLO + _ROUND + "solo")
def solo_spread(spark, sf):
    return rounded(consensus.borrow_spread(consensus.average(scored(spark, sf))))


METHODS = AVERAGE + ROBUST + WEIGHTED + """,
methods as (select 'average' as avg_type, * from summary union all select 'robust', * from robust union all select 'weighted', * from weighted),
typicals as (select avg_type, pos, median(case when sources > 1 then sd_pts end) as t from methods group by all),
spread as (select avg_type, pos, id, points, case when b then t else sd_pts end as sd_pts, case when b then greatest(0, points - 1.645 * t) else floor end as floor, case when b then points + 1.645 * t else ceiling end as ceiling, sources
  from (select *, sources = 1 and sd_pts is null and t is not null as b from methods join typicals using (avg_type, pos))),
grid as (select avg_type, pos, id, round(points, 8) as points, round(sd_pts, 8) as sd_pts, round(floor, 7) as floor, round(ceiling, 7) as ceiling, sources from spread where round(points, 8) > 0)
"""
RANKED = METHODS + """,
ranked as (select *, dense_rank() over (partition by avg_type, pos order by points desc) as pos_rank, dense_rank() over (partition by avg_type, pos order by floor desc nulls last) as fr, dense_rank() over (partition by avg_type, pos order by ceiling desc nulls last) as cr,
  lead(points, 1) over (partition by avg_type, pos order by points desc, id) as n1, lead(points, 2) over (partition by avg_type, pos order by points desc, id) as n2, max(points) over (partition by avg_type, pos) as best from grid),
steps as (select avg_type, pos, median(sd_pts) as step from grid group by all),
fallen as (select *, case when step > 0 then trunc((best - points) / step)::bigint else 0 end as fallen from ranked join steps using (avg_type, pos))
"""


def over(baseline: str, name: str = "board") -> str:
    """The board over baselines: an expression of the columns of `fallen`, and of k and baselines where joined."""
    return f""",
{name}_base as (select avg_type, pos, coalesce(max(case when pos_rank > {baseline} then points end), min(points)) as pb, coalesce(max(case when floor is not null and fr > {baseline} then floor end), min(floor)) as fb, coalesce(max(case when ceiling is not null and cr > {baseline} then ceiling end), min(ceiling)) as cb from fallen left join {name}_lines using (pos) group by all),
{name} as (select avg_type, pos, id, points, sd_pts, floor, ceiling, sources, pos_rank, coalesce(points - (n1 + coalesce(n2, n1)) / 2, 0) as dropoff, dense_rank() over (partition by avg_type, pos order by fallen) as tier,
  round(points - pb, 8) as points_vor, round(floor - fb, 7) as floor_vor, round(ceiling - cb, 7) as ceiling_vor, dense_rank() over (partition by avg_type order by round(points - pb, 8) desc) as rank from fallen join {name}_base using (avg_type, pos))
"""


BOARD = RANKED + f", board_lines as (select distinct p_type as pos, {BASELINE} as baseline from part)" + over("baseline")
#: Rows of the weighted method, as the queries that read a published board see them.
ONE = BOARD + ", one as (select * from board where avg_type = 'weighted')"


def baselines(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("pos")).distinct().withColumn("baseline", F.lit(BASELINE))


def board(spark, sf):
    return boards.consensus_table(staged(scored(spark, sf), "scored"), weights(spark), baselines(spark, sf))


#: Boards that this session has published, by the files they were made from.
_PUBLISHED: dict[tuple, str] = {}


def published_board(spark, sf):
    """The weighted board, built and published once in a session for the tables as they are; the queries on it only read it."""
    key = (spark.sparkContext.applicationId, sf, publish.stamps(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "part", "supplier")]))
    if key not in _PUBLISHED:
        path = f"{shared_dir(spark)}/{RUN}/published-{len(_PUBLISHED)}"
        publish.publish({"board": consensus.one_method(board(spark, sf))}, path, order={"board": ["rank"]})
        _PUBLISHED[key] = path
    return publish.published(spark, _PUBLISHED[key], "board")


_BOUNDS = "floor, ceiling"


@query(LINES + METHODS + f"select avg_type, pos, id, points, sd_pts, {_BOUNDS}, sources from grid")
def consensus_methods(spark, sf):
    out = consensus.consensus(staged(scored(spark, sf), "scored"), weights(spark))
    out = out.withColumns({"points": F.round("points", 8), "sd_pts": F.round("sd_pts", 8), "floor": F.round("floor", 7), "ceiling": F.round("ceiling", 7)})
    return out.filter("points > 0").select("avg_type", "pos", "id", "points", "sd_pts", "floor", "ceiling", "sources")


@query(LINES + METHODS + "select pos, id, points, sources from grid where avg_type = 'weighted'")
def chosen_method(spark, sf):
    out = consensus.one_method(consensus.consensus(staged(scored(spark, sf), "scored"), weights(spark)))
    return rounded(out.select("pos", "id", "points", "sources"))


@query(LINES + BOARD + "select avg_type, pos, id, pos_rank, tier, round(dropoff, 6) as dropoff from board")
def rank_tier_dropoff(spark, sf):
    rows = consensus.consensus(staged(scored(spark, sf), "scored"), weights(spark))
    rows = boards.on_grid(rows)
    return rank.rank_and_tier(rows, {}).select("avg_type", "pos", "id", "pos_rank", "tier", F.round("dropoff", 6).alias("dropoff"))


@query(LINES + BOARD + "select avg_type, pos, id, points_vor, floor_vor, ceiling_vor, rank from board")
def value_over_replacement(spark, sf):
    return board(spark, sf).select("avg_type", "pos", "id", "points_vor", "floor_vor", "ceiling_vor", "rank")


@query(LINES + METHODS + """, e as (select avg_type, pos, id, sd_pts as s, case when id % 4 <> 0 then (id % 11) * 1.0 end as e from grid),
z as (select *, (s - avg(s) over w) / nullif(stddev_samp(s) over w, 0) as a, (e - avg(e) over w) / nullif(stddev_samp(e) over w, 0) as b from e window w as (partition by pos)),
m as (select avg_type, pos, id, coalesce((a + b) / 2, a, b) as m from z), y as (select avg_type, pos, id, round((m - avg(m) over w) / nullif(stddev_samp(m) over w, 0), 10) as y from m window w as (partition by pos)),
p as (select *, percent_rank() over (partition by pos, y is null order by y) as p, count(*) over (partition by pos, y is null) as n from y)
select avg_type, pos, id, case when y is not null and n > 1 then least(99, greatest(1, round_even(p * 100, 0)))::int end as uncertainty from p""")
def uncertainty(spark, sf):
    rows = consensus.consensus(staged(scored(spark, sf), "scored"), weights(spark))
    rows = staged(rows.withColumns({"sd_pts": F.round("sd_pts", 8), "points": F.round("points", 8)}).filter("points > 0").withColumn("sd_ecr", F.when(F.col("id") % 4 != 0, (F.col("id") % 11).cast("double"))))
    return rank.uncertainty(rows).select("avg_type", "pos", "id", "uncertainty")


@query(LINES + "select id, round(avg(site_pts), 1) as site_pts, round(stddev_samp(site_pts), 2) as site_pts_sd, count(site_pts) as sources from lines group by id")
def draft_value(spark, sf):
    return consensus.source_values(lines(spark, sf), "site_pts")


def slots(spark, sf):
    g = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]
    return [(x, [x]) for x in g[:3]] + [("flex", g[:3]), ("super", g[1:5])]


SLOTTED = """, t as (select p_type as pos, row_number() over (order by p_type) as k from (select distinct p_type from part)),
n0 as (select pos, id, points, k, row_number() over (partition by pos order by points desc, id) as n from one join t using (pos) where k <= 5),
n1 as (select *, k <= 3 and n <= 6 as starter from n0),
flex as (select id from n1 where k <= 3 and not starter order by points desc, k, id limit 6),
n2 as (select * replace (starter or id in (select id from flex) as starter) from n1),
super as (select id from n2 where k between 2 and 5 and not starter order by points desc, k, id limit 6),
n3 as (select * replace (starter or id in (select id from super) as starter) from n2),
slotted as (select pos, count(*)::int as baseline from n3 where starter group by pos)
"""


@query(LINES + ONE + SLOTTED + "select pos, baseline from slotted")
def replacement_ranks(spark, sf):
    return scope.replacement_ranks(published_board(spark, sf), slots(spark, sf), TEAMS)


@query(LINES + ONE + SLOTTED + ", final_lines as (select pos, baseline from slotted)" + over("coalesce(baseline, 1)", "final") + """
select avg_type, rank, pos, id, points, points_vor, floor_vor, tier from final""")
def board_two_phase(spark, sf):
    out = boards.build_board(staged(scored(spark, sf), "scored"), weights(spark), slots(spark, sf), TEAMS)
    return out.select("avg_type", "rank", "pos", "id", "points", "points_vor", "floor_vor", "tier")


PICKS = """picks as (select cast(json_extract_string(props, '$.k') as bigint) as entity, user_id as manager, event_id as pick, ts from events where event_type = 'purchase'),
held as (select entity, arg_max(manager, (ts, pick)) as manager, max(pick) as pick from picks group by entity)"""


def picks(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'purchase'")
    return rows.select(F.get_json_object("props", "$.k").cast("long").alias("entity"), F.col("user_id").alias("manager"), F.col("event_id").alias("pick"), "ts")


@query(LINES + ONE + "," + PICKS + "select pos, arg_max(id, (points_vor, -id)) as id, max(points_vor) as points_vor from one where id not in (select entity from held) group by pos")
def available_best(spark, sf):
    return scope.best_by_group(scope.available(published_board(spark, sf), scope.latest_holder(picks(spark, sf))), "points_vor")


@query(LINES + ONE + ", o as (select pos, id, points_vor as v, row_number() over (order by points_vor desc, id) as n from one) select pos, round(max(v), 8) as now, round(max(case when n > 40 then v end), 8) as later, round(max(v) - max(case when n > 40 then v end), 8) as cost from o group by pos")
def waiting_cost(spark, sf):
    return rounded(scope.waiting_cost(published_board(spark, sf), "points_vor", 40))


@query(f"select event_id as pick, case when ((event_id - 1) // {TEAMS}) % 2 = 1 then {TEAMS} - (event_id - 1) % {TEAMS} else (event_id - 1) % {TEAMS} + 1 end::bigint as slot, ((event_id - 1) // {TEAMS} + 1) || '.' || lpad(((event_id - 1) % {TEAMS} + 1)::varchar, 2, '0') as label from events where event_id > 0")
def snake_slots(spark, sf):
    pick = F.col("event_id")
    return table(spark, sf, "events").filter("event_id > 0").select(pick.alias("pick"), scope.slot_of(pick, TEAMS).cast("long").alias("slot"), scope.pick_label(pick, TEAMS).alias("label"))


@query(LINES + ONE + "," + PICKS + """, t as (select p_type as pos, row_number() over (order by p_type) as k from (select distinct p_type from part)),
mine as (select manager as team, k, points, row_number() over (partition by manager order by pick, pos, points) as n from held join one on entity = id join t using (pos)),
teams as (select distinct user_id as team from events),
fill as (select team, 0::bigint as n, [true, true, true, true, true] as open, 0.0::double as points, 0 as filled from teams
  union all select team, n, list_transform(open, lambda o, i: o and i <> spot), points + case when spot > 0 then gain else 0 end, filled + case when spot > 0 then 1 else 0 end
  from (select f.team, m.n, f.open, f.points, m.points as gain, f.filled,
    case when k <= 3 and f.open[k] then k when k <= 3 and f.open[4] then 4 when k between 2 and 5 and f.open[5] then 5 else 0 end as spot from fill f join mine m on m.team = f.team and m.n = f.n + 1)),
last as (select team, arg_max(points, n) as points, arg_max(filled, n) as filled, max(n)::int as picks from fill group by team)
select team, round(points, 8) as points, filled, picks, (rank() over (order by round(points, 8) desc))::int as place from last""")
def team_standings(spark, sf):
    parts = published_board(spark, sf).select(F.col("id").alias("entity"), "pos", "points")
    mine = scope.latest_holder(picks(spark, sf)).join(parts, "entity").select(F.col("manager").alias("team"), "pick", "pos", "points")
    teams = table(spark, sf, "events").select(F.col("user_id").alias("team")).distinct()
    return rounded(scope.ranked_standings(teams, mine, slots(spark, sf)))


SQL["team_standings"] = SQL["team_standings"].replace("with firsts", "with recursive firsts")


@query("""with r as (select c_custkey as ref_id, c_name as name, c_mktsegment as pos, 't' || c_nationkey as team from customer),
v as (select ref_id as row_id, case ref_id % 4 when 0 then upper(name) || ' Jr.' when 1 then replace(name, '#', ' ') else name end as name, case when ref_id % 5 = 0 then 'OTHER' else pos end as pos, team from r),
n as (select 'r' as side, ref_id as i, * exclude (ref_id) from r union all select 'v', row_id, * exclude (row_id) from v),
k as (select side, i, regexp_replace(regexp_replace(lower(upper(trim(name))), '\\s+(defense|jr|sr|[iv]+)\\.?$', ''), '[[:punct:]\\s]', '', 'g') as name, lower(pos) as pos, regexp_replace(regexp_replace(lower(team), '\\s+(defense|jr|sr|[iv]+)\\.?$', ''), '[[:punct:]\\s]', '', 'g') as team,
  regexp_replace(lower(regexp_extract(name, '^(\\S*)', 1)), '[[:punct:]\\s]', '', 'g') as first,
  case when instr(name, ' ') > 0 then regexp_replace(regexp_replace(lower(regexp_replace(name, '^\\S*\\s+', '')), '\\s+(defense|jr|sr|[iv]+)\\.?$', ''), '[[:punct:]\\s]', '', 'g') else '' end as last from n),
p as (select side, i, unnest([{'n': 0, 'k': name || '|' || pos || '|' || team}, {'n': 1, 'k': last || '|' || pos || '|' || team}, {'n': 2, 'k': name || '|' || team}, {'n': 3, 'k': name || '|' || pos}, {'n': 4, 'k': first || '|' || pos || '|' || team}]) as x from k),
one as (select x, min(i) as ref_id from p where side = 'r' group by x having count(*) = 1),
hit as (select p.i as row_id, arg_min(one.ref_id, p.x.n) as ref_id from p join one on p.x = one.x where side = 'v' group by p.i)
select v.row_id, hit.ref_id from v left join hit using (row_id)""")
def resolve_ids(spark, sf):
    ref = table(spark, sf, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("pos"), F.concat(F.lit("t"), "c_nationkey").alias("team"))
    name = F.when(F.col("ref_id") % 4 == 0, F.concat(F.upper("name"), F.lit(" Jr."))).when(F.col("ref_id") % 4 == 1, F.translate("name", "#", " ")).otherwise(F.col("name"))
    rows = ref.select(F.col("ref_id").alias("row_id"), name.alias("name"), F.when(F.col("ref_id") % 5 == 0, "OTHER").otherwise(F.col("pos")).alias("pos"), "team")
    return identity.resolve(rows, ref).select("row_id", "ref_id")


@query("select c_custkey, case when c_custkey % 9 = 0 then null else round(c_acctbal, 2) end as bal, case when c_custkey % 9 = 0 then null when c_custkey % 2 = 0 then 'x' else '1' end as mixed from customer")
def clean_numeric(spark, sf):
    text = F.when(F.col("c_custkey") % 9 == 0, "--").otherwise(F.format_number("c_acctbal", 2))
    mixed = F.when(F.col("c_custkey") % 9 == 0, " N/A ").otherwise(F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("1"))
    return clean.numeric_columns(table(spark, sf, "customer").select("c_custkey", text.alias("bal"), mixed.alias("mixed")))


@query("select l_orderkey, l_linenumber, l_quantity as a, case when l_linenumber % 3 <> 0 then l_linenumber::double end as b from lineitem")
def split_ratio(spark, sf):
    text = F.when(F.col("l_linenumber") % 3 != 0, F.concat_ws("/", "l_quantity", "l_linenumber")).otherwise(F.col("l_quantity").cast("string"))
    a, b = clean.split_pair(F.col("text"))
    return table(spark, sf, "lineitem").withColumn("text", text).select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'urgent' when '5-LOW' then 'low' else o_orderpriority end as priority, case when o_orderkey < 1000 then lpad(o_orderkey::varchar, 4, '0') else o_orderkey::varchar end as padded from orders")
def recode(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.recode(F.col("o_orderpriority"), {"1-URGENT": "urgent", "5-LOW": "low"}).alias("priority"), clean.pad_id(F.col("o_orderkey")).alias("padded"))


LINK = 'href="(/[^"]+)"'


@query(f"""with l as (select page_id, regexp_extract_all(html, '{LINK}', 1) as l from pages), u as (select page_id, unnest(l) as link, unnest(range(len(l))) as n from l), f as (select page_id, link, min(n) as n from u group by all)
select page_id, (row_number() over (partition by page_id order by n) - 1)::int as place, link from f""")
def page_links(spark, sf):
    return readers.links(table(spark, sf, "pages"), LINK)


@query(r"select page_id, try_cast(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') as bigint) as value from pages")
def page_script_values(spark, sf):
    return readers.script_value(table(spark, sf, "pages"), r"track\((\d+)\)", "bigint")


def order_pages(spark, sf):
    """A page per order with a table of its line items: a header row, one cell that spans two columns, and a short row."""
    row = F.concat(F.lit("<tr><td>"), "l_linenumber", F.lit("<td colspan=2> "), F.col("l_quantity").cast("int"), F.lit("  pcs</td><td><b>"), "l_returnflag", F.lit("</b></tr>"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", row.alias("row")).alias("r")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r"))
    html = F.concat(F.lit("<p>x<table><tr><th>line<th>n<th>unit<th>flag</tr>"), F.array_join(F.transform("r", lambda x: x["row"]), ""), F.lit("<TR><TD>end</TD></TR></table>"))
    return rows.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


ORDER_PAGES = """with r as (select l_orderkey as page_id, 0 as table_no, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity::int || '  pcs' || l_returnflag)::int as row_no, [l_linenumber::varchar, l_quantity::int || ' pcs', l_quantity::int || ' pcs', l_returnflag] as cells, false as heads from lineitem),
p as (select page_id, table_no, row_no, cells, heads from r union all select distinct page_id, 0, 0, ['line', 'n', 'unit', 'flag'], true from r union all select page_id, 0, max(row_no) + 1, ['end', '', '', ''], false from r group by page_id)
"""


@query(ORDER_PAGES + "select page_id, table_no, row_no, array_to_string(cells, '|') as cells, heads from p")
def page_tables(spark, sf):
    return readers.tables(order_pages(spark, sf)).withColumn("cells", F.array_join("cells", "|"))


@query(ORDER_PAGES + "select page_id, row_no, unnest(range(1, 5))::int as place, unnest(['line', 'n', 'unit', 'flag']) as header, unnest(cells) as value from p where row_no > 0")
def page_table_cells(spark, sf):
    return payloads.headed(readers.tables(order_pages(spark, sf)), ["page_id"])


@query("select event_id, cast(json_extract_string(props, '$.k') as double) as k from events")
def json_props(spark, sf):
    return readers.code_map(table(spark, sf, "events"), "props", {"k": "k"}).select("event_id", "k")


@query("with " + PICKS + "select entity, manager, pick from held")
def latest_holder(spark, sf):
    return scope.latest_holder(picks(spark, sf))


@query("with " + PICKS + ", mid as (select max(event_id) // 50 as m from events) select distinct entity from picks where pick > (select m from mid) and entity not in (select entity from picks where pick <= (select m from mid))")
def new_since(spark, sf):
    rows, mid = picks(spark, sf), table(spark, sf, "events").agg(F.floor(F.max("event_id") / 50).alias("m"))
    marked = rows.join(mid)  # one row on the right
    return marked.groupBy("entity").agg(F.min(F.col("pick") > F.col("m")).alias("new")).filter("new").select("entity")


@query(LINES + ONE + "," + PICKS + "select pos, one.id, points_vor, manager from one left join held on held.entity = one.id")
def live_board(spark, sf):
    return live.overlay(published_board(spark, sf), scope.latest_holder(picks(spark, sf))).select("pos", "id", "points_vor", "manager")


def _streamed(spark, sf) -> tuple:
    """Pick events of the table as a stream, and a new folder for its state."""
    where = f"{shared_dir(spark)}/{RUN}/stream-{uuid.uuid4().hex}"
    return live.read_picks(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema), where


@query("with " + PICKS + ", l as (select entity, max((ts, pick)) as last from picks group by entity) select held.entity, manager, (last)[2] as pick, true as new from held join l using (entity)")
def streamed_holders(spark, sf):
    """The holders' table that a stream keeps by keyed state, and the change feed of its first batch."""
    rows, where = _streamed(spark, sf)
    state = live.Holders(spark, f"{where}/state")
    state.start(rows, f"{where}/checkpoint").awaitTermination()
    new = state.new().select("entity", F.lit(True).alias("new"))
    return state.table().join(new, "entity", "left").select("entity", "manager", "pick", F.coalesce("new", F.lit(False)).alias("new"))


@query(SQL["live_board"])
def streamed_board(spark, sf):
    """live_board kept by a running query: first beside half of the board, then the whole board is published."""
    rows, where = _streamed(spark, sf)
    board = published_board(spark, sf)
    publish.publish({"board": board.filter("id % 2 = 0")}, f"{where}/published")
    state = live.LiveBoard(spark, where, f"{where}/published")
    state.start(rows, f"{where}/checkpoint").awaitTermination()
    publish.publish({"board": board}, f"{where}/published")
    state.update(spark.createDataFrame([], live.CHANGES), state.says()["batch"] + 1)
    return state.table().select("pos", "id", "points_vor", "manager")


@query(LINES + ONE + "select pos, id, points_vor from one order by 3 desc, id limit 25")
def top_n(spark, sf):
    return published_board(spark, sf).select("pos", "id", "points_vor").orderBy(F.col("points_vor").desc(), "id").limit(25)


@query(LINES + "select id, pos, data_src, qty from lines order by qty desc nulls last, id, data_src limit 100")
def null_last_sort(spark, sf):
    return lines(spark, sf).select("id", "pos", "data_src", "qty").orderBy(F.col("qty").desc_nulls_last(), "id", "data_src").limit(100)


@query(LINES + "select id, pos, data_src, qty from lines")
def null_last_sort_down(spark, sf):
    """All rows, without the limit of null_last_sort."""
    return lines(spark, sf).select("id", "pos", "data_src", "qty").orderBy(F.col("qty").desc_nulls_last(), "id", "data_src")


@query(LINES + "select id, pos, data_src, qty from lines")
def null_last_sort_up(spark, sf):
    return lines(spark, sf).select("id", "pos", "data_src", "qty").orderBy(F.col("qty").asc_nulls_last(), "id", "data_src")


@query(LINES + "select id, data_src, unnest(['qty', 'yds', 'disc']) as stat, unnest([qty, yds, disc]) as value from lines qualify value is not null")
def entity_drilldown(spark, sf):
    return publish.drill_down(lines(spark, sf), ["qty", "yds", "disc"])


SQL["entity_drilldown"] = LINES + "select * from (select id, data_src, unnest(['qty', 'yds', 'disc']) as stat, unnest([qty, yds, disc]) as value from lines) where value is not null"


@query(LINES + BOARD + f"select avg_type, pos, id, points, sd_pts, {_BOUNDS}, sources, pos_rank, tier, round(dropoff, 6) as dropoff, points_vor, rank from board")
def consensus_board(spark, sf):
    out = board(spark, sf).withColumn("dropoff", F.round("dropoff", 6))
    return out.select("avg_type", "pos", "id", "points", "sd_pts", "floor", "ceiling", "sources", "pos_rank", "tier", "dropoff", "points_vor", "rank")
