"""Registered queries of cleaning, filters, set operations and orders, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accordant.operators import clean, scope
from accordant.sources import payloads, publish, readers
from accordant.sources.stage import RUN, shared_dir

from .queries import COVERED, LINES, lines, query, rounded, table

#: (source, group or null, header, metric)
HEADERS = [
    ("1-URGENT", None, "qty", "amount"), ("1-URGENT", "ECONOMY", "qty", "economy_amount"), ("2-HIGH", None, "yds", "price"), ("2-HIGH", "PROMO", "disc", "promo_rebate"), ("5-LOW", "SMALL", "yds", "small_price"),
]
_MAP = ", ".join("({})".format(", ".join("null" if v is None else f"'{v}'" for v in r)) for r in HEADERS)


@query(LINES + f""", m as (select * from (values {_MAP}) t(data_src, variant, header, metric)),
long as (select id, pos, data_src, unnest(['qty', 'yds', 'disc']) as header, unnest([qty, yds, disc]) as value from lines)
select id, pos, long.data_src, coalesce(o.metric, b.metric, long.header) as metric, value from long
left join m o on o.data_src = long.data_src and o.variant = pos and o.header = long.header left join m b on b.data_src = long.data_src and b.variant is null and b.header = long.header where value is not null""")
def mapped_headers(spark, sf):
    long = lines(spark, sf).unpivot(["id", "pos", "data_src"], ["qty", "yds", "disc"], "header", "value").filter("value is not null")
    mapping = spark.createDataFrame(HEADERS, "data_src string, variant string, header string, metric string")
    return clean.mapped_metrics(long.withColumn("variant", F.col("pos")), mapping, ["id", "pos"])


@query("select c_custkey, nullif(trim(translate(c_name, ',%@-#', '')), '') as name, nullif(trim(translate(c_name, 'Custome#r', '')), '') as digits from customer")
def stripped_cells(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.strip_characters(F.col("c_name"), ",%@-#").alias("name"), clean.strip_characters(F.col("c_name"), "Custome#r").alias("digits"))


@query("select c_custkey, nullif(regexp_extract(c_name, '#0*([1-9]\\d*)$', 1), '') as number, trim(coalesce(split_part(c_name, '#', 1), '') || ' ' || case when c_custkey % 3 <> 0 then c_mktsegment else '' end) as player from customer")
def captured_names(spark, sf):
    rows = table(spark, sf, "customer").withColumns({"first": F.split_part("c_name", F.lit("#"), F.lit(1)), "last": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))})
    return rows.select("c_custkey", clean.extract(F.col("c_name"), r"#0*([1-9]\d*)$").alias("number"), clean.display_name("first", "last").alias("player"))


@query(LINES + """, m as (select * replace (case pos when 'SMALL' then 'SIZED' when 'MEDIUM' then 'SIZED' when 'LARGE' then 'SIZED' else pos end as pos) from lines)
select pos, data_src, arg_min(id, (l_orderkey, l_linenumber, id)) as id, min(l_orderkey) as l_orderkey from m group by all""")
def merged_groups(spark, sf):
    rows = lines(spark, sf).select("pos", "data_src", "id", "l_orderkey", "l_linenumber")
    out = clean.merged_groups(rows, dict.fromkeys(("SMALL", "MEDIUM", "LARGE"), "SIZED"), ["pos", "data_src"], ["l_orderkey", "l_linenumber"])
    return out.select("pos", "data_src", "id", "l_orderkey")


@query(LINES + "select pos, id, data_src, round(qty, 1) as qty, round(yds, 1) as yds, round(disc, 1) as disc, round(tax, 1) as tax, l_orderkey from lines")
def display_lines(spark, sf):
    rows = lines(spark, sf).select("l_orderkey", "qty", "yds", "disc", "tax", "id", "data_src", "pos")
    return clean.display_rounded(clean.preferred_first(rows, ["pos", "id", "data_src"]))


@query("select c_custkey, c_mktsegment as pos, case when c_mktsegment not in ('MACHINERY', 'FURNITURE') then c_nationkey end as nation, c_acctbal from customer where (c_acctbal > 0 and c_custkey % 13 <> 0) or c_mktsegment = 'BUILDING'")
def positive_points(spark, sf):
    rows = table(spark, sf, "customer").withColumns({"pos": F.col("c_mktsegment"), "points": F.when(F.col("c_custkey") % 13 == 0, float("nan")).otherwise(F.col("c_acctbal")), "nation": F.col("c_nationkey")})
    return clean.null_for_groups(clean.positive_points(rows, "points", ("BUILDING",)), "nation", ["MACHINERY", "FURNITURE"]).select("c_custkey", "pos", "nation", "c_acctbal")


@query("select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as bal, avg(case when c_custkey % 7 <> 0 then c_acctbal end) over (partition by c_nationkey) is not null as known from customer")
def nan_to_null(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("bal"))
    rows = clean.nan_to_null(rows)
    return rows.select("c_custkey", "bal", (F.avg("bal").over(Window.partitionBy("c_nationkey")).isNotNull()).alias("known"))


_SIDES = "case when l_linenumber % 3 <> 0 then l_quantity end as a, case when l_linenumber % 4 <> 0 then l_tax * 100 end as b"


@query(f"""with x as (select l_orderkey, l_linenumber, l_extendedprice as total, {_SIDES} from lineitem),
y as (select *, case when coalesce(a, 0) + coalesce(b, 0) = 0 then 0 else coalesce(a, 0) / (coalesce(a, 0) + coalesce(b, 0)) end as share from x)
select l_orderkey, l_linenumber, round(case when coalesce(a, b) is not null then total * share end / total, 10) as one, round(case when coalesce(a, b) is not null then total * (1 - share) end / total, 10) as two, round(total * 200 / (1000.0 / 12), 4) as budget from y""")
def split_totals(spark, sf):
    n, items = F.col("l_linenumber"), table(spark, sf, "lineitem")
    rows = items.select("l_orderkey", n, F.col("l_extendedprice").alias("total"), F.when(n % 3 != 0, F.col("l_quantity")).alias("a"), F.when(n % 4 != 0, F.col("l_tax") * 100).alias("b"), clean.to_budget("l_extendedprice", 12).alias("budget"))
    out = clean.split_or_rename(rows, "total", {"a": "one", "b": "two"})
    whole = F.col("budget") / 200 * (1000 / 12)
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col(c) / whole, 10).alias(c) for c in ("one", "two")], F.round("budget", 4).alias("budget"))


@query("select l_orderkey, l_linenumber, l_extendedprice as one, l_quantity as a from lineitem")
def renamed_total(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("a"))
    return clean.split_or_rename(rows, "total", {"a": "one", "b": "two"})


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where not (regexp_matches(o_orderstatus, '^[FO]$') and regexp_matches(o_orderpriority, '^[1-3]'))")
def without_footers(spark, sf):
    rows = table(spark, sf, "orders").withColumn("cells", F.array("o_orderstatus", F.split_part("o_orderpriority", F.lit("-"), F.lit(1))))
    return clean.matching_columns(clean.drop_footers(rows, "cells", "^([FO]|[1-3])$"), "^o_order(key|status|priority)$")


@query("select o_orderkey, o_orderpriority, 7 as same_number from orders")
def varying_columns(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit("x").alias("same_text"), F.lit(7).alias("same_number"), F.lit(None).cast("string").alias("none"))
    return clean.drop_constant_text(clean.drop_empty_columns(rows))


@query("select rec_a, a, b from (select l_orderkey as a, l_linenumber as b, l_quantity as rec_a from lineitem)")
def repeated_headers(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.toDF(*clean.numbered_headers(["a", "b", "a"], {"a": "rec_a"}))


@query("""with u as (select c_nationkey * 1000 + c_custkey % 1000 as k, c_name as name, 0 as n from customer union all select s_nationkey * 1000 + s_suppkey % 1000, s_name, 1 from supplier)
select k, arg_max(name, (n, name)) as name from u group by k""")
def keyed_union(spark, sf):
    one = table(spark, sf, "customer").select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 1000).alias("k"), F.col("c_name").alias("name"))
    two = table(spark, sf, "supplier").select((F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 1000).alias("k"), F.col("s_name").alias("name"))
    return clean.keyed_union([one, two], ["k"])


@query("select distinct user_id as manager, true as seen from events where event_type = 'purchase' union all select distinct user_id, false from events where user_id not in (select user_id from events where event_type = 'purchase')")
def members_unseen(spark, sf):
    events = table(spark, sf, "events")
    held = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("manager"), F.lit(True).alias("seen"))
    return clean.with_unseen(held, events.select(F.col("user_id").alias("manager"), F.lit(False).alias("seen")), ["manager"])


@query("select c_custkey as id, c_name as name, c_acctbal as bal, null::integer as nation from customer union all select s_suppkey, s_name, null, s_nationkey from supplier")
def stacked_frames(spark, sf):
    one = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    two = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return publish.stacked([one, two])


_CATALOGUE = ", ".join(f"('{k}', {n}, {k != '4-NOT SPECIFIED'}, {k != '5-LOW'})" for k, n in COVERED.items())


@query(LINES + f""", t as (select p_type as pos, row_number() over (order by p_type) as k from (select distinct p_type from part)), c as (select * from (values {_CATALOGUE}) v(data_src, top, draft, weekly))
select id, pos, data_src, qty, disc from lines join t using (pos) join c using (data_src) where draft and k <= top and coalesce(qty, disc) is not null""")
def stat_lines(spark, sf):
    """The lines of all sources as separate ragged frames, loaded as one table for the season-long period."""
    rows = lines(spark, sf).withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("id", "pos", "data_src", "qty", "disc", "seq")
    groups = table(spark, sf, "part").select("p_type").distinct().withColumn("k", F.expr("array_position(array('ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'), p_type)"))
    sources = spark.createDataFrame([(k, n, k != "4-NOT SPECIFIED", k != "5-LOW") for k, n in COVERED.items()], "data_src string, top int, draft boolean, weekly boolean")
    pairs = sources.join(groups, F.col("k") <= F.col("top")).groupBy("data_src", "draft", "weekly").agg(F.collect_list("p_type").alias("positions"))  # sources x groups, both few
    frames = [rows.filter(F.col("data_src") == s).drop(*(["disc"] if s == "none" else [])) for s in COVERED]
    return payloads.load_stat_lines(frames, ["qty", "disc"], pairs, True, "seq").select("id", "pos", "data_src", "qty", "disc")


@query("select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as nation, case when c_custkey % 5 <> 0 then c_mktsegment end as segment, 'one' as data_src from customer")
def landed_file(spark, sf):
    """Customers written as delimited text and read back: all text, NA and blanks null, the rank dropped, headers mapped."""
    path = f"{shared_dir(spark)}/{RUN}/landed-{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer").select(F.lit(1).alias("Rank"), "c_custkey", "c_name", F.col("c_nationkey").alias("N"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 2 == 0, "NA")).alias("S"))
    rows.write.csv(path, header=True)
    return payloads.stat_file(spark, path, "one", [("one", None, "N", "nation"), ("one", None, "S", "wrong"), ("one", "v", "S", "segment")], "v")


@query("select l_orderkey, l_linenumber, l_quantity as amount_value, l_tax as amount_parts_tax, l_discount as amount_parts_disc from lineitem")
def flattened_structs(spark, sf):
    parts = F.struct(F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"))
    return readers.flattened(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("value"), parts.alias("parts")).alias("amount")))


@query(LINES + "select id, pos, data_src, qty from lines")
def grouped_order(spark, sf):
    """All lines, groups in a given order, then the amount with gaps last."""
    rows = lines(spark, sf).select("id", "pos", "data_src", "qty")
    return scope.in_group_order(rows, ["STANDARD", "ECONOMY", "PROMO"], F.col("qty").desc_nulls_last(), F.col("id"), F.col("data_src"))


@query("select o_orderkey, year(o_orderdate) - case when month(o_orderdate) <= 3 then 1 else 0 end as season from orders")
def season_of_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scope.season_of(F.col("o_orderdate")).alias("season"))


@query("with p as (select o_custkey % 50 as source, (o_orderkey // 40)::int as page, o_orderkey, o_totalprice from orders), n as (select source, page, count(*) as n, min(o_totalprice) as low from p group by all), s as (select *, coalesce(max(case when n < 2 or low <= 20000 then 1 else 0 end) over (partition by source order by page rows between unbounded preceding and 1 preceding), 0) as done from n) select source, page, o_orderkey from p join s using (source, page) where done = 0")
def pages_until_stop(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("source"), F.floor(F.col("o_orderkey") / 40).cast("int").alias("page"), "o_orderkey", F.col("o_totalprice").alias("points"))
    return readers.until_short_page(rows, 2, 20000.0).select("source", "page", "o_orderkey")


@query("select o_custkey % 50 as source, (o_orderkey // 400)::int as page, o_orderkey, row_number() over (partition by o_custkey % 50 order by o_orderkey) as number from orders")
def numbered_pages(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("source"), F.floor(F.col("o_orderkey") / 400).cast("int").alias("page"), "o_orderkey")
    return payloads.numbered(rows, "o_orderkey").select("source", "page", "o_orderkey", "number")


@query("select o_orderkey, trim(regexp_replace(o_orderstatus || ' ' || o_orderpriority, '\\s+', ' ', 'g')) as first, o_orderstatus || ' b' as second, o_orderpriority as label from orders")
def joined_headers(spark, sf):
    rows = table(spark, sf, "orders").withColumns({"a": F.array("o_orderstatus", F.concat(F.lit(" "), "o_orderstatus")), "b": F.array("o_orderpriority", F.lit(" b ")), "cell": F.concat(F.lit("\n "), "o_orderpriority", F.lit(" \nhelp text"))})
    both = readers.joined_headers(F.col("a"), F.col("b"))
    return rows.select("o_orderkey", both[0].alias("first"), both[1].alias("second"), payloads.first_line(F.col("cell")).alias("label"))
