"""Operators of the core library on small tables, and the registered queries against their SQL."""

import datetime
import json
import math
import random
import statistics
import subprocess
import sys
import threading
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.functions import select, stats
from accordant.operators import board, clean, consensus, impute, rank, scope, score, settings
from accordant.plans import cleaning, people, queries, rules, scopes  # noqa: F401
from accordant.sources import payloads, publish, readers
from accordant.streaming import live

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(names, rows):
    keep = sorted(names)
    return sorted(repr(tuple(round(v, 7) if isinstance(v, float) else v for v in (dict(zip(names, r))[k] for k in keep))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    got = duck.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


def test_estimators(spark):
    draw = random.Random(1)
    lists = [[draw.gauss(0, 3) for _ in range(n)] for n in (1, 2, 3, 4, 5, 9)]
    got = spark.createDataFrame([(v,) for v in lists], "v array<double>").select("v", stats.hodges_lehmann(F.col("v")).alias("h"), stats.mad(F.col("v")).alias("m")).collect()
    for r in got:
        pairs = [(a + b) / 2 for i, a in enumerate(r.v) for b in r.v[i:]]
        assert math.isclose(r.h, sum(r.v) / len(r.v) if len(r.v) <= 2 else statistics.median(pairs))
        if len(r.v) > 1:
            mid = statistics.median(r.v)
            assert math.isclose(r.m, 1.4826 * statistics.median(abs(x - mid) for x in r.v))
        else:
            assert r.m is None


def test_beta_by_integration():
    for x, a, b in [(x, a, b) for x in (0.02, 0.3, 0.5, 0.9) for a, b in ((0.4, 5.2), (2.0, 3.0), (6.0, 0.7))]:
        # substitute t = u**(1/a): the integrand stays finite at 0
        n, top = 40_000, x**a
        total = sum((1 - ((k + 0.5) / n * top) ** (1 / a)) ** (b - 1) for k in range(n)) * top / n / a
        want = total * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        assert abs(stats.beta_cdf(np.array([x]), np.array([a]), np.array([b]))[0] - want) < 1e-6


def test_weighted_quantiles_of_few(spark):
    df = spark.createDataFrame([([1.0], [0.5]), ([3.0, 1.0], [0.5, 0.5]), ([], [])], "x array<double>, w array<double>")
    got = [r.b for r in df.select(stats.weighted_bounds("x", "w").alias("b")).collect()]
    assert got[0].floor is None and got[2].ceiling is None
    assert 1 < got[1].floor < 2 < got[1].ceiling < 3 and math.isclose(got[1].floor + got[1].ceiling, 4)


def test_fills_keep_known_values(spark):
    rows = [("a", 1, "s", 2.0, 4.0), ("a", 1, "t", None, 6.0), ("a", 2, "s", None, 3.0), ("a", 3, "s", 1.0, 0.0), ("a", 3, "t", None, 5.0), ("b", 4, "s", 0.0, None), ("b", 4, "t", None, 2.0)]
    df = spark.createDataFrame(rows, "pos string, id int, data_src string, v double, r double")
    got = {(x.id, x.data_src): x.v for x in impute.group_rate_fill(df, "v", "r").collect()}
    assert got == {(1, "s"): 2.0, (1, "t"): 3.0, (2, "s"): 3.0 * 3 / 4, (3, "s"): 1.0, (3, "t"): 1.0, (4, "s"): 0.0, (4, "t"): 0.0}


def test_brackets(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (5.0,), (6.0,), (99.0,), (None,)], "x double").select(score.bracket(F.col("x"), [(5.0, 10.0), (9.0, 3.0)])).collect()]
    assert got == [10.0, 10.0, 3.0, 3.0, None]


def test_season_bracket_does_not_depend_on_order(spark, sf):
    first = {r[0]: r[1] for r in queries.bracket_monte_carlo(spark, sf).collect()}
    df = spark.read.parquet(f"{sf}/lineitem.parquet").repartition(7).groupBy("l_suppkey").agg(F.count("*"))
    assert set(first) == {r[0] for r in df.collect()} and len(set(first.values())) > 3


def test_baselines_equal_sequential_filling(spark):
    draw = random.Random(6)
    for _ in range(4):
        slots = [("A", ["A"]), ("B", ["B"]), ("F", draw.sample(["A", "B", "C"], 2)), ("S", ["C", "A", "B"])]
        rows = [(g, k, float(draw.randrange(50))) for k, g in enumerate(draw.choices("ABCD", k=60))]
        used, want = set(), {}
        for _, groups in sorted(slots, key=lambda s: len(s[1]) > 1):
            free = sorted((r for r in rows if r[1] not in used and r[0] in groups), key=lambda r: (-r[2], groups.index(r[0]), r[1]))
            for r in free[:3]:
                used.add(r[1])
                want[r[0]] = want.get(r[0], 0) + 1
        got = scope.replacement_ranks(spark.createDataFrame(rows, "pos string, id int, points double"), slots, 3)
        assert {r.pos: r.baseline for r in got.collect()} == want
    shared = spark.createDataFrame([(1, 0, ["A"], 3), (1, 1, ["A", "B"], 3)], "scope int, slot_order int, eligible array<string>, teams int")
    assert {r.pos: r.baseline for r in scope.share_ranks(shared).collect()} == {"A": 4, "B": 2}
    assert [r.pos for r in scope.startable_groups(shared).orderBy("place").collect()] == ["A", "B"]


def test_lineups(spark):
    rows = [("x", 1, "A", 5.0), ("x", 2, "A", 4.0), ("x", 3, "A", 9.0), ("x", 4, "B", 1.0), ("y", 1, "C", 7.0)]
    got = scope.standings(spark.createDataFrame(rows, "team string, pick int, pos string, points double"), [("A", ["A"]), ("F", ["A", "B"])])
    assert {r.team: (r.points, r.filled, r.picks) for r in got.collect()} == {"x": (9.0, 2, 4), "y": (0.0, 0, 1)}


def test_uncertainty_of_few(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("b", 2, 1.0, 2.0), ("b", 3, 3.0, 4.0)], "pos string, id int, sd_pts double, sd_ecr double")
    assert {r.id: r.uncertainty for r in rank.uncertainty(df).collect()} == {1: None, 2: 1, 3: 99}


def test_clean(spark):
    df = spark.createDataFrame([("1,200", "a", "7", None), ("--", "", "x", None), ("3.5", "b", None, None)], "n string, t string, m string, e string")
    got = clean.numeric_columns(df)
    assert [r.n for r in got.collect()] == [1200.0, None, 3.5] and dict(got.dtypes)["m"] == "string"
    assert clean.drop_empty_columns(df).columns == ["n", "t", "m"]
    assert clean.numbered_headers(["a", "b", "a"], {"a": "rec_a"}) == ["a", "b", "rec_a"]
    assert clean.first_rows(spark.createDataFrame([(1, 2), (1, 1), (None, 3), (None, 3)], "k int, o int"), ["k"], ["o"], "k").count() == 3


def test_readers(spark, tmp_path):
    page = "<table><tr><th>h<th colspan=2>x y</tr><tr><td>1 <b>2</b></td></tr></table><table></table>"
    got = readers.tables(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("row_no").collect()
    assert [r.cells for r in got] == [["h", "x y", "x y"], ["1 2", "", ""]]
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b:int,c:struct<d:int>>")
    assert readers.flattened(nested).columns == ["a_b", "a_c_d"]
    script = spark.createDataFrame([(1, "<script>var d = {\"p\": [1]}; f()</script>")], "page_id long, html string")
    assert readers.script_json(script, "d", "p array<int>").first().value.p == [1]
    rosters = spark.createDataFrame([(1, "o", ["a", "b"], ["a", None, "0"], None)], "roster_id int, owner_id string, players array<string>, starters array<string>, reserve array<string>")
    assert {(r.player, r.is_starter, r.is_reserve) for r in readers.roster_rows(rosters).collect()} == {("a", True, False), ("b", False, False)}
    pages = spark.createDataFrame([("s", 1, 5.0), ("s", 1, 4.0), ("s", 2, 3.0), ("s", 2, 0.5), ("s", 3, 9.0), ("s", 3, 9.0)], "source string, page int, points double")
    assert readers.until_short_page(pages, 2, 1.0).count() == 4
    assert publish.publish({"a": pages, "b": pages.limit(0)}, str(tmp_path)) == {"a": 6, "b": 0}
    assert publish.published(spark, str(tmp_path), "b").columns == pages.columns


@pytest.mark.parametrize("files", [1, 3])
def test_live_state_equals_batch(spark, sf, tmp_path, files):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(files):
        events.filter(F.pmod("event_id", F.lit(files)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    state = live.Holders(spark, f"{tmp_path}/state")
    for k in range(files):
        rows = spark.read.parquet(f"{tmp_path}/in/{k}")
        own = rows.filter("event_type = 'purchase'").select(F.get_json_object("props", "$.k").cast("long").alias("entity"), F.col("user_id").alias("manager"), F.col("event_id").alias("pick"), "ts")
        state.update(own, k)
        state.update(own, k)
        assert state.version() == k
        # a new object goes on where the last one stopped
        state = live.Holders(spark, f"{tmp_path}/state")
    want = {(r.entity, r.manager) for r in scope.latest_holder(queries.picks(spark, sf)).collect()}
    assert {(r.entity, r.manager) for r in state.table().collect()} == want


def test_new_holders_and_restart(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "entity long, manager long, pick long, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    day = lambda d: datetime.datetime(2024, 1, d)
    state = live.Holders(spark, f"{tmp_path}/s")
    assert state.table().count() == state.new().count() == 0
    state.update(rows((1, 7, 1, day(1)), (2, 7, 2, day(1))), 0)
    assert sorted(r.entity for r in state.new().collect()) == [1, 2]
    again = live.Holders(spark, f"{tmp_path}/s")
    again.update(rows((1, 9, 5, day(3)), (3, 8, 4, day(2)), (2, 9, 0, day(1))), 1)
    assert sorted((r.entity, r.manager) for r in again.table().collect()) == [(1, 9), (2, 7), (3, 8)]
    assert [r.entity for r in again.new().collect()] == [3]
    again.update(rows((4, 1, 9, day(4))), 1)  # the same batch again
    assert live.Holders(spark, f"{tmp_path}/s").table().count() == 3


def test_failed_publish_keeps_the_old_snapshot(spark, tmp_path):
    good = spark.range(3)
    publish.publish({"a": good}, str(tmp_path))
    bad = good.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        publish.publish({"a": spark.range(9), "b": bad}, str(tmp_path))
    assert publish.published(spark, str(tmp_path), "a").count() == 3


def test_spread_rank_equals_the_window(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), None if draw.random() < 0.1 else float(draw.choice([draw.randrange(5), draw.randrange(900)]))) for _ in range(3000)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = rank.spread_rank(df, "v", ["g"]).withColumn("want", rank.null_rank("v", ["g"]))
    assert got.filter("not (rank <=> want)").count() == 0 and got.count() == len(rows)
    assert rank.spread_rank(df.limit(0), "v", ["g"]).count() == 0


def test_borrowed_spread_and_methods(spark):
    rows = [("a", 1, "s", 10.0), ("a", 1, "t", 14.0), ("a", 2, "s", 20.0), ("a", 3, "s", -1.0), ("a", 3, "t", 0.5), ("a", 4, "s", float("nan"))]
    scored = spark.createDataFrame(rows, "pos string, id int, data_src string, points double")
    weights = spark.createDataFrame([("s", 0.25), ("t", 0.0)], "data_src string, weight double")
    got = {(r.avg_type, r.id): r for r in consensus.consensus(scored, weights).collect()}
    spread = math.sqrt(8)
    assert got["average", 2].sd_pts == pytest.approx((spread + math.sqrt(1.125)) / 2) and got["average", 2].floor == pytest.approx(20 - 1.645 * got["average", 2].sd_pts)
    assert got["weighted", 1].points == 10.0 and got["weighted", 1].sd_pts is None  # two sources, one of them weighted
    assert not any(k[1] in (3, 4) for k in got)
    assert {r.avg_type for r in consensus.one_method(consensus.consensus(scored, weights)).collect()} == {"weighted"}
    assert {r.avg_type for r in consensus.one_method(consensus.consensus(scored, weights, ("robust", "average"))).collect()} == {"average"}


def test_published_misses_stay(spark):
    df = spark.createDataFrame([(20.0, 4.0, 30.0, 2.0)], "fg double, fg_miss double, xp double, xp_miss double")
    r = impute.reconcile_kicking(df).first()
    assert (r.fg_att, r.fg_miss, r.xp_att, r.xp_miss) == (24.0, 4.0, 32.0, 2.0)
    partial = impute.linear_estimate(df, {"m": (0.0, "fg", 0.5)}, {"m": ["m", "not_there"]})
    assert partial.first().m == 10.0
    yards = spark.createDataFrame([("A", 10.0, None), ("A", -3.0, None), ("A", None, None), ("B", 10.0, None), ("B", 1.0, 2.0)], "pos string, y double, d double")
    assert [r.d for r in impute.first_downs(yards, {"A": 0.5}, "d", "y").collect()] == [5.0, 0.0, None, None, 2.0]


def test_fills_in_order_of_their_rates(spark):
    assert board.fill_order(["rec_tgt", "rec", "x", "rec_yds"], board.RATE_RULES) == ["rec_yds", "rec", "rec_tgt", "x"]
    assert board.fill_order(["a", "b"], {"a": "b", "b": "a"}) == ["b", "a"]
    rows = [("a", 1, "s", 4.0, 2.0, 1.0), ("a", 1, "t", 8.0, None, None), (None, None, "t", 1.0, 1.0, 1.0)]
    lines = spark.createDataFrame(rows, "pos string, id int, data_src string, rec_yds double, rec double, rec_tgt double")
    got = {r.data_src: r.points for r in board.scored_lines(lines, {"rec_tgt": 1.0, "rec": 10.0}).collect()}
    assert got == {"s": 21.0, "t": 42.0}


def test_rule_vocabulary(spark):
    schema = "scope int, pos string, stat string, points double"
    good = spark.createDataFrame([(1, None, s, v) for s, v in settings.DEFAULTS.items()], schema)
    assert settings.checked(good).count() == len(settings.DEFAULTS)
    with pytest.raises(ValueError, match="jumps"):
        settings.checked(good.unionByName(spark.createDataFrame([(1, "TE", "jumps", 1.0)], schema)))
    tiers = [(top, points) for top, points in settings.DEFAULT_BRACKETS]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (5.0,), (40.0,)], "x double").select(score.bracket(F.col("x"), tiers)).collect()] == [10.0, 7.0, -4.0]


def test_landed_parameters_and_pages(spark, tmp_path):
    (tmp_path / "models.json").write_text(json.dumps({"m300": [-1.5, "yds", 0.001], "m350": [0.5, "yds", 0.002]}))
    got = {r.name: (r.intercept, r.metric, r.slope) for r in payloads.regression_models(spark, f"{tmp_path}/models.json").collect()}
    assert got == {"m300": (-1.5, "yds", 0.001), "m350": (0.5, "yds", 0.002)}
    (tmp_path / "list-p2.txt").write_text("c\n")
    (tmp_path / "list-p1.txt").write_text("a\nb\n")
    assert sorted((r.page, r.value) for r in payloads.page_files(spark, f"{tmp_path}/list-p*.txt").collect()) == [(1, "a"), (1, "b"), (2, "c")]
    (tmp_path / "ids.csv").write_text("id,n\n0007,1\nNA,\n")
    assert [(r.id, r.n) for r in readers.typed(spark, f"{tmp_path}/ids.csv", "id string, n int").collect()] == [("0007", 1), (None, None)]


def test_board_with_every_part(spark):
    draw = random.Random(4)
    rows = [(k, "AB"[k % 2], s, draw.uniform(5, 50)) for k in range(40) for s in "st"]
    scored = spark.createDataFrame(rows, "id int, pos string, data_src string, points double")
    weights = spark.createDataFrame([("s", 0.5), ("t", 0.5)], "data_src string, weight double")
    people = spark.createDataFrame([(k, "F", f"l{k}", "T", "A", 20, 1) for k in range(40)], "id int, first_name string, last_name string, team string, position string, age int, exp int")
    ranks = spark.createDataFrame([(k, n, float(k), float(k % 5)) for k in range(30) for n in (2, 1)], "id int, seq int, avg double, std_dev double")
    values = spark.createDataFrame([(k, float(k), 1.0) for k in range(20)], "id int, adp double, adp_sd double")
    cross = spark.createDataFrame([(k, 1, f"x{k}", "KCC", None) for k in range(35)], "id int, seq int, platform_id string, platform_team string, injury_status string")
    rosters = spark.createDataFrame([("x3", 1, "team", "me", True)], "platform_id string, seq int, team_name string, manager string, is_starter boolean")
    inputs = board.Inputs(people, ranks, values, cross, rosters, "seq", {"T": "TT"})
    out = board.build_board(scored, weights, [("A", ["A"]), ("F", ["A", "B"])], 3, inputs)
    got = {(r.avg_type, r.id): r for r in out.collect()}
    assert len(got) == 120 and out.columns[:5] == ["avg_type", "rank", "id", "player", "pos"]
    r = got["weighted", 3]
    assert (r.player, r.team, r.rostered_by, r.starting, r.adp_diff) == ("F l3", "TT", "team", True, r["rank"] - 3.0)
    assert all(1 <= r.uncertainty <= 99 for r in got.values())
    # equal weights: the weighted centre is the mean
    assert all(got["weighted", k].points == pytest.approx(got["average", k].points) for k in range(40))


def test_stream_run(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state = live.Holders(spark, f"{tmp_path}/state")
    state.start(live.read_picks(spark, f"{tmp_path}/in", schema), f"{tmp_path}/check").awaitTermination()
    assert {(r.entity, r.manager) for r in state.table().collect()} == {(r.entity, r.manager) for r in scope.latest_holder(queries.picks(spark, sf)).collect()}
    assert live.freshness(state.table(), 1.0).first().stale
    # nothing new has landed: a restart runs no batch; then late and new picks
    state.start(live.read_picks(spark, f"{tmp_path}/in", schema), f"{tmp_path}/check").awaitTermination()
    held = {r.entity: r for r in state.table().collect()}
    old, top = next(iter(held.values())), max(r.ts for r in held.values())
    fields = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    more = [(10**9, top + datetime.timedelta(days=1), 77, "purchase", 1.0, '{"k": %d}' % old.entity), (10**9 + 1, top + datetime.timedelta(hours=2), 78, "purchase", 1.0, '{"k": 123456789}'), (10**9 + 2, top + datetime.timedelta(minutes=1), 79, "purchase", 1.0, '{"k": %d}' % old.entity), (10**9 + 1, top + datetime.timedelta(hours=2), 78, "purchase", 1.0, '{"k": 123456789}')]
    spark.createDataFrame(more, fields).select(*schema.names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = live.Holders(spark, f"{tmp_path}/state")
    again.start(live.read_picks(spark, f"{tmp_path}/in", schema), f"{tmp_path}/check").awaitTermination()
    assert sorted((r.entity, r.manager) for r in again.last().collect()) == sorted([(old.entity, 77), (123456789, 78)])
    assert [r.entity for r in again.new().collect()] == [123456789]
    assert {r.entity: r.manager for r in again.table().collect()} == {**{e: r.manager for e, r in held.items()}, old.entity: 77, 123456789: 78}


def test_feed_costs_its_batches_and_clears_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 3)
    feed = live.Feed(spark, str(tmp_path), ["k"], "k long, v long")
    want = {}
    for n in range(8):
        rows = [(k, 10 * n + k) for k in range(n % 4 + 1)]
        want |= dict(rows)
        assert feed.append(spark.createDataFrame(rows, "k long, v long"), n)
        assert not feed.append(spark.createDataFrame([(0, -1)], "k long, v long"), n)
        assert {r.k: r.v for r in feed.table().collect()} == want
        assert {r.k: r.v for r in feed.last().collect()} == dict(rows)
        says = feed.says()
        assert len(says["changes"]) < 3 and says["batch"] == n
    assert len([p for p in tmp_path.iterdir() if not p.name.startswith("_")]) <= 6
    assert len(publish.versions(spark, str(tmp_path))) <= 5


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path)
    publish.publish({"ownership": spark.range(3), "order": spark.range(5)}, path, facts={"stamp": 1})
    # both read version 0, both want to be version 1
    number, says = publish.manifest(spark, path)
    publish.publish({"ownership": spark.range(4)}, path, carry=True, facts={"stamp": 2})
    with pytest.raises(publish.Conflict):
        publish.commit(spark, path, number + 1, {**says, "stamp": 3})
    number, says = publish.manifest(spark, path)
    assert (number, says["stamp"]) == (1, 2)
    assert publish.published(spark, path, "ownership").count() == 4 and publish.published(spark, path, "order").count() == 5
    results = []

    def write(n, where, number):
        try:
            publish.commit(spark, where, number, {**says, "stamp": n})
            results.append(n)
        except publish.Conflict:
            pass

    for k in (*range(40), None):  # forty races beside the one on the table itself
        results.clear()
        where, number = (path, 2) if k is None else (str(tmp_path.parent / f"{tmp_path.name}-races"), k)
        threads = [threading.Thread(target=write, args=(n, where, number)) for n in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(results) == 1 and publish.manifest(spark, where)[1]["stamp"] == results[0]
    # a writer that died in the middle of its version is passed over
    (tmp_path / "_versions" / f"{3:012d}").write_text('{"ownership": ')
    assert publish.manifest(spark, path) == (3, {**says, "stamp": results[0]})
    publish.publish({"order": spark.range(6)}, path, carry=True)
    assert publish.vacuum(spark, path, 1) >= 1 and publish.published(spark, path, "ownership").count() == 4


def test_live_board_follows_a_new_board(spark, tmp_path):
    row = lambda *r: spark.createDataFrame(r, live.CHANGES)
    day = lambda d: datetime.datetime(2024, 1, d)
    put = lambda *r: publish.publish({"board": spark.createDataFrame(r, "pos string, id long, points double")}, f"{tmp_path}/b")
    put(("a", 1, 5.0), ("a", 2, 4.0))
    state = live.LiveBoard(spark, f"{tmp_path}/live", f"{tmp_path}/b")
    seen = lambda: {(r.id, r.points, r.manager) for r in state.table().collect()}
    state.update(row((1, 7, 1, day(1), True)), 0)
    assert seen() == {(1, 5.0, 7), (2, 4.0, None)}
    state.update(row((2, 8, 2, day(2), True)), 1)
    state.update(row((2, 9, 2, day(2), True)), 1)  # again
    assert seen() == {(1, 5.0, 7), (2, 4.0, 8)} and len(state.says()["changes"]) == 1
    put(("a", 1, 6.0), ("a", 3, 3.0))
    state.update(row((1, 9, 3, day(3), False), (3, 9, 4, day(3), True)), 2)
    assert seen() == {(1, 6.0, 9), (3, 3.0, 9)} and state.says()["changes"] == []


def test_freshness_of_queries(spark, sf, tmp_path):
    watch = live.Freshness(1.0)
    spark.streams.addListener(watch)
    try:
        rows = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
        rows.writeStream.queryName("scope_a").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if "scope_a" in watch.last:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    last = watch.last["scope_a"]
    assert not watch.stale("scope_a", last + datetime.timedelta(seconds=9)) and watch.stale("scope_a", last + datetime.timedelta(seconds=11))
    assert watch.stale("other", last)
    watch.poll_seconds = 5.0
    assert not watch.stale("scope_a", last + datetime.timedelta(seconds=19)) and watch.stale("scope_a", last + datetime.timedelta(seconds=21))


@pytest.mark.parametrize("gone", ["accordant.llm", "corpus_pipeline"])
def test_entry_without_the_subpackage(gone):
    """In a process that cannot import it."""
    code = f"import sys; sys.modules['{gone}'] = None\nimport __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(queries.QUERIES)), str(len(queries.SQL)), "False"]


def test_clean_ids_and_numbers(spark):
    df = spark.createDataFrame([("7", float("nan")), ("12345", 2.0), (None, None)], "k string, v double")
    assert [r[0] for r in df.select(clean.pad_id(F.col("k"))).collect()] == ["0007", "12345", None]
    assert [r.v for r in clean.nan_to_null(df).collect()] == [None, 2.0, None]


def test_tables_in_upper_case(spark):
    pages = spark.createDataFrame([(1, "<TABLE><TR><TD>a</TD><TD>b</TD></TR></TABLE>"), (2, "none"), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.cells) for r in readers.tables(pages).collect()] == [(1, ["a", "b"])]


def test_all_rules_and_whole_sorts(spark, sf):
    rows = queries.lines(spark, sf).collect()
    n = queries.table(spark, sf, "supplier").count()
    first = queries.table(spark, sf, "part").agg(F.min("p_type")).first()[0]
    nation = {r.s_suppkey: r.s_nationkey for r in queries.table(spark, sf, "supplier").collect()}
    got = {(r.scope, r.id, r.data_src): r.points for r in queries.QUERIES["score_all_rules"](spark, sf).collect()}
    assert len(got) == n * len(rows)
    for r in rows[::7]:
        for s, k in nation.items():
            qty = 9.0 if s % 3 == 0 and r.pos == first else s / 10
            assert got[s, r.id, r.data_src] == pytest.approx((r.qty or 0) * qty + r.yds * 0.001 + (r.disc or 0) * k, abs=1e-6)
    for name, sign in (("null_last_sort_down", -1), ("null_last_sort_up", 1)):
        want = sorted(rows, key=lambda r: (r.qty is None, sign * (r.qty or 0), r.id, r.data_src))
        assert [(r.id, r.data_src, r.qty) for r in queries.QUERIES[name](spark, sf).collect()] == [(r.id, r.data_src, r.qty) for r in want]
        assert want[-1].qty is None


@pytest.mark.parametrize("parts", [4, 64])
def test_selected_quantiles_are_exact(spark, monkeypatch, parts):
    """By ranges as by one buffer: one group that holds nearly all rows, many ties, tiny groups, groups without a value."""
    monkeypatch.setattr(select, "PARTS", parts)
    draw = random.Random(2)
    rows = [("big", draw.choice([draw.gauss(0, 1), float(draw.randrange(5)), 7.0])) for _ in range(20_000)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), ("none", None), ("same", 2.5), ("same", 2.5)]
    df = spark.createDataFrame(rows, "pos string, v double").repartition(5)
    shares = [0.0, 0.05, 0.1, 0.5, 0.77, 0.95, 1.0]
    want = {r.pos: r.q for r in select.quantiles(df, ["pos"], "v", shares).collect()}
    monkeypatch.setattr(select, "WHOLE", 10)
    got = {r.pos: r.q for r in select.quantiles(df, ["pos"], "v", shares).collect()}
    assert set(got) == {"big", "one", "two", "same"} and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    assert select.quantiles(df.limit(0), ["pos"], "v", shares).count() == 0


def test_first_downs_at_the_edge_of_a_rate(spark):
    """14 attempts in 7 games are 2 a game, though 0.07 * 100 is more than 7: on both sides the rounded rate counts."""
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in ("lineitem", "orders", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES["first_downs"](spark, sf)
    got = con.execute(queries.SQL["first_downs"])
    names = [d[0] for d in got.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


def test_means_halfway_go_up(spark):
    """Halves in decimals, a bit off as doubles: query and SQL round them up alike."""
    rows = [(1, 57.60561, 66.29438999999999), (2, 11.41484, 17.88516), (3, 90.46945, 98.43055), (4, 1.0, 1.1)]
    df = spark.createDataFrame([(i, s, v) for i, a, b in rows for s, v in (("u", a), ("l", b))], "id long, data_src string, v double")
    got = {r.id: (r.v, r.v_sd) for r in consensus.source_table(df, "v", ["u", "l"]).collect()}
    assert {i: m for i, (m, _) in got.items()} == {1: 62.0, 2: 14.7, 3: 94.5, 4: 1.1}
    for name in ("draft_difference", "values_by_source"):
        assert "round(round(avg(site_pts), 8)::decimal(28, 8), 1)::double" in queries.SQL[name]
    means = duckdb.connect().execute("select round(round((a + b) / 2, 8)::decimal(28, 8), 1)::double from (values (57.60561::double, 66.29438999999999::double), (11.41484, 17.88516), (90.46945, 98.43055), (1.0, 1.1)) t(a, b)").fetchall()
    assert [m for m, in means] == [62.0, 14.7, 94.5, 1.1]
