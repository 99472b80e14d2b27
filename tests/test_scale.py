"""Operators that take groups of any size, any number of scopes, frames or levels, against plain forms of themselves."""

import json
import math
import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from accordant.functions import select
from accordant.operators import board, clean, consensus, identity, impute, rank, scope, score
from accordant.plans import queries
from accordant.sources import payloads, publish, readers


def board_rows(n, ties):
    draw = random.Random(ties)
    rows = []
    for k in range(n):
        points = float(draw.randrange(1, ties)) if draw.random() < 0.6 else draw.uniform(1, ties)
        rows.append((draw.choice(["a", "b"]), "big" if draw.random() < 0.8 else "small", k, points, draw.choice([None, 1.0, 2.0, 3.0]), draw.choice([None, 0.5, 1.5, 9.0])))
    rows += [("a", "one", -1, 5.0, 1.0, None), ("a", "same", -2, 5.0, None, None), ("a", "same", -3, 5.0, None, 2.0), ("a", "same", -4, 5.0, None, 2.0)]
    return rows


@pytest.mark.parametrize("ties", [4, 60, 100_000])
def test_ladders_equal_windows(spark, monkeypatch, ties):
    """Ranks, drop-off, tiers and percent ranks of one group in many ranges, with few and with many equal values."""
    df = spark.createDataFrame(board_rows(900, ties), "avg_type string, pos string, id long, points double, sd_pts double, sd_ecr double")
    want = {(r.avg_type, r.pos, r.id): r for r in rank.rank_and_tier(df, {"big": 0.1}).collect()}
    sure = {(r.avg_type, r.id): r.uncertainty for r in rank.uncertainty(df).collect()}
    monkeypatch.setattr(select, "WHOLE", 1)
    got = {(r.avg_type, r.pos, r.id): r for r in rank.rank_and_tier(df, {"big": 0.1}).collect()}
    assert got.keys() == want.keys() and len(got) == 904
    for k, r in got.items():
        assert (r.pos_rank, r.tier) == (want[k].pos_rank, want[k].tier) and r.dropoff == pytest.approx(want[k].dropoff, abs=1e-12), k
    assert {(r.avg_type, r.id): r.uncertainty for r in rank.uncertainty(df).collect()} == sure
    assert rank.rank_and_tier(df.limit(0), {}).count() == 0 and rank.uncertainty(df.limit(0)).count() == 0


def test_no_task_holds_a_group(spark):
    """The ranges of one group of distinct values are balanced: the largest has less than a twentieth of the rows."""
    df = spark.range(20_000).select(F.lit("g").alias("pos"), (F.rand(3) * 1000).alias("v"))
    cuts = df.agg(F.approx_percentile("v", [k / rank.PARTS for k in range(1, rank.PARTS)], 20 * rank.PARTS)).first()[0]
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e < F.col("v")))
    assert df.groupBy(part).count().agg(F.max("count")).first()[0] < 1000


def sequential(slots, board):
    """Baselines of one scope, one start at a time."""
    pools = {}
    for pos, _, points in sorted(board, key=lambda r: -r[2]):
        pools.setdefault(pos, []).append(points)
    taken, flexes = {}, []
    for _, groups, teams in sorted(slots):
        if len(groups) == 1:
            taken[groups[0]] = taken.get(groups[0], 0) + teams
        else:
            flexes += [groups] * teams
    if not flexes:
        return taken
    taken = {p: taken.get(p, 0) for p in pools}
    for groups in flexes:
        left = [(pools[p][taken[p]], -k, p) for k, p in enumerate(groups) if p in pools and taken[p] < len(pools[p])]
        if left:
            taken[max(left)[2]] += 1
    return {p: n for p, n in taken.items() if n}


@pytest.mark.parametrize("own", [False, True])
def test_baselines_of_a_thousand_scopes(spark, own):
    draw = random.Random(8)
    slots = {s: [(n, draw.sample("ABCDE", draw.choice([1, 1, 2, 3])), draw.randrange(1, 5)) for n in range(draw.randrange(1, 6))] for s in range(1000)}
    for s in slots:  # a scope has one number of teams
        slots[s] = [(n, g, slots[s][0][2]) for n, g, _ in slots[s]]
    make = lambda: [(p, k, float(draw.randrange(30))) for k, p in enumerate(draw.choices("ABCD", k=40))]
    boards = {s: make() for s in slots} if own else dict.fromkeys(slots, make())
    rows = [(s, *r) for s in slots for r in boards[s]] if own else boards[0]
    board = spark.createDataFrame(rows, ("scope int, " if own else "") + "pos string, id int, points double")
    table = spark.createDataFrame([(s, *r) for s, own_slots in slots.items() for r in own_slots], "scope int, slot_order int, eligible array<string>, teams int")
    got = {}
    for r in scope.replacement_ranks_of_all(board, table).collect():
        got.setdefault(r.scope, {})[r.pos] = r.baseline
    assert got == {s: w for s in slots if (w := sequential(slots[s], boards[s]))}
    shares = {(r.scope, r.pos): r.baseline for r in scope.share_ranks(table).collect() if any(len(g) > 1 for _, g, _ in slots[r.scope])}
    none = {(r.scope, r.pos): r.baseline for r in scope.replacement_ranks_of_all(board.limit(0), table).collect() if any(len(g) > 1 for _, g, _ in slots[r.scope])}
    assert none == shares


def test_turn_costs_equal_a_walk(spark):
    """Each turn played out: the slot takes the best of another group, the others the best there is."""
    for seed, groups, n in ((1, "AB", 60), (2, "AAAAB", 90), (3, "ABC", 9), (4, "A", 12)):
        draw = random.Random(seed)
        rows = [(k, draw.choice(groups), float(draw.randrange(40))) for k in range(n)]
        board = spark.createDataFrame(rows, "id int, pos string, v double")
        got = {(r.slot, r.round, r.pos): (r.now, r.later) for r in scope.turn_costs(board, "v", 3, 4).collect()}
        order = sorted(rows, key=lambda r: (-r[2], r[0]))
        want = {}
        picks = {s: [(r - 1) * 3 + (s if r % 2 else 4 - s) for r in range(1, 5)] for s in (1, 2, 3)}
        for s, own in picks.items():
            for r, pick in enumerate(own):
                until = own[r + 1] if r < 3 else 13
                for pos in {x[1] for x in rows}:
                    left = order[pick - 1 :]
                    now = next((x[2] for x in left if x[1] == pos), None)
                    skip = next((x for x in left if x[1] != pos), None)
                    rest = [x for x in left if x is not skip][until - pick - 1 :]
                    want[s, r + 1, pos] = (now, next((x[2] for x in rest if x[1] == pos), None))
        assert got == want
    assert scope.turn_costs(board.limit(0), "v", 3, 4).count() == 0


def test_standings_place_ties(spark):
    teams = spark.createDataFrame([(t,) for t in "abcd"], "team string")
    picks = spark.createDataFrame([("a", 1, "A", 5.0), ("b", 2, "A", 5.0), ("c", 3, "A", 2.0)], "team string, pick int, pos string, points double")
    got = {r.team: (r.points, r.place) for r in scope.ranked_standings(teams, picks, [("A", ["A"])]).collect()}
    assert got == {"a": (5.0, 1), "b": (5.0, 1), "c": (2.0, 3), "d": (0.0, 4)}


def test_objects_thirty_levels_deep(spark):
    deep = {"player_id": "x", "stats": {"value": 3.0}, "inside": {"player_id": "hidden", "stats": 1}}
    for k in range(30):
        deep = [None, {f"k{k}": deep}] if k % 2 else {"player_id": "no", "a": deep}
    texts = [(1, json.dumps(deep)), (2, json.dumps([{"player_id": None, "stats": {}}, {"stats": 1}])), (3, "{broken"), (4, None), (5, "7"), (6, "[]")]
    df = spark.createDataFrame(texts, "k int, t string")
    got = payloads.objects_with(df, "t", ("player_id", "stats"), "player_id string, stats struct<value:double>", ["k"])
    assert sorted((r.k, r.player_id, r.stats.value) for r in got.collect()) == [(1, "x", 3.0), (2, None, None)]
    assert payloads.objects_with(df.limit(0), "t", ("a",), "a string", ["k"]).collect() == []


def test_tiers_as_a_table(spark):
    draw = random.Random(5)
    tiers = {s: [(float(t), float(draw.randrange(9))) for t in draw.sample(range(100), draw.randrange(1, 9))] for s in range(40)}
    tiers[7] = [(5.0, 1.0), (5.0, 3.0)]
    rows = [(k, draw.randrange(42), draw.choice([None, float(draw.randrange(-5, 110)), draw.uniform(0, 100)])) for k in range(3000)] + [(k, 7, float(k % 9)) for k in range(3000, 4000)]
    df = spark.createDataFrame(rows, "k int, scope int, x double")
    table = spark.createDataFrame([(s, *t) for s, own in tiers.items() for t in own], "scope int, max_allowed double, points double")
    got = {r.k: r.points for r in score.tier_join(df, "x", table).collect()}
    assert len(got) == len(rows)
    for k, s, x in rows:
        own = sorted(tiers.get(s, []))
        want = 0.0 if not own else None if x is None else next((p for top, p in own if x <= top), own[-1][1])
        assert got[k] == want, (k, s, x)
    assert {r.points for r in score.tier_join(df, "x", table.limit(0)).collect()} == {0.0}


def test_columns_of_sixty_frames(spark):
    """One aggregation decides for every frame what numeric_columns, drop_empty_columns and drop_constant_text decide for one."""
    draw = random.Random(9)
    cells = []
    for f in range(60):
        for c in range(5):
            kind = draw.choice([["1", "2,000", "--", None], ["a", "b", ""], ["--", " NA "], ["x", "x", None], ["7"], ["1", "z"]])
            cells += [(f"f{f}", f"c{c}", row, draw.choice(kind)) for row in range(draw.randrange(1, 7))]
    df = spark.createDataFrame(cells, "frame string, column string, row int, value string")
    got = {(r.frame, r.column): (r.is_number, r.kept) for r in clean.column_kinds(df, ["frame"]).collect()}
    values = {}
    for f, c, row, v in cells:
        values.setdefault((f, c), []).append(v)
    for key, own in values.items():
        one = clean.numeric_columns(spark.createDataFrame([(v,) for v in own], "c string")) if key[0] in ("f0", "f1") else None
        known = [v for v in own if v is not None and v.strip() not in clean.BLANKS]
        number = bool(known) and all(v.replace(",", "").isdigit() for v in known)
        assert got[key] == (number, number or len(set(known)) > 1), (key, own)
        if one is not None:
            assert (one.schema[0].dataType.simpleString() == "double") == number
            assert bool(clean.drop_constant_text(clean.drop_empty_columns(one)).columns) == got[key][1]


def test_parts_of_a_season(spark):
    """Kickers, milestones, first downs and the defence's bracket within one call; other groups keep their kicks."""
    schema = "id string, pos string, data_src string, pass_yds double, rush_yds double, rush_att double, fg_0039 double, fg_att double, fg double, xp double, dst_sacks double, dst_pts_allowed double"
    rows = [
        ("q", "QB", "s", 4000.0, 340.0, 68.0, None, None, None, None, None, None), ("k", "K", "s", None, None, None, 20.0, 25.0, None, 30.0, None, None), ("r", "RB", "s", None, 100.0, 10.0, 5.0, 9.0, 7.0, None, None, None),
        ("d", "DST", "s", None, None, None, None, None, None, None, 40.0, 340.0), ("d", "DST", "t", None, None, None, None, None, None, None, None, None), ("x", "DST", "s", None, None, None, None, None, None, None, 9.0, 300.0), (None, "QB", "s", 1.0, 1.0, 1.0, None, None, None, None, None, None),
    ]
    lines = spark.createDataFrame(rows, schema)
    rules = {"pass_yds": 0.04, "pass_300_yds": 1.0, "pass_fd": 1.0, "rush_fd": 1.0, "fg_0019": 3.0, "fg_2029": 3.0, "fg_3039": 3.0, "fg_miss": -1.0, "xp": 1.0, "dst_sacks": 1.0}
    landed = spark.createDataFrame([("t1", "d", "T", 0.0, 0.0), ("d0", None, "U", 5.0, 0.0)], "id string, nfl_id string, team string, Intercept double, season_mean double")
    season = board.Season({"pass_300_yds": (-0.5, "pass_yds", 0.001), "pass_400_yds": (1.0, "pass_yds", 1.0)}, {"pass_300_yds": ["pass_300_yds", "pass_400_yds"]}, None, [(21.0, 3.0), (math.inf, -4.0)], payloads.team_spreads(landed))
    got = {(r.id, r.data_src): r.points for r in board.scored_lines(lines, rules, None, board.Fills(level="none"), season).collect()}
    # 4 carries a game; a spread of 0 plays 20 points in each of 17 games; x has no spread
    assert got.keys() == {("q", "s"), ("k", "s"), ("r", "s"), ("d", "s"), ("d", "t")}
    assert got["q", "s"] == pytest.approx(160 + 3.5 + 4000 * 0.0483 + 68 * 0.342)
    assert got["k", "s"] == pytest.approx(60 - 5 + 30)
    # kicks of other groups are not reconciled, and their misses are filled by the rules' own fills only
    assert got["r", "s"] == pytest.approx(100 * 0.0508 - (9 - 7))
    assert got["d", "s"] == 40 + 17 * 3 and got["d", "t"] == 40 + 17 * 3
    week = board.Season(brackets=[(21.0, 3.0), (math.inf, -4.0)], weekly=True)
    got = {(r.id, r.data_src): r.points for r in board.scored_lines(lines, rules, None, board.Fills(level="none"), week).collect()}
    assert got["x", "s"] == 9 - 4 and got["d", "s"] == 36
    assert board.scored_lines(lines.limit(0), rules, None, board.Fills(level="none"), season).count() == 0
    left = impute.unfilled(lines, {"K": ["fg", "xp", "none"], "QB": ["pass_yds"], "DST": ["dst_sacks"]}).collect()
    assert {(r.pos, r.metric, r.n) for r in left} == {("K", "fg", 1), ("DST", "dst_sacks", 1)}


def test_season_totals_by_row(spark):
    df = spark.createDataFrame([(str(k), 17.0 * k, float(k % 5)) for k in range(40)] + [("n", None, 1.0), ("m", 3.0, None)], "id string, season double, sd double")
    tiers = [(5.0, 10.0), (15.0, 7.0), (25.0, 4.0)]
    want = {r.id: r.points for r in score.season_bracket(df, ["id"], F.col("season"), F.col("sd"), tiers).collect()}
    got = {r.id: r.points for r in df.select("id", score.season_total(["id"], F.col("season") / 17, F.col("sd"), tiers).alias("points")).collect()}
    assert got == want and got["n"] is None and got["m"] is None


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_draw_is_worked_out_once(spark):
    """Two digests a game: not once more for every tier, nor for a filter by the total."""
    tiers = [(5.0, 10.0), (15.0, 7.0), (25.0, 4.0)]
    df = spark.createDataFrame([("a", "DST", "s", 340.0)], "id string, pos string, data_src string, dst_pts_allowed double")
    total = score.season_total(["id"], F.col("dst_pts_allowed") / 17, F.lit(3.0), tiers)
    assert optimized(df.select(total.alias("points"))).count("md5(") == 2
    spreads = spark.createDataFrame([("a", 3.0, 0.1), ("b", None, 0.1)], "id string, intercept double, slope double")
    rows = df.unionByName(spark.createDataFrame([("b", "DST", "s", 340.0), ("c", "DST", "s", 340.0), ("a", "DST", "t", None), ("a", None, "s", None)], df.schema)).withColumn("points", F.lit(1.0))
    out = board.defence_points(rows, board.Season(brackets=tiers, spreads=spreads))
    assert optimized(out).count("md5(") == 2
    assert sorted((r.id, r.pos or "") for r in out.collect()) == [("a", ""), ("a", "DST")]


def test_work_of_entities_is_not_dealt_by_bytes(spark):
    """Few bytes an entity are much work: the exchange names its number of tasks. An array is sorted once for its median, once more for the deviations."""
    scored = spark.createDataFrame([(k, "a", s, float(k + s)) for k in range(50) for s in range(3)], "id int, pos string, data_src int, points double")
    sources = spark.createDataFrame([(0, 1.0)], "data_src int, weight double")
    average = consensus.consensus(scored, sources, ("average",))
    assert average.count() == 50
    assert consensus.by_entity(scored).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert optimized(consensus.robust(scored)).count("array_sort(") <= 3


def test_landed_team_and_passer_tables(spark):
    landed = spark.createDataFrame([("a", "b", "T1", 1.0, 0.3), ("b", None, "T2", 2.0, 0.3), (None, "c", "T3", 3.0, 0.3)], "id string, nfl_id string, team string, Intercept double, season_mean double")
    assert {r.id: (r.intercept, r.slope) for r in payloads.team_spreads(landed).collect()} == {"a": (1.0, 0.3), "b": (2.0, 0.3), "c": (3.0, 0.3)}
    players = spark.createDataFrame([(1, "Jo Ann Jr.", "QB", "KC"), (2, "Al Bo", "QB", "NE"), (3, "Al Bo", "RB", "NE")], "ref_id int, name string, pos string, team string")
    games = spark.createDataFrame([("jo ann", "KC", 12.5), ("Al Bo", "NE", 16.0), ("Nobody", "NE", 3.0)], "name string, team string, games double")
    assert {r.id: r.games for r in payloads.passer_games(games, players).collect()} == {1: 12.5, 2: 16.0}


def test_ids_by_crosswalk_then_name(spark):
    rows = spark.createDataFrame([("x1", "Other Name", "QB", "KC"), ("x9", "Al Bo", "QB", "NE"), (None, "Al Bo", "QB", "NE"), ("x8", "Nobody", "K", "LA")], "src string, name string, pos string, team string")
    cross = spark.createDataFrame([(1, "x1"), (5, None)], "id int, src string")
    players = spark.createDataFrame([(2, "Al Bo", "QB", "NE"), (3, "Jo", "QB", "KC")], "ref_id int, name string, pos string, team string")
    got = [(r.src, r["name"], r.ref_id) for r in identity.by_id_or_name(rows, cross, "src", players).collect()]
    assert sorted(got, key=str) == sorted([("x1", "Other Name", 1), ("x9", "Al Bo", 2), (None, "Al Bo", 2), ("x8", "Nobody", None)], key=str)


def test_feeds_that_are_odd(spark):
    texts = ['{"p": [{"i": "1", "v": "2.5"}, null, {"v": "7"}]}', '{"p": {"a": {"i": "3", "v": null}}}', '{"p": []}', '{"q": 1}', "broken", None, '{"p": 7}']
    got = payloads.json_feed(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "p", {"src_id": "i", "value": "v"}).collect()
    assert sorted((str(r.src_id), str(r.value), r["name"]) for r in got) == [("1", "2.5", None), ("3", "None", None), ("None", "7", None)]
    page = "<table><tr><th>Id<th>Avg</tr><tr><td>4<td>1,200</tr><tr><td>5</tr></table><table><tr><td>9<td>9</tr></table>"
    got = payloads.table_feed(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"), {"src_id": "Id", "value": "Avg"}).collect()
    assert sorted((r.src_id, r.value) for r in got) == [("4", "1,200"), ("5", "")]


def test_refresh_is_one_commit(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    held = lambda *ids: spark.createDataFrame([(i, f"m{i}") for i in ids], "platform_id string, manager string")
    with pytest.raises(FileNotFoundError):
        publish.refresh(path, held("a"))
    publish.publish({"board": held("z"), "draft": held("o")}, path, facts={"written_at": "first"})
    assert {r[0] for r in publish.refresh(path, held("a", None), None, "second").collect()} == {"a"}
    assert {r[0] for r in publish.refresh(path, held("a", "b"), held("p"), "third").collect()} == {"b"}
    assert publish.refresh(path, held()).count() == 0 and publish.published(spark, path, "ownership").count() == 0
    says = publish.manifest(spark, path)[1]
    assert says["written_at"] not in ("first", "second", "third")
    assert [r[0] for r in publish.published(spark, path, "board").collect()] == ["z"] and [r[0] for r in publish.published(spark, path, "draft").collect()] == ["p"]


def test_rules_of_scopes_meet_lines_without_a_shuffle(spark):
    """The product of lines and scopes is scored where it arises: own rules, rules of 0, gaps, and scopes with one kind of rule."""
    lines = spark.createDataFrame([(1, "A", 2.0, None), (2, "B", None, 3.0), (3, None, 4.0, 5.0), (4, "A", None, None)], "id long, pos string, x double, y double")
    rules = spark.createDataFrame([(1, None, "x", 10.0), (1, "A", "x", 7.0), (2, None, "x", 0.0), (2, "A", "x", 0.0), (2, "B", "y", 1.0), (3, None, "y", 2.0), (3, None, "z", 9.0)], "scope long, pos string, stat string, points double")
    out = score.many_rule_points(lines, rules, ["x", "y"], ["id"])
    got = {(r.scope, r.id): r.points for r in out.collect()}
    assert got == {(1, 1): 14.0, (1, 3): 40.0, (2, 1): 0.0, (2, 2): 3.0, (3, 2): 6.0, (3, 3): 10.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_pages_of_plain_tags_need_no_parser():
    """The short way through a page of plain tags gives the parser's cells, and leaves all other pages to it."""
    draw = random.Random(3)
    bits = ["<table>", "</table>", "<TR>", "<tr class=a>", "</tr>", "<td>", "<td colspan=2>", "<td title='x colspan=3' COLSPAN=\"2\">", "<th colspan>", "</td>", "</th >", "<b>", "</b>", " x  y ", "1 > 0", "\n", "<td colspan='x'>", "<p id=q>"]
    odd = ["&amp;", "<!-- <td> -->", "<br/>", "<script>a<b</script>", "<td a=b/>", "</td x=1>", "< 2", "<td", "<title>t", "<td\rcolspan=2>", "<x:y>"]
    short = 0
    for n in range(3000):
        html = "".join(draw.choice(bits + (odd if n % 2 else [])) for _ in range(draw.randrange(40)))
        parser = readers._Cells()
        parser.feed(html)
        parser.close_cell()
        plain, got = readers._plain_cells(html), readers._cells(html)
        short += plain is not None
        assert got[0] == parser.tables, html
        assert [[id(r) in got[1] for r in t] for t in got[0]] == [[id(r) in parser.plain for r in t] for t in parser.tables]
    assert 1500 <= short < 2500


def test_headers_come_with_one_reading(spark):
    """Names reach a page's rows without reading the rows twice; keys with two first rows keep both, keys without one have no rows."""
    rows = spark.createDataFrame([(1, 0, ["a", "b"], True), (1, 1, ["x", "y"], False), (2, 0, ["p"], False), (2, 0, ["n"], True), (2, 1, ["q"], False), (3, 1, ["z"], False), (None, 0, ["o"], True)], "page_id long, row_no int, cells array<string>, heads boolean")
    out = payloads.headed(rows, ["page_id"])
    got = sorted((r.page_id, r.row_no, r.place, r.header, r.value) for r in out.collect())
    assert got == sorted([(1, 1, 1, "a", "x"), (1, 1, 2, "b", "y"), (2, 0, 1, "X1", "p"), (2, 0, 1, "X1", "n"), (2, 1, 1, "X1", "q"), (2, 1, 1, "n", "q")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_fills_read_their_lines_once(spark, sf):
    """Fills need their lines several times: behind them stands one stage, not the joins of the line items again."""
    from accordant.plans import queries, rules

    for f in (queries.decile_fill, queries.touch_rate_fill, queries.group_rate_fill, queries.scored, rules.scored_lines):
        assert "l_partkey" not in f(spark, sf)._jdf.queryExecution().optimizedPlan().toString(), f.__name__


def test_scopes_in_blocks_take_few_bytes(spark, tmp_path):
    """Of many scopes, a file holds the same few line by line: a fraction of a byte a row for the scope, 4 and more when each line goes through all of them."""
    n, m = 30_000, 40
    rules = spark.range(n).select(F.col("id").alias("scope"), F.lit(None).cast("string").alias("pos"), F.lit("x").alias("stat"), (F.col("id") / 10).alias("points"))
    lines = spark.range(m).select("id", F.lit("a").alias("pos"), F.when(F.col("id") != 7, F.col("id") + 0.5).alias("x")).coalesce(1)
    score.many_rule_points(lines, rules, ["x"], ["id"]).write.parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("out/*.parquet")]
    columns = [g.column(k) for f in files for g in (f.row_group(i) for i in range(f.num_row_groups)) for k in range(g.num_columns)]
    assert sum(c.total_compressed_size for c in columns if c.path_in_schema == "scope") < (m - 1) * n
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == (m - 1) * (n - 1) == out.select("scope", "id").distinct().count()  # scope 0 scores nothing, line 7 has nothing
    assert out.filter(F.abs(F.col("points") - F.col("scope") / 10 * (F.col("id") + 0.5)) > 1e-9).count() == 0


def test_lines_deal_only_what_is_asked_for(spark, tmp_path):
    """The scored queries neither read nor deal other metrics; rows of one line item are chosen as by all metrics."""
    items = [(1, 7, 3, 1, 4.0, 10.0, 0.2, 0.5), (1, 7, 3, 1, 4.0, 10.0, 0.1, 0.9), (1, 7, 3, 1, 4.0, 10.0, 0.1, 0.2), (2, 7, 4, 2, 1.0, 5.0, 0.3, 0.1), (2, 8, 4, 1, None, 5.0, None, 0.1), (None, 8, 4, 1, 2.0, 5.0, None, 0.1)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "5-LOW"), (2, "5-LOW")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "A"), (8, "B")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 4), (3, 0), (3, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    own = ["id", "pos", "data_src", "qty", "yds", "disc"]
    whole, few = (queries.lines(spark, str(tmp_path), *x).select(*own).collect() for x in ((), (queries.METRICS[:3],)))
    assert sorted(whole, key=str) == sorted(few, key=str) and len(few) == 3
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("score_all_rules", "score_many_rules"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        assert "l_tax" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(r.scope, r.id, r.data_src): r.points for r in df.collect()}
        assert got == {(s, i, d): pytest.approx(v, abs=1e-7) for s, _, i, d, v in con.execute(queries.SQL[name]).fetchall()} and len(got) == 6
