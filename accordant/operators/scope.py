"""Operators of a scope (a league): replacement ranks, picks and slots, line-ups, standings, what is available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.sources.stage import sized, small, staged

from .rank import ladder


def replacement_ranks(table: DataFrame, slots: list[tuple[str, list[str]]], teams: int) -> DataFrame:
    """(pos, baseline) of table(pos, id, points): dedicated slots, then flex slots filled best first.

    slots: (name, eligible groups) in order. One pass per flex slot: rows beyond the starters of their group so far are
    ranked together and the best `teams` of them start. Only a bounded number of rows per group can ever start, so the
    table is cut to these before the passes.
    """
    need = {}
    for _, groups in slots:
        for g in groups:
            need[g] = need.get(g, 0) + teams
    w = Window.partitionBy("pos").orderBy(F.col("points").desc(), "id")
    most = F.element_at(F.create_map(*[F.lit(v) for kv in need.items() for v in kv]), F.col("pos"))
    rows = table.filter(F.col("pos").isin(*need)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    single = {}
    for _, groups in slots:
        if len(groups) == 1:
            single[groups[0]] = single.get(groups[0], 0) + teams
    rows = rows.withColumn("starter", F.col("n") <= F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in single.items() for v in kv]), F.col("pos")), F.lit(0)) if single else F.lit(False))
    for _, groups in slots:
        if len(groups) > 1:
            order = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("pos"))
            free = F.col("pos").isin(*groups) & ~F.col("starter")
            # at most slots x teams rows a group are left
            n = F.row_number().over(Window.partitionBy(free).orderBy(F.col("points").desc(), order, "id"))
            rows = rows.withColumn("taken", free & (n <= teams)).withColumn("starter", F.col("starter") | F.col("taken")).drop("taken")
    return rows.groupBy("pos").agg(F.count_if("starter").cast("int").alias("baseline")).filter("baseline > 0")


def replacement_ranks_of_all(board: DataFrame, slots: DataFrame) -> DataFrame:
    """(scope, pos, baseline) for any number of scopes in one plan, from slots(scope, slot_order, eligible array, teams).

    board(pos, id, points) is shared by all scopes, or has a scope of its own per row. A slot with one group starts `teams` of it; the
    other slots are filled in their order, one start at a time, with the best of what is left of their groups, the first
    named of equals. A scope keeps as many sorted points of a group as its slots can start; the filling is a fold over
    these arrays. Groups without rows have no baseline unless all slots of the scope are dedicated; a scope without any
    row takes the shares of share_ranks.
    """
    shared = "scope" not in board.columns
    slots = slots.filter(F.size("eligible") > 0).withColumn("teams", F.greatest(F.lit(1), F.col("teams")))
    single = F.when(F.size("eligible") == 1, F.col("teams")).otherwise(0)
    needs = staged(slots.select("scope", F.explode("eligible").alias("pos"), "teams", single.alias("own")).groupBy("scope", "pos").agg(F.sum("teams").alias("need"), F.sum("own").alias("own")))
    most = needs.agg(F.max("need")).first()[0] or 0
    # the tasks of a group give `most` rows each before they meet
    by = ["pos"] if shared else ["scope", "pos"]
    best = Window.partitionBy(*by).orderBy(F.col("points").desc(), "id")
    top = board.filter("points is not null").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= int(most)).select(*by, "points", "n")
    pools = needs.join(small(top) if shared else top, by).filter("n <= need").groupBy("scope", "pos", "own").agg(F.sort_array(F.collect_list("points"), asc=False).alias("pool"))
    pools = pools.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("pos", "own", "pool"))).alias("g"))
    flex = F.when(F.size("eligible") > 1, F.struct("slot_order", "eligible", "teams"))
    flexes = slots.groupBy("scope").agg(F.array_sort(F.collect_list(flex)).alias("flexes"))
    each = F.flatten(F.transform("flexes", lambda f: F.array_repeat(f["eligible"], f["teams"])))
    names, pool = F.transform("g", lambda x: x["pos"]), F.transform("g", lambda x: x["pool"])

    def fill(taken: Column, eligible: Column) -> Column:
        left = F.transform(eligible, lambda p, k: F.struct(F.get(F.get(pool, F.array_position(names, p).cast("int") - 1), F.get(taken, F.array_position(names, p).cast("int") - 1)).alias("points"), (-k).alias("k"), p.alias("pos")))
        first = F.array_max(F.filter(left, lambda x: x["points"].isNotNull()))
        return F.transform(taken, lambda t, i: F.when(F.get(names, i).eqNullSafe(first["pos"]), t + 1).otherwise(t))

    filled = pools.join(flexes, "scope").withColumn("taken", F.aggregate(each, F.transform("g", lambda x: x["own"].cast("int")), fill))
    starters = filled.select("scope", F.explode(F.arrays_zip(names.alias("pos"), F.col("taken").alias("baseline"))).alias("s")).select("scope", "s.*").filter("baseline > 0")
    held = staged(starters)
    # scopes without a flex slot keep all their groups, those without rows their shares
    plain = flexes.filter("size(flexes) = 0").select("scope")
    rest = needs.filter("own > 0").join(plain, "scope", "left_semi").join(held.select("scope", "pos"), ["scope", "pos"], "left_anti").select("scope", "pos", F.col("own").cast("int").alias("baseline"))
    without = slots.join(plain, "scope", "left_anti").join(pools.select("scope"), "scope", "left_anti")
    return held.unionByName(rest).unionByName(share_ranks(without))


def share_ranks(slots: DataFrame) -> DataFrame:
    """(scope, pos, baseline) without projections, from slots(scope, slot, eligible array, teams): each slot counts teams / number of its groups for each of them; half-even rounding, at least 1."""
    each = slots.select("scope", F.explode("eligible").alias("pos"), (F.col("teams") / F.size("eligible")).alias("share"))
    return each.groupBy("scope", "pos").agg(F.greatest(F.lit(1), F.bround(F.sum("share")).cast("int")).alias("baseline"))


def startable_groups(slots: DataFrame) -> DataFrame:
    """(scope, pos, place) of slots(scope, slot_order, eligible array): groups that some slot starts, in slot order, each once."""
    seen = slots.select("scope", "slot_order", F.posexplode("eligible").alias("n", "pos"))
    first = seen.groupBy("scope", "pos").agg(F.min(F.struct("slot_order", "n")).alias("first"))
    # a scope has as many rows here as it has groups
    return first.select("scope", "pos", F.row_number().over(Window.partitionBy("scope").orderBy("first")).alias("place"))


def picks_of(slots: DataFrame, teams: int, rounds: int) -> DataFrame:
    """slots(slot) with every pick of theirs in a snake draft: one row a round, worked out, not searched."""
    turn = F.when(F.col("round") % 2 == 1, F.col("slot")).otherwise(teams + 1 - F.col("slot"))
    each = slots.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return each.withColumn("pick", (F.col("round") - 1) * teams + turn)


def my_slot(members: DataFrame, order: DataFrame, picks: DataFrame, teams: int) -> DataFrame:
    """members(me) with their slot: of order(slot, manager, team_name) by either name, else from the first of picks(manager, team_name, draft_pick)."""

    def named(df: DataFrame, value: str) -> DataFrame:
        both = df.select(F.explode(F.array("manager", "team_name")).alias("me"), value).dropna()
        return both.groupBy("me").agg(F.min(value).alias(value))

    out = members.join(named(order, "slot"), "me", "left").join(named(picks, "draft_pick"), "me", "left")
    return out.withColumn("slot", F.coalesce(F.col("slot").cast("int"), slot_of(F.col("draft_pick"), teams).cast("int"))).drop("draft_pick")


def latest_picks(held: DataFrame, n: int = 30) -> DataFrame:
    """The last n picks, newest first; a sort and a limit in one, so no task holds more than n rows of it."""
    return held.filter(F.col("draft_pick").isNotNull()).orderBy(F.col("draft_pick").desc()).limit(n)


def in_group_order(df: DataFrame, groups: list[str], *then: Column) -> DataFrame:
    """Rows in a given order of groups, unknown ones last, then by further columns."""
    place = F.array_position(F.array(*map(F.lit, groups)), F.col("pos"))
    return df.orderBy(F.when(place > 0, place).otherwise(len(groups) + 1), "pos", *then)


def output_order(board: DataFrame) -> DataFrame:
    """By method and overall rank, the id breaking ties."""
    return board.orderBy("avg_type", F.col("rank").asc_nulls_last(), "id")


def season_of(day: Column) -> Column:
    """January to March belong to the season before."""
    return F.year(day) - F.when(F.month(day) <= 3, 1).otherwise(0)


def slot_of(pick: Column, teams: int) -> Column:
    """Snake order: odd rounds run forward, even rounds back."""
    place = F.pmod(pick - 1, F.lit(teams)).cast("int")
    back = F.pmod(F.floor((pick - 1) / teams), F.lit(2)) == 1
    return F.when(back, teams - place).otherwise(place + 1)


def pick_label(pick: Column, teams: int) -> Column:
    return F.format_string("%d.%02d", (F.floor((pick - 1) / teams) + 1).cast("int"), (F.pmod(pick - 1, F.lit(teams)) + 1).cast("int"))


def latest_holder(picks: DataFrame) -> DataFrame:
    """Of picks(entity, manager, pick, ts) the last for each entity."""
    return picks.groupBy("entity").agg(F.max_by("manager", F.struct("ts", "pick")).alias("manager"), F.max("pick").alias("pick"))


def available(board: DataFrame, held: DataFrame) -> DataFrame:
    return board.join(held.select(F.col("entity").alias("id")), "id", "left_anti")


def best_by_group(board: DataFrame, value: str) -> DataFrame:
    """The best entity of every group, the least id of equals; an aggregation, no sort."""
    return board.groupBy("pos").agg(F.max_by("id", F.struct(value, -F.col("id"))).alias("id"), F.max(value).alias(value))


def waiting_cost(board: DataFrame, value: str, picks: int) -> DataFrame:
    """Best value now minus best value of the group once others took the `picks` best of the board.

    The board's top is a bounded sort-and-limit; only its `picks` ids meet the board again.
    """
    top = board.orderBy(F.col(value).desc(), "id").limit(picks).select("id", F.lit(True).alias("gone"))
    left = board.join(F.broadcast(top), "id", "left")
    return left.groupBy("pos").agg(F.max(value).alias("now"), F.max(F.when(F.col("gone").isNull(), F.col(value))).alias("later")).withColumn("cost", F.col("now") - F.col("later"))


def turn_costs(board: DataFrame, value: str, teams: int, rounds: int) -> DataFrame:
    """(slot, round, pick, until, pos, now, later, cost): what it costs a slot at each of its turns to leave a group for its next turn.

    Everybody takes the best of the board in value, the least id of equals, except the slot: it takes the best of another
    group at the turn itself. now is the group's best at `pick`, later at `until`, the slot's next turn (the pick after
    the last one if there is none); both are null where the group is used up. Only as many rows as there are picks can
    go, and of the others only the best of each group counts, so the board is cut to these; a table of (group, number
    of gone rows) then answers every turn by an equal join.
    """
    picks = teams * rounds
    known = board.filter(F.col(value).isNotNull() & F.col("pos").isNotNull()).select("id", "pos", F.col(value).alias("v"))
    top = staged(known.orderBy(F.col("v").desc(), "id").limit(picks + 1).withColumn("n", F.row_number().over(Window.orderBy(F.col("v").desc(), "id"))))  # one row a pick
    rest = known.join(F.broadcast(top.select("id", "pos")), ["id", "pos"], "left_anti").groupBy("pos").agg(F.max("v").alias("v")).withColumn("n", F.lit(picks + 2))
    rows = staged(top.select("pos", "n", "v").unionByName(rest.select("pos", "n", "v")))
    one = Window.partitionBy("pos").orderBy("n")  # picks + 2 rows at most
    since = F.coalesce(F.lag("n").over(one), F.lit(0)) + 1
    ahead = sized(rows.withColumn("since", since).withColumn("from", F.explode(F.sequence("since", "n"))).select("pos", "from", "v").filter(F.col("from") <= picks + 1))
    changes = top.withColumn("next", F.lead("pos").over(Window.orderBy("n")))
    # the end of a run of one group: from any of its rows on, the next row of another group comes after it
    ends = changes.filter("next is null or next <> pos").select("pos", F.col("n").alias("end"))
    runs = top.join(ends, "pos").filter("end >= n").groupBy("pos", "n").agg(F.min("end").alias("end"))
    slots = board.sparkSession.range(1, teams + 1).select(F.col("id").cast("int").alias("slot"))
    turns = picks_of(slots, teams, rounds)
    until = F.coalesce(F.lead("pick").over(Window.partitionBy("slot").orderBy("pick")), F.lit(picks + 1))
    turns = turns.withColumn("until", until).crossJoin(sized(rows.select("pos").distinct()))  # a row a turn and group is the result
    # if all rows up to the next turn are of the group, the slot's own pick is beyond them and one row more is left
    turns = turns.join(runs.select("pos", F.col("n").alias("pick"), "end"), ["pos", "pick"], "left")
    turns = turns.withColumn("gone", F.col("until") - F.when(F.col("end") >= F.col("until") - 1, 1).otherwise(0))
    out = turns.join(ahead.select("pos", F.col("from").alias("pick"), F.col("v").alias("now")), ["pos", "pick"], "left").join(ahead.select("pos", F.col("from").alias("gone"), F.col("v").alias("later")), ["pos", "gone"], "left")
    return out.select("slot", "round", "pick", "until", "pos", "now", "later", (F.col("now") - F.col("later")).alias("cost"))


def ranked_standings(teams: DataFrame, picks: DataFrame, slots: list[tuple[str, list[str]]]) -> DataFrame:
    """standings of every team of teams(team), those without picks too, with their place: most points first."""
    out = staged(teams.join(standings(picks, slots), "team", "left").fillna(0, ["points", "filled", "picks"]).withColumn("__all", F.lit(1)))
    places = ladder(out, "points", ["__all"]).select("points", (F.col("__above") + 1).cast("int").alias("place"))
    return out.drop("__all").join(places, "points").select(*[c for c in out.columns if c != "__all"], "place")


def standings(picks: DataFrame, slots: list[tuple[str, list[str]]]) -> DataFrame:
    """Points of the starters of every team in picks(team, pick, pos, points): each pick takes the first open slot
    that it is eligible for, in pick order, else the bench. A team's picks are bounded by the rounds of a draft."""
    eligible = F.array(*[F.array(*[F.lit(g) for g in groups]) for _, groups in slots])
    rows = picks.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("pick", "pos", "points"))).alias("p"))
    start = F.struct(F.transform(eligible, lambda e: F.lit(True)).alias("open"), F.lit(0.0).alias("points"), F.lit(0).alias("filled"))

    def place(acc: Column, pick: Column) -> Column:
        fits = F.transform(F.arrays_zip(acc["open"].alias("o"), eligible.alias("e")), lambda s: s["o"] & F.array_contains(s["e"], pick["pos"]))
        at = F.array_position(fits, True)
        return F.struct(
            F.transform(acc["open"], lambda o, i: o & (i + 1 != at)).alias("open"),
            (acc["points"] + F.when(at > 0, pick["points"]).otherwise(0.0)).alias("points"),
            (acc["filled"] + F.when(at > 0, 1).otherwise(0)).alias("filled"),
        )

    return rows.select("team", F.aggregate("p", start, place).alias("s"), F.size("p").alias("picks")).select("team", "s.points", "s.filled", "picks")
