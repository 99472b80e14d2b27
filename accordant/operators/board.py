"""The board: stat lines of several sources, filled, scored, combined by every method, ranked, and annotated."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.sources.stage import sized, staged

from . import attach, clean, consensus, impute, rank, scope, score

#: Metric -> the metric whose rate fills its gaps. Others are filled by the mean of the entity's sources.
RATE_RULES = {
    "pass_att": "pass_yds", "pass_comp": "pass_yds", "pass_tds": "pass_comp", "pass_int": "pass_att", "rush_att": "rush_yds", "rush_tds": "rush_yds", "rec": "rec_yds", "rec_tgt": "rec", "rec_tds": "rec_yds",
    "xp_att": "xp", "xp_miss": "xp", "fg_att": "fg", "fg_0019": "fg", "fg_2029": "fg", "fg_3039": "fg", "fg_4049": "fg", "fg_50": "fg", "fg_miss": "fg",
}


@dataclass
class Fills:
    """How gaps are filled: metric -> reference of its rate, metrics estimated from touches, points that stand for an entity's level."""

    rates: dict[str, str] = field(default_factory=lambda: dict(RATE_RULES))
    touches: dict[str, list[str]] = field(default_factory=lambda: {"fumbles_lost": ["rush_att", "rec"]})
    level: str = "site_pts"


def fill_order(metrics: list[str], rates: dict[str, str]) -> list[str]:
    """Metrics with those before them whose rates they need, so that a fill sees its reference filled."""
    out: list[str] = []

    def add(m: str, above: tuple[str, ...] = ()) -> None:
        if m in out or m in above:
            return
        if rates.get(m) in metrics:
            add(rates[m], (*above, m))
        out.append(m)

    for m in metrics:
        add(m)
    return out


def impute_all(lines: DataFrame, scored: list[str], fills: Fills | None = None) -> DataFrame:
    """lines with gaps of the scored metrics filled: by rate or mean of the entity's sources, rate of the group, rate per touch, and last by the median of the decile."""
    fills = fills or Fills()
    for metric in fill_order([m for m in scored if m in lines.columns], fills.rates):
        reference = fills.rates.get(metric)
        if metric == "fg_miss" and {"fg", "fg_att"} <= set(lines.columns):
            lines = impute.missed_kicks_fill(lines)
        elif reference in lines.columns:
            lines = impute.group_rate_fill(lines, metric, reference)
        else:
            lines = impute.mean_fill(lines, metric)
        touches = [c for c in fills.touches.get(metric, []) if c in lines.columns]
        if touches:
            lines = impute.touch_rate_fill(lines, metric, touches)
        if fills.level in lines.columns:
            lines = impute.decile_fill(lines, metric, fills.level)
    return lines


@dataclass
class Season:
    """What the lines of a season or week need beyond plain metrics; parts without a table or a model are left out.

    models: milestone -> (intercept, metric, slope), rollups: milestone -> nested milestones; games(id, games) of passers;
    brackets (up to, points) of the points that a defence allows, and spreads(id, intercept, slope) of these by game.
    """

    models: dict[str, tuple[float, str, float]] = field(default_factory=dict)
    rollups: dict[str, list[str]] = field(default_factory=dict)
    games: DataFrame | None = None
    brackets: list[tuple[float, float]] = field(default_factory=list)
    spreads: DataFrame | None = None
    weekly: bool = False
    kicker: str = "K"
    passer: str = "QB"
    defence: str = "DST"
    allowed: str = "dst_pts_allowed"


def kickers_reconciled(lines: DataFrame, kicker: str) -> DataFrame:
    """lines with the kicks of the kickers' lines reconciled, other groups as they are."""
    kicks = [c for c in lines.columns if c.startswith(("fg", "xp"))]
    if not kicks:
        return lines
    was = lines.withColumns({f"__was_{c}": F.col(c) for c in kicks})
    out = impute.reconcile_kicking(was)
    own = F.col("pos").eqNullSafe(F.lit(kicker))
    touched = [c for c in out.columns if c.startswith(("fg", "xp"))]
    out = out.withColumns({c: F.when(own, F.col(c)).otherwise(F.col(f"__was_{c}").cast("double") if c in kicks else F.lit(None).cast("double")) for c in touched})
    return out.drop(*[f"__was_{c}" for c in kicks])


def defence_points(lines: DataFrame, season: Season, points: str = "points") -> DataFrame:
    """lines with the bracket's points added to the defences' points: of the value itself in a week, of simulated games in a season.

    A defence without a value or, in a season, without a known spread has no points, so that it is left out.
    """
    if season.allowed not in lines.columns or not season.brackets:
        return lines
    allowed = F.col(season.allowed)
    other = ~F.col("pos").eqNullSafe(F.lit(season.defence))
    if season.weekly:
        lines = lines.filter(other | allowed.isNotNull())
        own = score.bracket(allowed, season.brackets)
    else:
        spreads = season.spreads.select("id", F.col("intercept").alias("__a"), F.col("slope").alias("__b"))
        lines = lines.join(sized(staged(spreads, "spreads")), "id", "left")
        # what a total is null without is known before it: a filter by the total would work it out twice
        lines = lines.filter(other | (allowed.isNotNull() & F.col("__a").isNotNull() & F.col("__b").isNotNull()))
        own = score.season_total(["id", "data_src"], allowed / SEASON_GAMES, F.col("__a") + F.col("__b") * (allowed / SEASON_GAMES), season.brackets)
    return lines.withColumn(points, F.when(F.col("pos") == season.defence, F.col(points) + own).otherwise(F.col(points))).drop("__a", "__b")


#: Games that a defence's season is played out over.
SEASON_GAMES = 17


def scored_lines(lines: DataFrame, rules: dict[str, float], overlays: dict[str, dict[str, float]] | None = None, fills: Fills | None = None, season: Season | None = None) -> DataFrame:
    """(id, pos, data_src, points) of lines: null ids out, NaN to null, gaps filled, points by base rules and overlays of groups.

    With a season, kickers are reconciled before the gaps are filled; milestones and first downs that rules score follow,
    and the defences' points get those of their bracket. Lines without points are left out then.
    """
    lines = clean.nan_to_null(lines.filter("id is not null"))
    overlays = overlays or {}
    used = [m for m in dict.fromkeys([*rules, *(m for own in overlays.values() for m in own)]) if rules.get(m) or any(own.get(m) for own in overlays.values())]
    if season is not None:
        lines = staged(kickers_reconciled(lines, season.kicker), "reconciled")
        used += [season.allowed] if season.allowed not in used else []
    lines = impute_all(lines, used, fills)
    if season is not None:
        lines = impute.linear_estimate(lines, {m: v for m, v in season.models.items() if m in used and v[1] in lines.columns}, season.rollups)
        scores = {pos: [m for m, v in (rules | overlays.get(pos, {})).items() if v] for pos in dict.fromkeys([season.passer, "QB", "RB", "WR", "TE"])}
        lines = impute.scored_first_downs(lines, scores, season.games, season.weekly, season.passer)
    points = score.points({m: v for m, v in rules.items() if m in lines.columns})
    for pos, own in overlays.items():
        points = F.when(F.col("pos") == pos, score.points({m: v for m, v in (rules | own).items() if m in lines.columns})).otherwise(points)
    if season is None:
        return lines.select("id", "pos", "data_src", points.alias("points"))
    return defence_points(lines.withColumn("points", points), season).select("id", "pos", "data_src", "points")


#: Digits of points and spreads, and of the bounds, that ranks are taken on: ranks of equal values don't hang on the last bit.
DIGITS, BOUND_DIGITS = 8, 7


def on_grid(table: DataFrame) -> DataFrame:
    grid = {c: F.round(c, DIGITS) for c in ("points", "sd_pts")} | {c: F.round(c, BOUND_DIGITS) for c in ("floor", "ceiling")}
    return table.withColumns(grid).filter("points > 0")


def consensus_table(scored: DataFrame, weights: DataFrame, baselines: DataFrame | None = None, thresholds: dict[str, float] | None = None, methods: tuple[str, ...] = tuple(consensus.METHODS)) -> DataFrame:
    """One row per entity and method: points, spread, bounds, ranks, tiers and value over replacement."""
    table = on_grid(consensus.consensus(scored, weights, methods))
    return ranked(staged(rank.rank_and_tier(table, rank.DEFAULT_THRESHOLDS if thresholds is None else thresholds), "consensus"), baselines)


def ranked(table: DataFrame, baselines: DataFrame | None) -> DataFrame:
    """table with values over replacement and the overall rank; only this is done again when baselines change."""
    if baselines is None:
        baselines = table.sparkSession.createDataFrame([], "pos string, baseline int")
    out = rank.over_replacement(table, baselines)
    out = out.withColumns({f"{c}_vor": F.round(f"{c}_vor", d) for c, d in (("points", DIGITS), ("floor", BOUND_DIGITS), ("ceiling", BOUND_DIGITS))})
    return rank.spread_rank(staged(out, "board"), "points_vor", ["avg_type"])


@dataclass
class Inputs:
    """Tables of a board beside its stat lines; None leaves a part out."""

    entities: DataFrame | None = None
    rankings: DataFrame | None = None
    draft_values: DataFrame | None = None
    crosswalk: DataFrame | None = None
    rosters: DataFrame | None = None
    order: str = "seq"
    teams: dict[str, str] = field(default_factory=dict)


def build_board(scored: DataFrame, weights: DataFrame, slots: list[tuple[str, list[str]]], teams: int, inputs: Inputs | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The whole board of a scope in two phases: default baselines first, those of the scope's slots then.

    Points, spreads and tiers are computed once and written; the second phase only ranks again.
    """
    inputs = inputs or Inputs()
    first = consensus_table(scored, weights, None, thresholds)
    baselines = scope.replacement_ranks(consensus.one_method(first), slots, teams)
    board = ranked(first.drop("points_vor", "floor_vor", "ceiling_vor", "rank"), baselines)
    if inputs.entities is not None:
        board = attach.with_attributes(board, inputs.entities)
    if inputs.rankings is not None:
        board = attach.with_ranking(board, inputs.rankings, inputs.order)
    else:
        board = board.withColumn("sd_ecr", F.lit(None).cast("double"))
    board = rank.uncertainty(board)
    if inputs.draft_values is not None:
        board = attach.with_draft_value(board, inputs.draft_values)
    if inputs.crosswalk is not None:
        board = attach.with_context(board, inputs.crosswalk, inputs.rosters, inputs.teams, inputs.order)
    return clean.preferred_first(board, ["avg_type", "rank", "id", "player", "pos", "team", "points"])


def board_from_lines(
    lines: DataFrame, rules: dict[str, float], weights: DataFrame, slots: list[tuple[str, list[str]]], teams: int, overlays: dict[str, dict[str, float]] | None = None, fills: Fills | None = None, season: Season | None = None, inputs: Inputs | None = None,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """From stat lines of all groups and sources to the annotated board: scored_lines, then build_board."""
    scored = staged(scored_lines(lines, rules, overlays, fills, season or Season()), "scored")
    return build_board(scored, weights, slots, teams, inputs, thresholds)
