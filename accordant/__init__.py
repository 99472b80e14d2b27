"""Consensus analytics on Spark: every call takes DataFrames and returns DataFrames."""

from accordant.operators.attach import ownership, with_attributes, with_context, with_draft_value, with_holder, with_ranking
from accordant.operators.board import Fills, Inputs, Season, board_from_lines, build_board, consensus_table, impute_all, scored_lines
from accordant.operators.consensus import METHODS, consensus, one_method, source_table
from accordant.operators.identity import from_crosswalk, resolve
from accordant.operators.rank import over_replacement, rank_and_tier, spread_rank, uncertainty
from accordant.operators.scope import replacement_ranks, replacement_ranks_of_all, share_ranks, turn_costs
from accordant.operators.score import bracket, many_rule_points, points, rules_from_settings, season_bracket
from accordant.operators.settings import checked, format_labels, overridden
from accordant.sources.payloads import load_stat_lines
from accordant.sources.publish import publish, published
from accordant.streaming.live import Holders, overlay, read_picks

__all__ = [
    "METHODS", "Fills", "Holders", "Inputs", "Season", "board_from_lines", "bracket", "build_board", "checked", "consensus", "consensus_table", "format_labels", "from_crosswalk", "impute_all", "load_stat_lines", "many_rule_points", "one_method", "over_replacement",
    "overlay", "overridden", "ownership", "points", "publish", "published", "rank_and_tier", "read_picks", "replacement_ranks", "replacement_ranks_of_all", "resolve", "rules_from_settings", "scored_lines", "season_bracket", "share_ranks",
    "source_table", "spread_rank", "turn_costs", "uncertainty", "with_attributes", "with_context", "with_draft_value", "with_holder", "with_ranking",
]
