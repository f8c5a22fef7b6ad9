"""Closed vocabularies (fixed values)."""

SOURCE_KINDS = (
    "federation", "league", "club", "transfer_market", "statistics", "injury", "odds", "weather", "news",
    "historical", "synthetic",
)
TERMS_STATUSES = ("unreviewed", "reviewed_allowed", "licensed", "restricted", "prohibited")
PRODUCTION_TERMS = ("reviewed_allowed", "licensed")
VERIFICATION_STATES = ("raw", "corroborated", "verified", "rejected")
RUN_STATUSES = ("succeeded", "failed", "blocked")
FAILURE_KINDS = (
    "network", "rate_limit", "authentication", "parsing", "schema", "policy", "upstream", "unknown",
)
EVENT_TYPES = (
    "player.transferred", "player.injured", "player.returned", "player.suspended", "coach.changed",
    "lineup.confirmed", "match.finished",
)
COMPETITION_TYPES = ("league", "cup", "playoff")
ENTRY_TYPES = ("continuing", "promoted", "invited", "expansion", "other")
EXIT_TYPES = ("continuing", "relegated", "withdrew", "expelled", "other")
FIXTURE_STATUSES = ("scheduled", "postponed", "abandoned", "cancelled", "finished", "awarded")
SCORED_STATUSES = ("finished", "awarded")
UNPLAYED_STATUSES = ("scheduled", "postponed", "cancelled")
REVISION_KINDS = ("initial", "schedule_change", "status_change", "result_correction")
RANKING_RULES = (
    "points", "head_to_head_points", "head_to_head_goal_difference", "head_to_head_goals", "goal_difference",
    "goals_for", "playoff", "drawing_of_lots",
)
ENTITY_TYPES = ("player", "club", "coach", "competition")
RESOLUTION_STATUSES = ("matched", "ambiguous", "unmatched")
RESOLUTION_METHODS = ("exact", "fuzzy", "attribute", "manual", "none")
