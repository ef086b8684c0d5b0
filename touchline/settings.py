"""Fixed values and job settings. Values must stay equal to the published ones for right results."""

from __future__ import annotations

SIGNS = ("1", "X", "2")

# Rating and score model.
ELO_BASE = 1500.0
ELO_K = 24.0
ELO_HOME_ADVANTAGE = 55.0
ELO_SCALE = 400.0
GOAL_PER_SHOT_ON_TARGET = 0.30
RECENT_MATCHES = 5
MAX_GOALS = 7
DEFAULT_RHO = -0.036
RHO_STEPS = 41
RHO_MIN, RHO_MAX = -0.30, 0.10
MIN_ROWS_FOR_RHO = 200
FALLBACK_LAMBDAS = (1.45, 1.10)
FALLBACK_STRENGTH_LAMBDAS = (1.3, 1.1)
TINY = 1e-9

# Blend and doubles.
ACTIVE_WEIGHTS = {"logit": 0.0, "hgb": 0.049, "market": 0.951, "poisson": 0.0}
WEIGHT_CANDIDATES = (
    {"logit": 0.0, "hgb": 0.049, "market": 0.951, "poisson": 0.0},
    {"logit": 0.0, "hgb": 0.1, "market": 0.9, "poisson": 0.0},
    {"logit": 0.0, "hgb": 0.2, "market": 0.8, "poisson": 0.0},
    {"logit": 0.05, "hgb": 0.1, "market": 0.8, "poisson": 0.05},
)
DRAW_BOOST_CANDIDATES = (0.0,)
SEGUNDA_DRAW_BOOST_CANDIDATES = (0.0,)
DOUBLE_DRAW_WEIGHT_CANDIDATES = (0.7, 0.85)
DOUBLE_DISAGREEMENT_WEIGHT_CANDIDATES = (0.2,)
DOUBLE_SEGUNDA_BONUS_CANDIDATES = (0.0, 0.05)
DOUBLE_DRAW_THRESHOLD_CANDIDATES = (0.3,)
X_STRATEGY_CANDIDATES = ("none", "market_pick_only")
DOUBLES_SCORE_WEIGHT = 0.017
STABILITY_PENALTY = 0.5
TREE_SETTINGS = {"learning_rate": 0.06, "max_depth": 6, "rounds": 300, "min_leaf": 30}

# Decision rules of a matchday.
MARKET_ORDER = ("apu", "lae", "q15")
PUBLIC_ORDER = ("q15", "lae")
RISK_GAPS = (("bajo", 0.25), ("medio", 0.15), ("alto", 0.07))
RISK_OTHER = "extremo"
LABEL_LIMITS = {
    "logical_fixed_prob": 0.60, "logical_fixed_value": -0.10,
    "favorite_prob": 0.50, "favorite_overbet_value": -0.15,
    "trap_market_favorite_max": 0.50, "trap_public_favorite": 0.65,
    "hidden_draw_market": 0.28, "hidden_draw_public_max": 0.22,
    "visitor_value_market": 0.23, "visitor_value_public_max": 0.14,
    "triple_min": 0.25, "triple_max": 0.40,
}
PICK_LIMITS = {"second": 0.24, "value": 0.20}
BET_LIMITS = {"quality": 0.2, "confidence": 0.7, "gap": 0.25, "double_confidence": 0.5, "second": 0.25}
ALTERNATIVE_BUCKET_GAP = 0.10

# Ticket contract and estimated prizes in euros by exact hits.
TICKET_MATCHES = 14
BLOCK_SIZE = 15
DOUBLES = 3
COLUMNS_PER_TICKET = 8
PRICE_PER_COLUMN = 0.75
TICKET_COST = 6.0
PRIZES = {14: 40000.0, 13: 500.0, 12: 35.0, 11: 5.5, 10: 2.25}
PRIZE_SCENARIOS = {
    "facil": {14: 3250.0, 13: 45.0, 12: 6.0, 11: 1.5, 10: 0.0},
    "normal": {14: 40000.0, 13: 500.0, 12: 35.0, 11: 5.5, 10: 2.25},
    "dificil": {14: 150000.0, 13: 6000.0, 12: 500.0, 11: 45.0, 10: 10.0},
}
if 2 ** DOUBLES != COLUMNS_PER_TICKET or COLUMNS_PER_TICKET * PRICE_PER_COLUMN != TICKET_COST:
    raise ValueError("the ticket contract is inconsistent")

# Season sizes, overround limits and the carry-over of last season's points.
DIVISIONS = {"Primera": 0, "Segunda": 1}
EXPECTED_MATCHES = {"Primera": 380, "Segunda": 462}
OVERROUND_MIN, OVERROUND_MAX = 1.0, 1.4
TRANSITION_FACTORS = {
    "misma_categoria": 1.0,
    "segunda_a_primera": 0.78,
    "primera_a_segunda": 1.12,
    "primera_rfef_a_segunda": 0.70,
    "filial_primera_rfef_a_segunda": 0.66,
    "sin_muestra": None,
}
LOW_SAMPLE_MATCHES = 20

# Column names of the historical files, in order of preference.
OPEN_ODDS = {"1": ("AvgH", "B365H"), "X": ("AvgD", "B365D"), "2": ("AvgA", "B365A")}
REAL_CLOSE_ODDS = {"1": ("AvgCH", "B365CH"), "X": ("AvgCD", "B365CD"), "2": ("AvgCA", "B365CA")}
EFFECTIVE_CLOSE_ODDS = {
    "1": ("AvgCH", "AvgH", "B365CH", "B365H"),
    "X": ("AvgCD", "AvgD", "B365CD", "B365D"),
    "2": ("AvgCA", "AvgA", "B365CA", "B365A"),
}
MIN_ODDS = 1.01
SHOT_COLUMNS = ("HS", "AS", "HST", "AST")
MATCH_STAT_COLUMNS = ("HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR")
REQUIRED_FIELDS = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR")
CLEAN_ALIASES = {"Leonesa": "Cultural Leonesa"}
NEVER_MERGED = (
    "Barcelona B", "Real Madrid B", "Sevilla B", "Sociedad B", "Villarreal B", "Ath Bilbao B",
    "Celta", "Ceuta", "Murcia", "UCAM Murcia", "Lorca", "Mallorca",
)
XG_COLUMNS = ("home_xg", "away_xg", "home_xg_deep", "away_xg_deep", "home_ppda", "away_ppda")
XG_WINDOW_DAYS = 3


def odds_columns() -> list[str]:
    """Every odds column any of the three preference lists may read."""
    names = {
        column
        for table in (OPEN_ODDS, REAL_CLOSE_ODDS, EFFECTIVE_CLOSE_ODDS)
        for columns in table.values()
        for column in columns
    }
    return sorted(names)
