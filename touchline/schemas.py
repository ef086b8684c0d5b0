"""Schemas and fixed column lists."""

from __future__ import annotations

from pyspark.sql import types as T

MATCH_ORDER = ("date", "division", "home", "away", "match_id")

MATCH_SCHEMA = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("home", T.StringType()),
        T.StructField("away", T.StringType()),
        T.StructField("division", T.StringType()),
        T.StructField("division_code", T.IntegerType()),
        T.StructField("season", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("FTHG", T.IntegerType()),
        T.StructField("FTAG", T.IntegerType()),
        T.StructField("result", T.StringType()),
        *[
            T.StructField(name, T.DoubleType())
            for name in (
                "odd_1", "odd_x", "odd_2", "open_odd_1", "open_odd_x", "open_odd_2",
                "HS", "AS", "HST", "AST", "home_xg", "away_xg",
            )
        ],
    ]
)

# Order and names of the published feature table.
FEATURE_TABLE_COLUMNS = (
    "date", "home", "away", "division", "division_code", "season", "source_file",
    "odd_1", "odd_x", "odd_2", "open_odd_1", "open_odd_x", "open_odd_2",
    "FTHG", "FTAG", "result",
    "home_form_pts_5", "away_form_pts_5", "home_gf_5", "home_ga_5", "away_gf_5", "away_ga_5",
    "home_home_pts_5", "away_away_pts_5", "home_elo", "away_elo", "elo_diff",
    "poisson_1", "poisson_x", "poisson_2", "lambda_home", "lambda_away",
    "home_shots_5", "away_shots_5", "home_shots_against_5", "away_shots_against_5",
    "home_sot_5", "away_sot_5", "home_sot_against_5", "away_sot_against_5",
    "home_table_pos", "away_table_pos", "table_pos_diff", "home_table_pj", "away_table_pj",
    "home_table_pts", "away_table_pts", "table_pts_diff",
    "home_table_ppg", "away_table_ppg", "table_ppg_diff",
    "home_table_gf", "away_table_gf", "home_table_ga", "away_table_ga",
    "home_table_gd", "away_table_gd", "table_gf_diff", "table_ga_diff", "table_gd_diff",
    "days_rest_home", "days_rest_away", "days_rest_diff",
    "market_1", "market_x", "market_2", "open_market_1", "open_market_x", "open_market_2",
    "form_pts_diff", "goal_for_diff", "goal_against_diff", "venue_form_diff",
    "shots_diff", "shots_against_diff", "sot_diff", "sot_against_diff",
    "home_xg_5", "away_xg_5", "home_xg_against_5", "away_xg_against_5",
    "xg_for_diff", "xg_against_diff",
    "market_move_1", "market_move_x", "market_move_2", "market_entropy", "close_open_fav_gap",
)

IDENTITY_COLUMNS = ("date", "home", "away", "division", "season", "source_file", "FTHG", "FTAG", "result")
XG_FEATURE_COLUMNS = (
    "home_xg_5", "away_xg_5", "home_xg_against_5", "away_xg_against_5", "xg_for_diff", "xg_against_diff",
)
# The model reads every feature that is neither an identity nor an xG column.
MODEL_COLUMNS = tuple(
    c for c in FEATURE_TABLE_COLUMNS if c not in IDENTITY_COLUMNS and c not in XG_FEATURE_COLUMNS
)
MARKET_COLUMNS = tuple(
    c for c in MODEL_COLUMNS
    if c.startswith(("odd_", "open_odd_", "market_", "open_market_")) or c == "close_open_fav_gap"
)

_percent = T.StructType([T.StructField(s, T.DoubleType()) for s in ("1", "X", "2")])
MATCHDAY_SCHEMA = T.StructType(
    [
        T.StructField("jornada", T.IntegerType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
        T.StructField("cierre", T.StringType()),
        T.StructField(
            "partidos",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("num", T.IntegerType()),
                        T.StructField("local", T.StringType()),
                        T.StructField("visitante", T.StringType()),
                        T.StructField("fuerza_local", T.DoubleType()),
                        T.StructField("fuerza_visitante", T.DoubleType()),
                        T.StructField(
                            "historico",
                            T.StructType(
                                [T.StructField(n, T.StringType()) for n in ("total", "1", "X", "2")]
                            ),
                        ),
                        T.StructField("sistema", T.StringType()),
                        T.StructField("comunidad", T.StringType()),
                        T.StructField("q15", _percent),
                        T.StructField("lae", _percent),
                        T.StructField("apu", _percent),
                        T.StructField(
                            "marcadores_q15",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("score", T.StringType()),
                                        T.StructField("pct", T.DoubleType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("fecha", T.StringType()),
                        T.StructField("hora", T.StringType()),
                        T.StructField("detalle", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

_side = T.StructType([T.StructField(n, T.DoubleType()) for n in ("pj", "g", "e", "p", "gf", "gc", "pts", "ppg")])
PRIOR_STATS_SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.DoubleType()) for n in ("pj", "g", "e", "p", "gf", "gc", "dg", "pts")],
        T.StructField("home", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("away", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("source_leagues", T.MapType(T.StringType(), T.LongType())),
        *[T.StructField(n, T.DoubleType()) for n in ("ppg", "gf_per_match", "gc_per_match")],
        T.StructField(
            "context",
            T.StructType(
                [
                    T.StructField("target_competition", T.StringType()),
                    T.StructField("status_2026_27", T.StringType()),
                    T.StructField("source_main_league", T.StringType()),
                    T.StructField("transition", T.StringType()),
                    T.StructField("transition_factor", T.DoubleType()),
                    T.StructField("raw_ppg", T.DoubleType()),
                    T.StructField("adjusted_ppg", T.DoubleType()),
                    T.StructField("confidence", T.StringType()),
                    T.StructField("note", T.StringType()),
                ]
            ),
        ),
    ]
)
PRIORS_SCHEMA = T.StructType(
    [
        T.StructField("season_target", T.StringType()),
        T.StructField("teams", T.MapType(T.StringType(), PRIOR_STATS_SCHEMA)),
        T.StructField("missing_or_partial", T.ArrayType(T.StringType())),
        T.StructField(
            "missing_data_strategy",
            T.StructType([T.StructField("teams", T.ArrayType(T.StringType()))]),
        ),
    ]
)
_roster_item = T.ArrayType(
    T.StructType([T.StructField("team", T.StringType()), T.StructField("status", T.StringType())])
)
ROSTER_SCHEMA = T.StructType(
    [
        T.StructField("season", T.StringType()),
        T.StructField("laliga_ea_sports", _roster_item),
        T.StructField("laliga_hypermotion", _roster_item),
    ]
)
NOTES_SCHEMA = T.StructType(
    [
        T.StructField(
            "maestra",
            T.ArrayType(
                T.StructType(
                    [T.StructField("p", T.IntegerType()), T.StructField("s", T.StringType()),
                     T.StructField("r", T.StringType())]
                )
            ),
        )
    ]
)
