"""Matches of the results feed that the history does not have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import fold_key
from touchline.operators.names import feed_key

KEY = ("day", "home_key", "away_key")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Rows with a unique key; a repeated key fails the job. Combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    message = F.concat(F.lit(f"duplicate {what}: "), F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys]))
    failure = F.raise_error(message).cast("boolean")
    return grouped.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(failure)).select(*df.columns)


def history_keys(history: DataFrame) -> DataFrame:
    return history.select(
        F.col("date").alias("day"), feed_key(F.col("home")).alias("home_key"), feed_key(F.col("away")).alias("away_key")
    )


def feed_keys(feed: DataFrame) -> DataFrame:
    return feed.withColumns(
        {
            "day": F.col("date").cast("date"),
            "home_key": fold_key(F.col("home_name")), "away_key": fold_key(F.col("away_name")),
        }
    )


def missing_matches(
    feed: DataFrame, history: DataFrame, season: str = "2025-2026", check_unique: bool = True
) -> DataFrame:
    """Feed rows without a history match on (day, home, away), as publishable rows."""
    known, offered = history_keys(history), feed_keys(feed)
    if check_unique:
        known = require_unique(known, KEY, "history match")
        offered = require_unique(offered, KEY, "feed match")
    absent = offered.join(known, list(KEY), "left_anti")
    hg, ag = F.col("home_goals").cast("int"), F.col("away_goals").cast("int")
    code = F.when(hg > ag, "H").when(hg < ag, "A").otherwise("D")
    return absent.select(
        F.col("match_id").cast("bigint").alias("match_id"), F.col("day").alias("date"),
        F.when(F.col("league_name") == "La Liga", "Primera").otherwise("Segunda").alias("division"),
        F.lit(season).alias("season"), "round", F.col("home_name").alias("home"), F.col("away_name").alias("away"),
        hg.alias("home_goals"), ag.alias("away_goals"), code.alias("result"), F.lit("Highlightly").alias("source"),
        F.lit(True).alias("missing_odds"), F.lit(True).alias("missing_shots"),
    )

