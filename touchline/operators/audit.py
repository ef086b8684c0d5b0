"""Audit of raw history files: per-file counters, duplicates, coverage and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions import odds
from touchline.functions.text import all_blank, clean, is_blank, parse_date, parse_number
from touchline.operators import cleaning
from touchline.operators.findings import collect_findings, finding, side_by_side
from touchline.operators.names import alias_candidates
from touchline.operators.ranks import exact_median
from touchline.session import stage

FILE = ("_source_file", "_division", "_season")


# ---------------------------------------------------------------------------
# Shared aggregates
# ---------------------------------------------------------------------------

def duplicate_metrics(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Groups of equal keys, rows in them and rows in excess, optionally per ``by``."""
    counted = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_involved"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("excess_rows"),
    )


def duplicate_examples(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Repeated keys with their rows, or with a report limit the first ``n`` in key order."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    return counted if n is None else counted.orderBy(*keys).limit(n)


def observed_distribution(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Minimum, median and maximum with six digits; ``exact=False`` takes the bounded sketch for the median instead."""
    known = df.filter(F.col(value).isNotNull())
    ends = [F.round(F.min(value), 6).alias("minimum"), F.round(F.max(value), 6).alias("maximum")]
    if not exact:
        middle = F.round(F.percentile_approx(value, 0.5, 10000), 6).alias("median")
        return known.groupBy(*by).agg(ends[0], middle, ends[1])
    # Written before the filter, which would carry all that the value comes from a second time, uncompiled; read twice.
    known = stage(df.select(*by, value)).filter(F.col(value).isNotNull())
    middle = exact_median(known, value, by).withColumnsRenamed({b: f"_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] or F.lit(True)  # without groups both sides are one row
    return known.groupBy(*by).agg(*ends).join(middle, same, "left").select(*by, "minimum", F.round("median", 6).alias("median"), "maximum")


def first_examples(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per group. The group limit keeps at most n rows per task and group."""
    frame = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(frame)).filter(F.col("_i") <= n).drop("_i")


# ---------------------------------------------------------------------------
# Row facts
# ---------------------------------------------------------------------------

def discard_reasons(date: Column, home: Column, away: Column, hg: Column, ag: Column, result: Column,
                    opening: Column, close: Column) -> Column:
    """All reasons why a row cannot be used, in order of priority."""
    return F.array_compact(
        F.array(
            F.when(date.isNull(), "INVALID_DATE"),
            F.when((home == "") | (away == ""), "MISSING_MATCH_IDENTITY"),
            F.when(hg.isNull() | ag.isNull(), "MISSING_GOALS"),
            F.when(result.isNull(), "MISSING_OR_INVALID_RESULT"),
            F.when(opening.isNull() | close.isNull(), "MISSING_REQUIRED_ODDS"),
        )
    )


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-12 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))


def row_facts(
    raw: DataFrame, low: float = settings.OVERROUND_MIN, high: float = settings.OVERROUND_MAX
) -> DataFrame:
    """Annotate every raw row with the facts all counters need. One projection, no shuffle."""
    if low >= high:
        raise ValueError("the lower overround limit must be below the upper one")
    raw = odds.with_parsed_odds(raw)
    columns = raw.columns
    facts = raw.withColumns(
        {
            "_empty": all_blank([F.col(c) for c in cleaning.source_columns(raw)]),
            "_date": parse_date(F.col("Date")),
            "_home": clean(F.col("HomeTeam")), "_away": clean(F.col("AwayTeam")),
            "_hg": parse_number(F.col("FTHG")), "_ag": parse_number(F.col("FTAG")),
            "_result": odds.normalise_result(F.col("FTR")),
            "_opening": odds.odds_triplet(settings.OPEN_ODDS, columns),
            "_close": odds.odds_triplet(settings.EFFECTIVE_CLOSE_ODDS, columns),
            "_real": odds.odds_triplet(settings.REAL_CLOSE_ODDS, columns),
        }
    )
    complete = (
        F.col("_date").isNotNull() & (F.col("_home") != "") & (F.col("_away") != "")
        & F.col("_hg").isNotNull() & F.col("_ag").isNotNull() & F.col("_result").isNotNull()
    )
    statless = (
        cleaning.stats_in_schema()
        & all_blank([F.col(c) for c in settings.MATCH_STAT_COLUMNS if c in columns])
        & all_blank([F.col(c) for c in settings.odds_columns() if c in columns])
    )
    filled = sum(
        ((~is_blank(F.col(c))).cast("int") for c in settings.SHOT_COLUMNS if c in columns), F.lit(0)
    )
    shot_schema = cleaning.has_shot_schema()
    live = ~F.col("_empty")
    same = F.lit(True)
    for field in ("one", "draw", "two"):
        same = same & _near(F.col("_opening")[field], F.col("_close")[field])
    reasons = discard_reasons(*[F.col(f"_{c}") for c in
                                ("date", "home", "away", "hg", "ag", "result", "opening", "close")])
    facts = facts.withColumns(
        {
            "_complete": live & complete,
            "_admin": live & complete & statless,
            "_reasons": F.when(live, reasons).otherwise(F.array(F.lit("EMPTY_ROW"))),
            "_mismatch": live & F.coalesce(
                odds.result_from_goals(F.col("_hg"), F.col("_ag")) != F.col("_result"), F.lit(False)
            ),
            "_comparable": live & F.col("_hg").isNotNull() & F.col("_ag").isNotNull() & F.col("_result").isNotNull(),
            "_shot_schema": shot_schema,
            "_shots": F.when(live & shot_schema, filled),
            "_equal": live & F.coalesce(same, F.lit(False)),
            "_overround": F.when(live, odds.overround(F.col("_close"))),
        }
    )
    return facts.withColumns(
        {
            "_usable": live & (F.size("_reasons") == 0),
            "_below": F.coalesce(F.col("_overround") < low, F.lit(False)),
            "_above": F.coalesce(F.col("_overround") > high, F.lit(False)),
        }
    )


_COUNTERS = {
    "raw": lambda: F.count(F.lit(1)),
    "empty": lambda: F.count_if(F.col("_empty")),
    "non_empty": lambda: F.count_if(~F.col("_empty")),
    "usable": lambda: F.count_if(F.col("_usable")),
    "discarded": lambda: F.count_if(~F.col("_usable")),
    "invalid_dates": lambda: F.count_if(~F.col("_empty") & F.col("_date").isNull()),
    "comparable_results": lambda: F.count_if(F.col("_comparable")),
    "result_mismatches": lambda: F.count_if(F.col("_mismatch")),
    "observed_matches": lambda: F.count_if(F.col("_complete")),
    "administrative": lambda: F.count_if(F.col("_admin")),
    "shot_rows_without_schema": lambda: F.count_if(~F.col("_empty") & ~F.col("_shot_schema")),
    "shot_rows_with_any_value": lambda: F.count_if(F.col("_shots") > 0),
    "shot_rows_with_all_values": lambda: F.count_if(F.col("_shots") == 4),
    "shot_missing_value_cells": lambda: F.coalesce(F.sum(4 - F.col("_shots")), F.lit(0)),
    "opening_available": lambda: F.count_if(~F.col("_empty") & F.col("_opening").isNotNull()),
    "effective_close_available": lambda: F.count_if(~F.col("_empty") & F.col("_close").isNotNull()),
    "real_close_available": lambda: F.count_if(~F.col("_empty") & F.col("_real").isNotNull()),
    "without_real_close": lambda: F.count_if(~F.col("_empty") & F.col("_real").isNull()),
    "equal_open_close": lambda: F.count_if(F.col("_equal")),
    "equal_without_real_close": lambda: F.count_if(F.col("_equal") & F.col("_real").isNull()),
    "equal_with_real_close": lambda: F.count_if(F.col("_equal") & F.col("_real").isNotNull()),
    "overround_rows": lambda: F.count("_overround"),
    "overround_low": lambda: F.count_if(F.col("_below")),
    "overround_high": lambda: F.count_if(F.col("_above")),
}
COUNTERS = tuple(_COUNTERS)


def file_counters(facts: DataFrame) -> DataFrame:
    """All counters of one file per row: a single aggregation with map-side combine."""
    return facts.groupBy(*FILE).agg(
        *[make().cast("bigint").alias(name) for name, make in _COUNTERS.items()],
        F.max("_shot_schema").alias("shot_schema_complete"),
    )


def totals(counters: DataFrame) -> DataFrame:
    """Grand totals over files."""
    return counters.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("shot_schema_complete")).alias("shot_files_complete_schema"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
    )


def reason_counts(facts: DataFrame, every: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Discard reasons: the first of each row, or with ``every`` all of them."""
    reason = F.explode("_reasons") if every else F.get("_reasons", F.lit(0))
    return facts.filter(~F.col("_usable")).select(*by, reason.alias("reason")).groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


def match_keys(facts: DataFrame) -> DataFrame:
    valid = ~F.col("_empty") & F.col("_date").isNotNull() & (F.col("_home") != "") & (F.col("_away") != "")
    return facts.filter(valid).select(
        F.col("_date").alias("date"), F.col("_home").alias("home"), F.col("_away").alias("away"),
        F.col("_season").alias("season"), *FILE[:1],
    )


def row_digest(facts: DataFrame) -> Column:
    """Digest of the trimmed cells that come from the file."""
    cells = [F.coalesce(F.trim(c), F.lit("")) for c in cleaning.source_columns(facts)]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def exact_duplicates(facts: DataFrame) -> DataFrame:
    """Duplicates of whole rows within a file, compared by a digest; ``_digest`` if the facts have it."""
    digest = F.col("_digest") if "_digest" in facts.columns else row_digest(facts)
    hashed = facts.select(*FILE[:1], digest.alias("digest"))
    return duplicate_metrics(hashed, ["digest"], FILE[:1]).agg(
        F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"),
        F.coalesce(F.sum("rows_involved"), F.lit(0)).alias("rows_involved"),
        F.coalesce(F.sum("excess_rows"), F.lit(0)).alias("excess_rows"),
    )


def season_coverage(counters: DataFrame) -> DataFrame:
    """Rows of each file against the matches its division should have."""
    expected = F.coalesce(*[F.when(F.col("_division") == d, n) for d, n in settings.EXPECTED_MATCHES.items()])
    gap = expected - F.col("usable")
    return counters.select(
        F.col("_source_file").alias("source_file"), F.col("_division").alias("division"),
        F.col("_season").alias("season"), expected.cast("bigint").alias("expected_regular_matches"),
        F.col("observed_matches").alias("observed_match_rows"), F.col("usable").alias("usable_rows"),
        F.col("administrative").alias("administrative_candidates"),
        (F.col("non_empty") - F.col("usable") - F.col("administrative")).alias("other_discarded_rows"),
        gap.alias("usable_gap"), (expected - F.col("observed_matches")).alias("observed_gap"),
        F.when(expected.isNotNull(), F.least(F.col("administrative"), F.greatest(gap, F.lit(0)))).alias(
            "gap_explained_by_administrative"
        ),
    )


def team_seasons(facts: DataFrame) -> DataFrame:
    keys = match_keys(facts)
    return keys.select("season", F.explode(F.array("home", "away")).alias("team")).distinct()


def history_findings(
    facts: DataFrame, low: float = settings.OVERROUND_MIN, high: float = settings.OVERROUND_MAX
) -> DataFrame:
    """Findings of all history files. Every input of a rule is a one-row aggregate.

    The facts are worked out once and written narrow, so each aggregate reads just its columns of that table.
    """
    facts = stage(facts.withColumn("_digest", row_digest(facts)).select(
        *FILE, "_digest", "_date", "_home", "_away", "_empty", "_usable", "_complete", "_admin", "_reasons", "_mismatch", "_comparable", "_shot_schema",
        "_shots", "_equal", "_overround", "_below", "_above",
        *[F.when(F.col(f"_{o}").isNotNull(), True).alias(f"_{o}") for o in ("opening", "close", "real")],
    ))
    counters = stage(file_counters(facts))  # one row a file
    exact = exact_duplicates(facts).select(
        F.col("groups").alias("exact_groups"), F.col("rows_involved").alias("exact_rows"),
        F.col("excess_rows").alias("exact_excess"),
    )
    keys = duplicate_metrics(match_keys(facts), ["date", "home", "away"]).select(
        F.col("groups").alias("key_groups"), F.col("rows_involved").alias("key_rows"),
        F.col("excess_rows").alias("key_excess"),
    )
    reasons = reason_counts(facts).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "rows")))).alias("primary_reasons")
    )
    incomplete = season_coverage(counters).filter(F.col("usable_gap") != 0).agg(
        F.count(F.lit(1)).alias("incomplete_seasons")
    )
    schemaless = counters.filter(~F.col("shot_schema_complete")).agg(
        F.count(F.lit(1)).alias("files_without_shots"),
        F.array_sort(F.collect_set("_source_file")).alias("affected_files"),
    )
    aliases = alias_candidates(stage(team_seasons(facts)), keep_overlapping=False).agg(
        F.count(F.lit(1)).alias("alias_pairs")
    )
    single = side_by_side([totals(counters), exact, keys, reasons, incomplete, schemaless, aliases])
    c = F.col
    missing_open = c("non_empty") - c("opening_available")
    missing_shots = c("non_empty") - c("shot_rows_without_schema") - c("shot_rows_with_all_values")
    outside = c("overround_low") + c("overround_high")
    limits = F.struct(F.lit(low).alias("minimum"), F.lit(high).alias("maximum")).alias("range")
    rules = [
        finding("EMPTY_ROWS", "info", c("empty"), "Completely blank rows."),
        finding("ROWS_DISCARDED", "warning", c("discarded"), "Rows that miss a required field.", [c("primary_reasons")]),
        finding("EXACT_DUPLICATE", "info", c("exact_rows"), "Rows repeated within a file.",
                [c("exact_groups").alias("groups"), c("exact_excess").alias("excess_rows")]),
        finding("MATCH_KEY_DUPLICATE", "warning", c("key_rows"), "Matches repeated by date and teams.",
                [c("key_groups").alias("groups"), c("key_excess").alias("excess_rows")]),
        finding("RESULT_GOALS_MISMATCH", "warning", c("result_mismatches"), "Result contradicts the goals."),
        finding("DATE_INVALID", "warning", c("invalid_dates"), "Dates that cannot be read."),
        finding("SHOTS_COLUMNS_MISSING", "critical", F.when(c("files_without_shots") > 0, F.greatest(
            c("shot_rows_without_schema"), F.lit(1))), "Files without shot columns.",
            [c("affected_files"), c("files_without_shots").alias("file_count")]),
        finding("SHOTS_VALUES_MISSING", "warning", missing_shots, "Shot columns with missing values.",
                [c("shot_missing_value_cells").alias("missing_cells")]),
        finding("ODDS_OPEN_MISSING", "warning", missing_open, "Rows without three opening odds."),
        finding("ODDS_NO_REAL_CLOSE", "critical", c("without_real_close"), "Rows without three real closing odds.",
                [c("equal_without_real_close").alias("equal_to_opening_via_fallback")]),
        finding("ODDS_OPEN_EQUALS_CLOSE_NO_REAL_CLOSE", "info", c("equal_without_real_close"),
                "Opening equals close because there is no real close.",
                [F.lit("ODDS_NO_REAL_CLOSE").alias("parent_code")]),
        finding("ODDS_OPEN_EQUALS_CLOSE_REAL", "info", c("equal_with_real_close"),
                "Opening equals a close that is really available."),
        finding("ODDS_OVERROUND_OUT_OF_RANGE", "warning", outside, "Overround outside the configured range.",
                [c("overround_low").alias("below"), c("overround_high").alias("above"), limits]),
        finding("SEASON_INCOMPLETE", "warning", c("incomplete_seasons"), "Seasons that miss usable matches."),
        finding("ADMINISTRATIVE_MATCH_CANDIDATE", "warning", c("administrative"),
                "Full results without statistics and odds."),
        finding("ALIAS_CANDIDATE", "info", c("alias_pairs"), "Similar names that never share a season."),
    ]
    return collect_findings(single, rules)
