"""Sanitising raw history rows: aliases, exclusion reasons, odds and shot annotations, lineage.

Input rows are all strings, with ``_columns`` (header of the source file), ``_source_file``,
``_season`` and ``_division``. A column that a file does not have is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions import odds
from touchline.functions.text import all_blank, clean, is_blank, parse_date, parse_number

LINEAGE = "transformaciones"
REASON = "motivo_exclusion"
META_COLUMNS = (
    "tiene_cierre_real", "tiene_tiros", "cuota_sospechosa", "overround", REASON, LINEAGE,
    "home_team_original", "away_team_original", "source_file", "season", "division",
)
INTERNAL = ("_columns",)
INTERNAL_META = ("_source_file", "_season", "_division", "_columns", "_line", "_file_id")


def source_columns(df: DataFrame) -> list[str]:
    """Columns that come from the files themselves."""
    return [
        c for c in df.columns
        if c not in INTERNAL_META and c not in META_COLUMNS and not c.startswith(("_", "market_move_"))
    ]


def _existing(df: DataFrame, names) -> list[Column]:
    present = set(df.columns)
    return [F.col(c) for c in names if c in present]


def is_empty_row(df: DataFrame) -> Column:
    return all_blank(_existing(df, source_columns(df)))


def has_complete_result(df: DataFrame) -> Column:
    present = set(df.columns)
    out = F.lit(True)
    for name in settings.REQUIRED_FIELDS:
        out = out & (~is_blank(F.col(name)) if name in present else F.lit(False))
    return out


def stats_in_schema() -> Column:
    """Does the header of the row's own file have any match statistics?"""
    return F.arrays_overlap("_columns", F.array(*[F.lit(c) for c in settings.MATCH_STAT_COLUMNS]))


def is_administrative(df: DataFrame) -> Column:
    """Full result, but statistics (present in the header) and odds all blank."""
    return (
        has_complete_result(df) & stats_in_schema()
        & all_blank(_existing(df, settings.MATCH_STAT_COLUMNS))
        & all_blank(_existing(df, settings.odds_columns()))
    )


def exclusion_reason(df: DataFrame) -> Column:
    opening = odds.odds_triplet(settings.OPEN_ODDS, df.columns)
    return (
        F.when(is_empty_row(df), "EMPTY_ROW")
        .when(is_administrative(df), "ADMINISTRATIVE_CANDIDATE")
        .when(opening.isNull(), "MISSING_REQUIRED_ODDS")
    )


def apply_aliases(df: DataFrame, aliases: Mapping[str, str] = settings.CLEAN_ALIASES) -> DataFrame:
    """Replace controlled aliases, keep the original per side and note it in the lineage."""
    usable = {k: v for k, v in aliases.items() if k not in settings.NEVER_MERGED}
    out = df
    for column, original in (("HomeTeam", "home_team_original"), ("AwayTeam", "away_team_original")):
        if not usable:
            out = out.withColumn(original, F.lit(None).cast("string"))
            continue
        table = F.create_map(*[F.lit(v) for pair in usable.items() for v in pair])
        name = clean(F.col(column))
        target = table[name]
        label = F.concat(F.lit("ALIAS_APPLIED:"), name, F.lit("->"), target)
        out = out.withColumns(
            {
                original: F.when(target.isNotNull(), name),
                LINEAGE: F.array_compact(F.array_append(LINEAGE, label)),
                column: F.coalesce(target, F.col(column)),
            }
        )
    return out


def annotate_odds(
    df: DataFrame, low: float = settings.OVERROUND_MIN, high: float = settings.OVERROUND_MAX
) -> DataFrame:
    """Real-close flag, overround, suspicious flag and market moves for kept rows."""
    kept = F.col(REASON).isNull()
    out = df.withColumns(
        {
            "_open": odds.odds_triplet(settings.OPEN_ODDS, df.columns),
            "_close": odds.odds_triplet(settings.EFFECTIVE_CLOSE_ODDS, df.columns),
            "_real": odds.odds_triplet(settings.REAL_CLOSE_ODDS, df.columns).isNotNull(),
        }
    )
    overround = odds.overround(F.col("_close"))
    out = out.withColumns(
        {
            "tiene_cierre_real": F.when(kept, F.col("_real")),
            "overround": F.when(kept, overround),
            "cuota_sospechosa": F.when(kept, F.coalesce(odds.is_suspicious(overround, low, high), F.lit(False))),
        }
    )
    moves = odds.market_move(F.col("_open"), F.col("_close"), F.col("_real"))
    out = out.withColumns({f"market_move_{s}": F.when(kept, m) for s, m in zip(("1", "x", "2"), moves)})
    labels = F.array_compact(
        F.array(
            F.when(kept & ~F.col("_real"), "MARKET_MOVE_AS_NAN_NO_REAL_CLOSE"),
            F.when(kept & F.col("cuota_sospechosa"), "ODDS_OVERROUND_OUT_OF_RANGE"),
        )
    )
    return out.withColumn(LINEAGE, F.concat(LINEAGE, labels)).drop("_open", "_close", "_real")


def has_shot_schema() -> Column:
    return F.size(F.array_except(F.array(*[F.lit(c) for c in settings.SHOT_COLUMNS]), "_columns")) == 0


def annotate_shots(df: DataFrame) -> DataFrame:
    kept = F.col(REASON).isNull()
    present = set(df.columns)
    filled = F.lit(True)
    for name in settings.SHOT_COLUMNS:
        filled = filled & (~is_blank(F.col(name)) if name in present else F.lit(False))
    schema_ok = has_shot_schema()
    label = F.when(kept & ~schema_ok, "SHOTS_SCHEMA_MISSING").when(kept & ~filled, "SHOTS_VALUES_INCOMPLETE")
    return df.withColumn("tiene_tiros", F.when(kept, schema_ok & filled)).withColumn(
        LINEAGE, F.array_compact(F.array_append(LINEAGE, label))
    )


def init_lineage(df: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    current = F.coalesce(F.col(LINEAGE), empty) if LINEAGE in df.columns else empty
    return df.withColumn(LINEAGE, current)


def sanitise(
    raw: DataFrame, low: float = settings.OVERROUND_MIN, high: float = settings.OVERROUND_MAX,
    aliases: Mapping[str, str] = settings.CLEAN_ALIASES,
) -> DataFrame:
    """Annotate every raw row; excluded rows carry a reason and no odds or shot columns.

    One projection over the scan: nothing here shuffles.
    """
    out = odds.with_parsed_odds(init_lineage(raw)).withColumns(
        {"source_file": F.col("_source_file"), "season": F.col("_season"), "division": F.col("_division")}
    )
    out = apply_aliases(out, aliases)
    out = out.withColumn(REASON, exclusion_reason(out))
    out = out.withColumn(
        LINEAGE, F.when(F.col(REASON).isNull(), F.col(LINEAGE)).otherwise(F.array_append(LINEAGE, F.concat(F.lit("EXCLUDED:"), F.col(REASON))))
    )
    return odds.without_parsed_odds(annotate_shots(annotate_odds(out, low, high)))


def sanitise_stats(rows: DataFrame) -> DataFrame:
    """One row of counts and shares over sanitised rows."""
    kept = F.col(REASON).isNull()
    aliased = F.exists(LINEAGE, lambda t: t.contains("ALIAS_APPLIED"))

    def share(name: str) -> Column:
        ratio = F.col(name) * 100.0 / F.nullif(F.col("output_rows"), F.lit(0))
        return F.coalesce(F.round(ratio, 2), F.lit(0.0)).alias(f"{name}_pct")

    counts = rows.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(kept).alias("output_rows"),
        F.count_if(~kept).alias("excluded_rows"),
        F.count_if(kept & F.col("tiene_cierre_real")).alias("has_real_close"),
        F.count_if(kept & F.col("tiene_tiros")).alias("has_shots"),
        F.count_if(kept & F.col("cuota_sospechosa")).alias("suspicious_odds"),
        F.count_if(kept & aliased).alias("alias_applied"),
    )
    return counts.select("*", share("has_real_close"), share("has_shots"))


def exclusion_counts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(REASON).isNotNull()).groupBy(F.col(REASON).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def kept_by_division_season(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(REASON).isNull()).groupBy("division", "season").agg(F.count(F.lit(1)).alias("rows"))


def breakdown(rows: DataFrame) -> DataFrame:
    """``kind, item, rows``: kept rows by division and season, excluded rows by reason, in one pass over the rows."""
    kept = F.col(REASON).isNull()
    place = [F.when(kept, F.col(c)).alias(c) for c in ("division", "season")]
    counts = rows.groupBy(F.col(REASON).alias("reason"), *place).agg(F.count(F.lit(1)).alias("rows"))
    kept = F.col("reason").isNull()
    return counts.select(
        F.when(kept, "kept").otherwise("excluded").alias("kind"), F.when(kept, F.concat_ws("/", "division", "season")).otherwise(F.col("reason")).alias("item"), "rows"
    )


def split_outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and excluded rows with published columns only, metadata first, lineage joined by ``|``."""
    rest = [c for c in rows.columns if c not in META_COLUMNS and c not in INTERNAL]
    published = rows.select(
        *[F.concat_ws("|", c).alias(c) if c == LINEAGE else F.col(c) for c in META_COLUMNS], *rest
    )
    return published.filter(F.col(REASON).isNull()), published.filter(F.col(REASON).isNotNull())


def typed_matches(raw: DataFrame) -> DataFrame:
    """Typed match table of the model: parsed, completed by odds preference, incomplete rows dropped."""
    present = set(raw.columns)

    def number(name: str) -> Column:
        return parse_number(F.col(name)) if name in present else F.lit(None).cast("double")

    close, opening = settings.EFFECTIVE_CLOSE_ODDS, settings.OPEN_ODDS
    goals = ("FTHG", "FTAG")
    read = odds.with_parsed_odds(raw, goals)
    goal = lambda c: F.col(f"{odds.PARSED}{c}") if c in present else F.lit(None).cast("double")
    division = F.col("_division")
    # Every text is read once, in a projection of its own: the rows below come from a generator, through which Spark neither moves
    # the filter nor merges the readings, which would work out each of them twice in one method too long for the JVM to compile.
    out = read.withColumn("_date", parse_date(F.col("Date"))).select(F.inline(F.array(F.struct(
        *[F.col(c) for c in ("match_id",) if c in present],
        F.col("_date").alias("date"),
        F.trim("HomeTeam").alias("home"), F.trim("AwayTeam").alias("away"),
        *[goal(c).alias(c) for c in goals],
        odds.normalise_result(F.col("FTR")).alias("result"),
        *[odds.first_valid_odds(close[s], read.columns).alias(f"odd_{s.lower()}") for s in settings.SIGNS],
        *[odds.first_valid_odds(opening[s], read.columns).alias(f"open_odd_{s.lower()}") for s in settings.SIGNS],
        *[F.col(c) for c in settings.SHOT_COLUMNS if c in present],
        division.alias("division"),
        F.when(division == "Primera", 0).when(division == "Segunda", 1).otherwise(-1).alias("division_code"),
        F.col("_season").alias("season"), F.col("_source_file").alias("source_file"),
    ))))
    required = [
        "date", "home", "away", "FTHG", "FTAG", "odd_1", "odd_x", "odd_2",
        "open_odd_1", "open_odd_x", "open_odd_2", "result",
    ]
    before, after = out.columns[:out.columns.index("open_odd_2") + 1], ("division", "division_code", "season", "source_file")
    return out.dropna(subset=required).select(
        *[F.col(c).cast("int").alias(c) if c in goals else F.col(c) for c in before],
        *[number(c).alias(c) for c in settings.SHOT_COLUMNS], *after,
    )


def require_known_divisions(rows: DataFrame, column: str = "division") -> DataFrame:
    """Fail on a division the model does not know."""
    known = F.col(column).isin(*settings.DIVISIONS)
    message = F.concat(F.lit("unknown division: "), F.coalesce(F.col(column), F.lit("NULL")))
    return rows.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(message)))
