"""Audit of the results feed: status, goals, play-offs, duplicates, coverage, sign consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import normalise_result, result_from_goals
from touchline.functions.text import clean, fold_words, parse_date, parse_number
from touchline.operators.audit import duplicate_metrics
from touchline.operators.findings import collect_findings, finding, side_by_side
from touchline.session import stage

# League names of the feed and their regular matches.
EXPECTED_BY_LEAGUE = {"La Liga": 380, "Segunda Division": 462}


def is_playoff(round_name: Column) -> Column:
    name = F.replace(fold_words(F.coalesce(round_name, F.lit(""))), F.lit(" "), F.lit("-"))
    return name.contains("play-off") | name.contains("playoff") | name.contains("promotion")


def is_finished(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).startswith("finished")


def normalise_league(name: Column) -> Column:
    return F.replace(name, F.lit("División"), F.lit("Division"))


def feed_facts(feed: DataFrame) -> DataFrame:
    hg, ag = parse_number(F.col("home_goals")), parse_number(F.col("away_goals"))
    sign = normalise_result(F.col("sign"))
    status = clean(F.col("status"))
    return feed.withColumns(
        {
            "_status": F.when(status == "", "<empty>").otherwise(status),
            "_finished": is_finished(status), "_playoff": is_playoff(F.col("round")),
            "_league": clean(F.col("league_name")), "_season": clean(F.col("league_season")),
            "_no_goals": hg.isNull() | ag.isNull(),
            "_comparable": hg.isNotNull() & ag.isNotNull() & sign.isNotNull(),
            "_wrong_sign": F.coalesce(result_from_goals(hg, ag) != sign, F.lit(False)),
            "_date": parse_date(F.col("date")),
        }
    )


def status_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.col("_status").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_no_goals")).alias("without_goals"),
        F.first("_finished").alias("is_final"),
    )


def playoff_groups(facts: DataFrame) -> DataFrame:
    return facts.filter("_playoff").groupBy(F.col("_league").alias("league"), F.col("_season").alias("season")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def league_coverage(facts: DataFrame) -> DataFrame:
    league = normalise_league(F.col("league"))
    expected = F.coalesce(*[F.when(league == name, n) for name, n in EXPECTED_BY_LEAGUE.items()])
    counts = facts.groupBy(F.col("_league").alias("league"), F.col("_season").alias("season")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_finished").alias("finished"),
        F.count_if(~F.col("_finished")).alias("non_finished"), F.count_if("_playoff").alias("playoffs"),
        F.count_if(F.col("_finished") & ~F.col("_playoff")).alias("regular_finished"),
    )
    return counts.withColumn("expected_regular_matches", expected.cast("bigint")).withColumn(
        "regular_finished_gap", F.col("expected_regular_matches") - F.col("regular_finished")
    )


def feed_duplicates(facts: DataFrame) -> DataFrame:
    """One row per kind of duplicate: whole row, match id, logical key."""
    columns = [c for c in facts.columns if not c.startswith("_")]
    cells = [clean(F.col(c)) for c in columns]
    whole = facts.select(F.sha2(F.concat_ws("\u0001", *cells), 256).alias("digest"))
    ids = facts.select(clean(F.col("match_id")).alias("id")).filter("id <> ''")
    logical = facts.select(*[clean(F.col(c)).alias(c) for c in ("date", "home_name", "away_name")]).filter(
        "date <> '' and home_name <> '' and away_name <> ''"
    )
    parts = [
        duplicate_metrics(df, keys).withColumn("kind", F.lit(kind))
        for kind, df, keys in (
            ("exact", whole, ["digest"]), ("match_id", ids, ["id"]),
            ("logical", logical, ["date", "home_name", "away_name"]),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def feed_summary(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_finished")).alias("non_finished"),
        F.count_if("_no_goals").alias("without_goals"), F.count_if("_playoff").alias("playoffs"),
        F.count_if("_comparable").alias("comparable"), F.count_if("_wrong_sign").alias("sign_mismatches"),
        F.min("_date").alias("first_date"), F.max("_date").alias("last_date"),
        F.count_if(F.col("_date").isNull()).alias("invalid_dates"),
    )


def encoding_facts(files: DataFrame) -> DataFrame:
    """Encoding facts per file from (path, content): BOM, strict UTF-8, replacement characters."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    readable = F.when(valid, text).otherwise(F.make_valid_utf8(text))
    mark = F.lit("�")
    return files.select(
        "path", valid.alias("valid_utf8"),
        (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("has_utf8_bom"),
        ((F.length(readable) - F.length(F.replace(readable, mark, F.lit(""))))).cast("bigint").alias(
            "replacement_characters"
        ),
    )


def encoding_findings(encoding: DataFrame) -> DataFrame:
    one = F.lit(1)
    valid, bom = F.col("valid_utf8"), F.col("has_utf8_bom")
    return collect_findings(
        encoding,
        [
            finding("HIGHLIGHTLY_UTF8_INVALID", "critical", F.when(~valid, one), "Not strict UTF-8."),
            finding("HIGHLIGHTLY_UTF8_BOM_PRESENT", "info", F.when(valid & bom, one), "Valid UTF-8 with a BOM."),
            finding("HIGHLIGHTLY_UTF8_BOM_MISSING", "info", F.when(valid & ~bom, one), "Valid UTF-8 without a BOM."),
            finding("HIGHLIGHTLY_REPLACEMENT_CHARACTER", "warning", F.col("replacement_characters"),
                    "Replacement characters in the text."),
        ],
    )


def feed_findings(facts: DataFrame) -> DataFrame:
    """Content findings of the feed, from facts that are worked out once and written."""
    facts = stage(facts)
    named = {"groups": "groups", "rows_involved": "rows", "excess_rows": "excess"}
    wide = feed_duplicates(facts).agg(*[
        F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{name}") for kind in ("exact", "match_id", "logical") for c, name in named.items()
    ])
    coverage = league_coverage(facts).filter("regular_finished_gap <> 0").agg(F.count(F.lit(1)).alias("incomplete"))
    single = side_by_side([feed_summary(facts), wide, coverage])
    c = F.col

    def duplicate_details(kind: str) -> list[Column]:
        return [c(f"{kind}_groups").alias("groups"), c(f"{kind}_rows").alias("rows_involved"),
                c(f"{kind}_excess").alias("excess_rows")]

    return collect_findings(
        single,
        [
            finding("HIGHLIGHTLY_NON_FINISHED", "info", c("non_finished"), "Matches that are not final."),
            finding("HIGHLIGHTLY_GOALS_MISSING", "info", c("without_goals"), "Rows without both goals."),
            finding("HIGHLIGHTLY_PLAYOFF", "info", c("playoffs"), "Play-off rows kept apart from the league."),
            finding("HIGHLIGHTLY_EXACT_DUPLICATE", "warning", c("exact_rows"), "Repeated rows.",
                    duplicate_details("exact")),
            finding("HIGHLIGHTLY_MATCH_ID_DUPLICATE", "warning", c("match_id_rows"), "Repeated match ids.",
                    duplicate_details("match_id")),
            finding("HIGHLIGHTLY_LOGICAL_DUPLICATE", "warning", c("logical_excess"),
                    "Matches repeated by date and teams.", duplicate_details("logical")),
            finding("HIGHLIGHTLY_SEASON_INCOMPLETE", "warning", c("incomplete"),
                    "League seasons that miss finished regular matches."),
            finding("HIGHLIGHTLY_SIGN_MISMATCH", "warning", c("sign_mismatches"), "Sign contradicts the goals."),
        ],
    )


def season_feed(feed: DataFrame, season: str, leagues: tuple[str, ...] = ("La Liga", "Segunda División")) -> DataFrame:
    """Finished matches of the given leagues and season."""
    return feed.filter(
        (F.col("league_season").cast("string") == season) & F.col("league_name").isin(*leagues)
        & (F.col("status") == "Finished")
    )


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """Fail unless the frame has exactly the expected number of rows."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} matches, found {found}")
    return df
