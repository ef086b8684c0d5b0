"""Data jobs: sanitising, audit, priors, missing matches and the matchday package."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions.text import infer_season
from touchline.operators import (
    audit, blend, cleaning, feed_audit, features, findings, matchday, missing, models, names, priors, xg,
)
from touchline.operators.models import LogitModel, TreesModel, VectorScaling
from touchline.sources import readers, writers


def with_row_key(rows: DataFrame) -> DataFrame:
    """Adds ``match_id``, a key of its own for every row: the match and the row's number among equal matches."""
    match = [F.col(c) for c in ("date", "division", "home", "away", "source_file")]
    content = F.xxhash64(*[F.col(c) for c in rows.columns])
    number = F.row_number().over(Window.partitionBy(*match).orderBy(content))
    return rows.withColumn("match_id", F.xxhash64(*match, number))


def load_history(spark: SparkSession, base: str, xg_path: str | None = None, clean: bool = False) -> DataFrame:
    """Typed match table with canonical names and xG columns, from original or sanitised files."""
    raw = readers.read_clean_history(spark, base) if clean else readers.read_raw_history(spark, base)
    typed = cleaning.require_known_divisions(cleaning.typed_matches(raw))
    typed = names.resolve_names(typed, ["home", "away"])
    typed = with_row_key(typed)
    return xg.merge_xg(typed, readers.read_xg(spark, xg_path) if xg_path else None)


def sanitise_history(spark: SparkSession, base: str, out: str | None = None) -> DataFrame:
    """Sanitised rows; written to ``out`` only when it is given."""
    rows = cleaning.sanitise(readers.read_raw_history(spark, base))
    if out is not None:
        rows = rows.persist()
        try:
            writers.write_sanitised(rows, out)
        finally:
            rows.unpersist()
    return rows


def audit_datasets(
    spark: SparkSession, history: str, feed: str, roster: str, prior_file: str
) -> tuple[DataFrame, DataFrame]:
    """Findings of the three data families and their number by severity."""
    facts = audit.row_facts(readers.read_raw_history(spark, history))
    encoding = feed_audit.encoding_facts(readers.read_bytes(spark, feed))
    listed_roster = readers.read_roster(spark, roster)
    prior_rows = readers.read_priors(spark, prior_file)
    listed, strategy = readers.read_prior_lists(spark, prior_file)
    seasons = listed_roster.agg(F.max("season").alias("roster_season"), F.lit(1).alias("_one")).join(
        prior_rows.agg(F.max("season_target").alias("prior_season"), F.lit(1).alias("_one")), "_one"
    ).drop("_one")
    prior_facts = priors.prior_facts(prior_rows.select("team", "stats"), listed_roster)
    everything = findings.union_findings(
        [
            audit.history_findings(facts), feed_audit.encoding_findings(encoding),
            feed_audit.feed_findings(feed_audit.feed_facts(readers.read_feed(spark, feed))),
            priors.prior_findings(prior_facts, listed_roster, seasons, listed, strategy),
        ]
    )
    return everything, findings.severity_summary(everything)


def prepare_priors(spark: SparkSession, feed: str, roster: str, season: str) -> DataFrame:
    """Season priors of every roster team from last season's finished matches."""
    leagues = ("La Liga", "Segunda Division")
    rows = readers.read_feed(spark, feed).filter(
        (F.col("league_season") == season) & (F.col("status") == "Finished")
        & feed_audit.normalise_league(F.col("league_name")).isin(*leagues)
    )
    results = rows.select(
        F.col("league_name").alias("league"), F.col("home_name").alias("home"), F.col("away_name").alias("away"),
        F.col("home_goals").try_cast("int").alias("home_goals"), F.col("away_goals").try_cast("int").alias("away_goals"),
    ).dropna(subset=["home_goals", "away_goals"])
    aliases = names.alias_table(spark, names.ROSTER_NAMES)
    return priors.season_priors(results, readers.read_roster(spark, roster).drop("season"), aliases)


def prepare_missing(spark: SparkSession, feed: str, history: DataFrame, season: str, expected: int) -> DataFrame:
    """Feed matches of a season that the history lacks; the feed must have the expected size."""
    rows = feed_audit.require_rows(feed_audit.season_feed(readers.read_feed(spark, feed), season), expected)
    return missing.missing_matches(rows, history)


def predict_matchday(
    upcoming: DataFrame, history: DataFrame, cutoff: str, logit: LogitModel, trees: TreesModel, config: Mapping,
    calibrator: VectorScaling | None = None, prior_keys: DataFrame | None = None, pool: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of matches 1 to 14 and the score forecast of match 15.

    ``upcoming``: jornada, num, match_id, home, away, date and optional odds.
    """
    rows = features.upcoming_features(upcoming, history, cutoff, pool, keep=["jornada"])
    if prior_keys is not None:
        rows = priors.apply_transition_priors(rows, prior_keys)
    main = rows.filter(F.col("num") != settings.BLOCK_SIZE)
    scored = blend.with_market_baseline(models.score_sources(main, logit, trees))
    scored = blend.apply_config(scored, config, "modelo")
    if calibrator is not None:
        columns = [f"modelo_prob_{s}" for s in models.PROBS]
        scored = calibrator.transform(scored, columns, columns)
        scored = scored.withColumn("modelo_pred", blend.pick(*[F.col(c) for c in columns], F.lit(None), "none"))
    last = rows.filter(F.col("num") == settings.BLOCK_SIZE)
    return (
        matchday.prediction_contract(scored),
        matchday.predict_score_match(last, models.league_mean_goals(history, cutoff)),
    )


def upcoming_from_matchdays(rows: DataFrame) -> DataFrame:
    """Matchday rows as upcoming matches; percentages of other sources are never used as odds."""
    date = F.to_date("fecha")
    return rows.select(
        "jornada", "num", (F.col("jornada").cast("bigint") * 100 + F.col("num")).alias("match_id"),
        F.col("local").alias("home"), F.col("visitante").alias("away"), date.alias("date"),
        F.when(date.isNotNull(), infer_season(date)).alias("season"),
    )


def matchday_package(
    rows: DataFrame, predictions: DataFrame, prior_keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enriched matches, summary per matchday and optimised ticket per matchday."""
    out = matchday.diagnose(rows)
    if prior_keys is not None:
        out = priors.enrich_with_priors(out, prior_keys)
    out = matchday.with_recommendation(matchday.integrate_predictions(out, predictions))
    tickets, _ = matchday.optimise_matchdays(out, override="modelo_probs")
    return out, matchday.package_summary(out), tickets
