"""Season priors: last season's statistics per team, category transitions, audit and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions.text import fold_name
from touchline.operators.feed_audit import normalise_league
from touchline.operators.findings import collect_findings, finding
from touchline.operators.names import resolve_with

# Comparability notes by transition.
TRANSITION_NOTES = {
    "misma_categoria": "Comparable de forma directa con equipos de la misma categoria.",
    "segunda_a_primera": "Ascendido: los datos brutos vienen de Segunda y se rebajan para Primera.",
    "primera_a_segunda": "Descendido: los datos brutos vienen de Primera y se recontextualizan para Segunda.",
    "primera_rfef_a_segunda": "Ascendido desde Primera RFEF: falta muestra local equivalente, usar con cautela.",
    "filial_primera_rfef_a_segunda":
        "Filial ascendido desde Primera RFEF: muestra no comparable y riesgo competitivo especial.",
    "sin_muestra": "Sin muestra suficiente en el dataset local.",
}
FULL_CONFIDENCE_MATCHES = 30
PRIOR_MATCHES = 3
ROSTER_SIZES = (20, 22)


def _per_match(total: Column, matches: Column) -> Column:
    return F.when(matches > 0, F.round(total / matches, 3))


def season_stats(results: DataFrame) -> DataFrame:
    """Statistics per team from finished matches (league, home, away, home_goals, away_goals).

    One aggregation with conditional sums per side; league counts come from a second small one.
    """
    gf_gc = [("home", "home_goals", "away_goals"), ("away", "away_goals", "home_goals")]
    rows = results.select(
        normalise_league(F.col("league")).alias("league"),
        F.inline(F.array(*[
            F.struct(F.lit(side).alias("side"), F.col(side).alias("team"),
                     F.col(gf).cast("bigint").alias("gf"), F.col(gc).cast("bigint").alias("gc"))
            for side, gf, gc in gf_gc
        ])),
    ).filter(F.col("team").isNotNull())
    points = F.when(F.col("gf") > F.col("gc"), 3).when(F.col("gf") == F.col("gc"), 1).otherwise(0)
    rows = rows.withColumn("pts", points)

    def block(keep: Column, prefix: str) -> list[Column]:
        def add(value: Column, name: str) -> Column:
            return F.coalesce(F.sum(F.when(keep, value)), F.lit(0)).cast("bigint").alias(f"{prefix}{name}")
        return [
            F.count_if(keep).alias(f"{prefix}pj"), F.count_if(keep & (F.col("pts") == 3)).alias(f"{prefix}g"),
            F.count_if(keep & (F.col("pts") == 1)).alias(f"{prefix}e"),
            F.count_if(keep & (F.col("pts") == 0)).alias(f"{prefix}p"),
            add(F.col("gf"), "gf"), add(F.col("gc"), "gc"), add(F.col("pts"), "pts"),
        ]

    stats = rows.groupBy("team").agg(
        *block(F.lit(True), ""), *block(F.col("side") == "home", "home_"), *block(F.col("side") == "away", "away_")
    )
    stats = stats.withColumn("dg", F.col("gf") - F.col("gc")).withColumns(
        {
            "ppg": _per_match(F.col("pts"), F.col("pj")),
            "gf_per_match": _per_match(F.col("gf"), F.col("pj")),
            "gc_per_match": _per_match(F.col("gc"), F.col("pj")),
            "home_ppg": _per_match(F.col("home_pts"), F.col("home_pj")),
            "away_ppg": _per_match(F.col("away_pts"), F.col("away_pj")),
        }
    )
    return stats.join(main_leagues(rows), "team", "left")


def main_leagues(rows: DataFrame) -> DataFrame:
    """League with most matches per team, the alphabetically first on a tie, and all counts."""
    counted = rows.groupBy("team", "league").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("team").orderBy(F.desc("n"), "league")
    return counted.withColumn("_r", F.row_number().over(rank)).groupBy("team").agg(
        F.max(F.when(F.col("_r") == 1, F.col("league"))).alias("source_main_league"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("league", "n")))).alias("source_leagues"),
    )


def transition(target: Column, status: Column, source: Column, played: Column) -> Column:
    none = F.coalesce(played, F.lit(0)) == 0
    return (
        F.when(none & (status == "ascendido_primera_rfef_filial"), "filial_primera_rfef_a_segunda")
        .when(none & (status == "ascendido_primera_rfef"), "primera_rfef_a_segunda")
        .when(none, "sin_muestra")
        .when((target == "La Liga") & (source == "Segunda Division"), "segunda_a_primera")
        .when((target == "Segunda Division") & (source == "La Liga"), "primera_a_segunda")
        .otherwise("misma_categoria")
    )


def transition_factor(key: Column) -> Column:
    known = [F.when(key == k, F.lit(v)) for k, v in settings.TRANSITION_FACTORS.items() if v is not None]
    return F.coalesce(*known)


def transition_note(key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in TRANSITION_NOTES.items()])


def confidence_tier(key: Column, played: Column) -> Column:
    return (
        F.when(key == "sin_muestra", "muy_baja")
        .when(key.isin("primera_rfef_a_segunda", "filial_primera_rfef_a_segunda"), "baja")
        .when(F.coalesce(played, F.lit(0)) < FULL_CONFIDENCE_MATCHES, "media")
        .when(key == "misma_categoria", "alta")
        .otherwise("media")
    )


def with_context(stats: DataFrame) -> DataFrame:
    """Transition, factor, raw and adjusted points per game, confidence and note.

    ``stats`` needs target_competition, status, source_main_league, pj and pts.
    """
    out = stats.withColumn(
        "transition",
        transition(F.col("target_competition"), F.col("status"), F.col("source_main_league"), F.col("pj")),
    )
    raw = _per_match(F.col("pts"), F.col("pj"))
    factor = transition_factor(F.col("transition"))
    return out.withColumns(
        {
            "transition_factor": factor, "raw_ppg": raw, "adjusted_ppg": F.round(raw * factor, 3),
            "confidence": confidence_tier(F.col("transition"), F.col("pj")),
            "note": transition_note(F.col("transition")),
        }
    )


def season_priors(results: DataFrame, roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """Priors of all roster teams: ``roster`` (team, target_competition, status), ``aliases`` (key, canonical)."""
    named = resolve_with(results, ["home", "away"], aliases, keep_unknown=False)
    out = roster.join(season_stats(named), "team", "left")
    counts = [c for c in out.columns if c in {"pj", "g", "e", "p", "gf", "gc", "pts", "dg"} or
              (c.startswith(("home_", "away_")) and not c.endswith("ppg"))]
    return with_context(out.fillna(0, counts))


def low_sample_teams(stats: DataFrame, matches: int = settings.LOW_SAMPLE_MATCHES) -> DataFrame:
    return stats.filter(F.coalesce(F.col("pj"), F.lit(0)) < matches).select("team", "pj")


# ---------------------------------------------------------------------------
# Use of the priors
# ---------------------------------------------------------------------------

def mix_prior(ppg: Column, played: Column, prior: Column) -> Column:
    """Prior weighted by the matches still missing to three; without prior the value stays."""
    weight = F.greatest(played, F.lit(0.0)) / PRIOR_MATCHES
    mixed = weight * F.coalesce(ppg, F.lit(0.0)) + (1.0 - weight) * prior
    return F.when((played < PRIOR_MATCHES) & prior.isNotNull(), mixed).otherwise(ppg)


def apply_transition_priors(features: DataFrame, priors: DataFrame) -> DataFrame:
    """Mix adjusted points per game into both sides of upcoming matches. ``priors``: (key, adjusted_ppg)."""
    out = features
    for side in ("home", "away"):
        known = priors.select(F.col("key").alias("_key"), F.col("adjusted_ppg").alias("_prior"))
        out = out.withColumn("_key", fold_name(F.col(side))).join(known, "_key", "left")
        mixed = mix_prior(F.col(f"{side}_table_ppg"), F.col(f"{side}_table_pj"), F.col("_prior"))
        out = out.withColumn(f"{side}_table_ppg", mixed).drop("_key", "_prior")
    return out.withColumn("table_ppg_diff", F.col("home_table_ppg") - F.col("away_table_ppg")).select(*features.columns)


def prior_keys(priors: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Lookup rows (key, team, context columns) by folded canonical name and folded alias."""
    own = priors.withColumn("key", fold_name(F.col("team")))
    if aliases is None:
        return own
    by_alias = priors.join(aliases.select("key", F.col("canonical").alias("team")), "team")
    return by_alias.unionByName(own.join(by_alias.select("key"), "key", "left_anti").select(*by_alias.columns))


def enrich_with_priors(matches: DataFrame, keys: DataFrame) -> DataFrame:
    """Add prior_local and prior_visitante structs to matchday rows."""
    out = matches
    fields = ("adjusted_ppg", "confidence", "transition", "note")
    for side in ("local", "visitante"):
        known = keys.select(F.col("key").alias("_key"), F.struct(*fields).alias(f"prior_{side}"))
        out = out.withColumn("_key", fold_name(F.trim(F.col(side)))).join(known, "_key", "left").drop("_key")
    return out


def prior_warnings(matches: DataFrame) -> DataFrame:
    """One row per side whose prior is weak or comes from another category."""
    sides = matches.select(
        "jornada", "num",
        F.inline(F.array(*[
            F.struct(F.col(s).alias("equipo"), F.col(f"prior_{s}").alias("prior")) for s in ("local", "visitante")
        ])),
    ).filter(F.col("prior").isNotNull())
    weak = F.coalesce(F.col("prior.confidence").isin("baja", "muy_baja"), F.lit(False))
    moved = ~F.col("prior.transition").eqNullSafe("misma_categoria")
    return sides.filter(weak | moved).select(
        "jornada", "num", "equipo", "prior.confidence", "prior.transition", "prior.adjusted_ppg"
    )


# ---------------------------------------------------------------------------
# Audit
# ---------------------------------------------------------------------------

def _differs(a: Column, b: Column) -> Column:
    near = F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    return F.coalesce(~near, F.lit(False))


def prior_facts(teams: DataFrame, roster: DataFrame) -> DataFrame:
    """Priors and roster side by side (full outer join) with every rule evaluated.

    ``teams``: (team, stats) as read from the priors file; ``roster``: (team, status).
    """
    s = F.col("stats")
    expected = F.round(s["context"]["raw_ppg"] * s["context"]["transition_factor"], 3)
    adjusted = s["context"]["adjusted_ppg"]

    def partial(side: str) -> Column:
        return F.coalesce(F.exists(F.map_values(s[side]), lambda v: v.isNull()), F.lit(False))

    rules = F.array_compact(
        F.array(
            F.when(_differs(s["pj"], s["g"] + s["e"] + s["p"]), "pj != g + e + p"),
            F.when(_differs(s["pts"], 3 * s["g"] + s["e"]), "pts != 3*g + e"),
            F.when(_differs(s["dg"], s["gf"] - s["gc"]), "dg != gf - gc"),
        )
    )
    confidence = F.nullif(F.trim(s["context"]["confidence"]), F.lit(""))
    prior_status = F.coalesce(s["context"]["status_2026_27"], F.lit(""))
    inspected = teams.select(
        "team", F.lit(True).alias("in_priors"), F.coalesce(confidence, F.lit("<missing>")).alias("confidence"),
        prior_status.alias("prior_status"), (partial("home") | partial("away")).alias("is_partial"),
        rules.alias("failed_rules"),
        (expected.isNotNull() & (adjusted.isNull() | (F.abs(adjusted - expected) > 1e-9))).alias("ppg_mismatch"),
        expected.alias("expected_ppg"), adjusted.alias("actual_ppg"),
    )
    listed = roster.groupBy("team").agg(F.max("status").alias("roster_status"), F.lit(True).alias("in_roster"))
    out = inspected.join(listed, "team", "full_outer")
    return out.withColumns(
        {
            "in_priors": F.coalesce("in_priors", F.lit(False)), "in_roster": F.coalesce("in_roster", F.lit(False)),
            "status_mismatch": F.coalesce(F.col("prior_status") != F.col("roster_status"), F.lit(False)),
        }
    )


def confidence_counts(facts: DataFrame) -> DataFrame:
    return facts.filter("in_priors").groupBy("confidence").agg(F.count(F.lit(1)).alias("teams"))


def prior_findings(
    facts: DataFrame, roster: DataFrame, seasons: DataFrame, listed: DataFrame, strategy: DataFrame
) -> DataFrame:
    """Findings of the priors. ``seasons``: one row (roster_season, prior_season); ``listed`` and
    ``strategy``: team names the priors file declares as partial and as covered by the strategy."""
    actual = facts.filter("is_partial").select("team")

    def gap(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        return left.distinct().join(right.distinct(), "team", "left_anti").agg(F.count(F.lit(1)).alias(name))

    sizes = roster.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("team").alias("unique"),
        F.count_if(F.col("target_competition") == "La Liga").alias("primera"),
        F.count_if(F.col("target_competition") == "Segunda Division").alias("segunda"),
    )
    repeated = roster.groupBy("team").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(
        F.count(F.lit(1)).alias("repeated")
    )
    counts = facts.agg(
        F.count_if("in_priors").alias("prior_teams"),
        F.count_if(F.col("in_roster") & ~F.col("in_priors")).alias("only_roster"),
        F.count_if(F.col("in_priors") & ~F.col("in_roster")).alias("only_priors"),
        F.count_if("status_mismatch").alias("status_mismatches"),
        F.count_if(F.size("failed_rules") > 0).alias("inconsistent"),
        F.count_if("ppg_mismatch").alias("ppg_mismatches"),
    )
    single = seasons
    for part in (
        sizes, repeated, counts,
        gap(actual, listed, "partial_not_listed"), gap(listed, actual, "listed_but_complete"),
        gap(actual, strategy, "strategy_missing"), gap(strategy, actual, "strategy_extra"),
    ):
        single = single.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")
    c = F.col
    primera, segunda = ROSTER_SIZES
    wrong_size = (
        (c("total") != primera + segunda) | (c("unique") != primera + segunda)
        | (c("primera") != primera) | (c("segunda") != segunda)
    )
    deviation = (
        F.abs(primera + segunda - c("unique")) + F.abs(primera - c("primera"))
        + F.abs(segunda - c("segunda")) + c("repeated")
    )
    return collect_findings(
        single,
        [
            finding("PRIOR_SEASON_MISMATCH", "critical",
                    F.when(~c("roster_season").eqNullSafe(c("prior_season")), 1), "Season of roster and priors differ."),
            finding("TEAMS_COUNT_INVALID", "critical",
                    F.when(wrong_size, F.greatest(F.lit(1), deviation)), "The roster is not 20 plus 22 teams.",
                    [c("total"), c("unique"), c("primera"), c("segunda")]),
            finding("PRIOR_TEAM_SET_MISMATCH", "critical", c("only_roster") + c("only_priors"),
                    "Teams of roster and priors differ.", [c("only_roster"), c("only_priors")]),
            finding("PRIOR_STATUS_MISMATCH", "warning", c("status_mismatches"), "Status of roster and priors differ."),
            finding("PRIOR_CONFIDENCE_LEVELS", "info", c("prior_teams"), "Declared confidence levels."),
            finding("PRIOR_PARTIAL_NOT_LISTED", "critical", c("partial_not_listed") + c("listed_but_complete"),
                    "Declared partial teams contradict the home and away splits.",
                    [c("partial_not_listed"), c("listed_but_complete")]),
            finding("PRIOR_STRATEGY_TEAM_MISMATCH", "warning",
                    F.when((c("strategy_missing") > 0) | (c("strategy_extra") > 0),
                           c("strategy_missing")
                           + c("strategy_extra")), "The strategy list differs from the partial teams.",
                    [c("strategy_missing"), c("strategy_extra")]),
            finding("PRIOR_INTERNAL_INCONSISTENCY", "warning", c("inconsistent"), "Totals contradict each other."),
            finding("PRIOR_ADJUSTED_PPG_MISMATCH", "warning", c("ppg_mismatches"),
                    "Adjusted points per game is not raw times factor."),
        ],
    )
