"""Matchday rows: diagnosis, data quality, model integration, recommendations, contract, summary.

Rows are keyed by (jornada, num); any number of matchdays runs in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions import odds
from touchline.functions import probability as pr
from touchline.functions import scores as sc
from touchline.functions.text import fold_name, repair_mojibake
from touchline.operators import tickets as ticket_ops

KEY = ("jornada", "num")
SCORE_MATCH = settings.BLOCK_SIZE


# ---------------------------------------------------------------------------
# Diagnosis
# ---------------------------------------------------------------------------

def first_source(order: Sequence[str]) -> tuple[Column, Column]:
    """Name and probabilities of the first complete percentage source."""
    probs = [(name, odds.percent_to_probs(F.col(name))) for name in order]
    return (
        F.coalesce(*[F.when(p.isNotNull(), n) for n, p in probs]),
        F.coalesce(*[p for _, p in probs]),
    )


def risk_band(gap: Column) -> Column:
    bands = [F.when(gap >= limit, name) for name, limit in settings.RISK_GAPS]
    return F.when(gap.isNotNull(), F.coalesce(*bands, F.lit(settings.RISK_OTHER)))


_MARKET, _PUBLIC, _VALUE = ("_m1", "_mx", "_m2"), ("_u1", "_ux", "_u2"), ("_v1", "_vx", "_v2")


def _with_ranking(df: DataFrame) -> DataFrame:
    """Scalars of the ranking, each in its own column: favourite, second sign, best and next value."""
    market, public, value = ([F.col(c) for c in names] for names in (_MARKET, _PUBLIC, _VALUE))
    out = df.withColumns(
        {n: F.col("market")[i] for i, n in enumerate(_MARKET)} | {n: F.col("public")[i] for i, n in enumerate(_PUBLIC)}
    )
    out = out.withColumns({n: m - u for n, m, u in zip(_VALUE, market, public)})
    fav, second = pr.top_two(*market)
    best, following = pr.top_two(*value)
    out = out.withColumns({"_fav": fav, "_second": second, "_best": best, "_next": following})
    return out.withColumns(
        {
            "_fav_p": pr.value_of(F.col("_fav"), market), "_second_p": pr.value_of(F.col("_second"), market),
            "_fav_value": pr.value_of(F.col("_fav"), value), "_fav_public": pr.value_of(F.col("_fav"), public),
            "_best_p": pr.value_of(F.col("_best"), market),
        }
    )


def _rules() -> dict[str, Column]:
    """Label rules over the ranking columns, in the order labels are listed."""
    k = settings.LABEL_LIMITS
    c = F.col
    balanced = F.lit(True)
    for name in _MARKET:
        balanced = balanced & c(name).between(k["triple_min"], k["triple_max"])
    return {
        "fijo logico": (c("_fav_p") >= k["logical_fixed_prob"]) & (c("_fav_value") > k["logical_fixed_value"]),
        "favorito sobreapostado": (c("_fav_p") >= k["favorite_prob"]) & (c("_fav_value") <= k["favorite_overbet_value"]),
        "partido trampa": (c("_fav_p") < k["trap_market_favorite_max"]) & (c("_fav_public") > k["trap_public_favorite"]),
        "empate oculto": (c("_mx") >= k["hidden_draw_market"]) & (c("_ux") <= k["hidden_draw_public_max"]),
        "visitante de valor": (c("_m2") >= k["visitor_value_market"]) & (c("_u2") <= k["visitor_value_public_max"]),
        "triple candidato": balanced,
    }


def _with_labels(df: DataFrame) -> DataFrame:
    """Labels of a match; a fallback label when no rule fires."""
    flags = {f"_rule{i}": rule for i, rule in enumerate(_rules().values())}
    out = df.withColumns(flags)
    labels = F.array_compact(F.array(*[F.when(F.col(f), name) for f, name in zip(flags, _rules())]))
    fired = F.lit(False)
    for f in flags:
        fired = fired | F.col(f)
    fallback = F.when(F.col("_fav_p") >= settings.LABEL_LIMITS["favorite_prob"], "favorito razonable").otherwise("partido abierto")
    return out.withColumn("etiquetas", F.when(fired, labels).when(~fired, F.array(fallback)))


def _pick_columns() -> dict[str, Column]:
    """Conservative, balanced and aggressive picks of a labelled match."""
    c = F.col
    contested, hidden, triple = c("_rule1") | c("_rule2"), c("_rule3"), c("_rule5")
    fav, best = c("_fav"), c("_best")
    with_second, with_draw = pr.play(fav, c("_second")), pr.play(fav, F.lit("X"))
    lim = settings.PICK_LIMITS
    return {
        "conservadora": F.when(contested, with_second).when(triple | hidden, with_draw).otherwise(fav),
        "equilibrada": F.when(contested, pr.play(best, c("_next"))).when(triple, "1X2").when(hidden, with_draw)
        .otherwise(F.when(c("_second_p") >= lim["second"], with_second).otherwise(fav)),
        "agresiva": F.when(contested | triple, best).when(hidden, "X")
        .otherwise(F.when((best != fav) & (c("_best_p") >= lim["value"]), best).otherwise(fav)),
    }


def diagnose(matches: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Diagnosis of matchday rows with q15, lae and apu percentages.

    Match 15 only gets its most quoted scores; a match without sources is marked as such.
    ``notes``: optional analyst notes (jornada, num, signo, razon).
    """
    source, market = first_source(settings.MARKET_ORDER)
    _, public = first_source(settings.PUBLIC_ORDER)
    is_score = F.col("num") == SCORE_MATCH
    out = matches.withColumns(
        {
            "local": repair_mojibake(F.col("local")), "visitante": repair_mojibake(F.col("visitante")),
            "fuente_modelo": F.when(~is_score, source), "market": F.when(~is_score, market),
            "public": F.when(~is_score, public),
        }
    )
    ready = F.col("market").isNotNull() & F.col("public").isNotNull()
    out = out.withColumn("_ready", ready).withColumn(
        "diagnostico", F.when(~is_score & ~F.col("_ready"), "sin probabilidades suficientes")
    )
    out = _with_labels(_with_ranking(out))
    ready, gap = F.col("_ready"), F.col("_fav_p") - F.col("_second_p")
    out = out.withColumns(
        {
            "etiquetas": F.when(ready, F.col("etiquetas")), "riesgo": F.when(ready, risk_band(gap)),
            "gap_primero_segundo": F.when(ready, F.round(gap, 4)),
            "valor": F.when(ready, F.array(*[F.round(v, 4) for v in _VALUE])),
            **{name: F.when(ready, value) for name, value in _pick_columns().items()},
        }
    )
    if "marcadores_q15" in matches.columns:
        none = F.array().cast(matches.schema["marcadores_q15"].dataType)
        out = out.withColumn("top_marcadores", F.when(is_score, F.slice(F.coalesce("marcadores_q15", none), 1, 5)))
    if notes is not None:
        out = out.join(notes.select(*KEY, F.struct("signo", "razon").alias("maestra")), list(KEY), "left")
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def label_counts(diagnosed: DataFrame) -> DataFrame:
    # The outer form keeps the long label expression from being copied into an inferred filter.
    rows = diagnosed.select("jornada", F.explode_outer("etiquetas").alias("etiqueta")).filter(F.col("etiqueta").isNotNull())
    return rows.groupBy("jornada", "etiqueta").agg(
        F.count(F.lit(1)).alias("partidos")
    )


# ---------------------------------------------------------------------------
# Model predictions
# ---------------------------------------------------------------------------

# Penalty and warning of each missing input.
QUALITY_RULES = (
    ("sin_cuotas_mercado", 0.30), ("sin_partidos_local", 0.20), ("sin_partidos_visitante", 0.20),
    ("equipos_sin_elo", 0.15), ("sin_forma_local", 0.10),
)


def with_data_quality(features: DataFrame) -> DataFrame:
    """Warnings and quality score (1 minus penalties, two digits, never below 0)."""
    base = settings.ELO_BASE
    failed = {
        "sin_cuotas_mercado": F.col("odd_1").isNull() | F.col("market_1").isNull(),
        "sin_partidos_local": F.coalesce("home_table_pj", F.lit(0.0)) == 0,
        "sin_partidos_visitante": F.coalesce("away_table_pj", F.lit(0.0)) == 0,
        "equipos_sin_elo": (F.coalesce("home_elo", F.lit(base)) == base) & (F.coalesce("away_elo", F.lit(base)) == base),
        "sin_forma_local": F.col("home_form_pts_5").isNull(),
    }
    warnings = F.array_compact(F.array(*[F.when(failed[n], n) for n, _ in QUALITY_RULES]))
    score = F.lit(1.0)
    for name, penalty in QUALITY_RULES:
        score = score - F.when(failed[name], penalty).otherwise(0.0)
    return features.withColumns({"avisos": warnings, "calidad_datos": F.round(F.greatest(score, F.lit(0.0)), 2)})


def prediction_contract(features: DataFrame, prefix: str = "modelo") -> DataFrame:
    """Published prediction of upcoming matches with probabilities, pick, confidence and quality."""
    p = [F.round(F.col(f"{prefix}_prob_{s}"), 4) for s in ("1", "x", "2")]
    return with_data_quality(features).withColumns(
        {
            **{f"prob_{s}": v for s, v in zip(("1", "x", "2"), p)},
            "signo_modelo": F.col(f"{prefix}_pred"), "confianza": pr.entropy_confidence(*p),
            "tiene_cuotas": F.col("odd_1").isNotNull(),
        }
    ).select(
        *[c for c in KEY if c in features.columns], "home", "away", "date", "division", "prob_1", "prob_x", "prob_2",
        "signo_modelo", "confianza", "avisos", "calidad_datos", F.round("home_elo", 1).alias("home_elo"),
        F.round("away_elo", 1).alias("away_elo"), "home_table_pj", "away_table_pj",
        F.round("home_form_pts_5", 2).alias("home_form_pts_5"), F.round("away_form_pts_5", 2).alias("away_form_pts_5"),
        "tiene_cuotas",
    )


def predict_score_match(
    features: DataFrame, means: DataFrame, rho: float = settings.DEFAULT_RHO, max_goals: int = settings.MAX_GOALS
) -> DataFrame:
    """Score forecast by goal buckets for match 15 rows of the feature table.

    ``means``: one row (mean_home, mean_away) that stands in for teams without history.
    """
    out = features.withColumn("_one", F.lit(1)).join(means.withColumn("_one", F.lit(1)), "_one").drop("_one")
    no_home, no_away = F.col("lambda_home").isNull(), F.col("lambda_away").isNull()
    source = (
        F.when(no_home & no_away, "media_liga").when(no_home | no_away, "parcial_media_liga").otherwise("features_equipo")
    )
    out = with_data_quality(out.withColumn("lambdas_fuente", source))
    out = out.withColumns(
        {"lambda_home": F.coalesce("lambda_home", "mean_home"), "lambda_away": F.coalesce("lambda_away", "mean_away")}
    )
    out = sc.with_score_cells(out, rho, max_goals=max_goals)
    out = out.withColumns(
        {
            "top_marcadores": sc.top_scores(F.col("cells"), 3), "goles_local": sc.bucket_probs(F.col("cells"), "hg"),
            "goles_visitante": sc.bucket_probs(F.col("cells"), "ag"),
        }
    )
    out = out.withColumns(
        {"_local": sc.pick_bucket(F.col("goles_local")), "_visitante": sc.pick_bucket(F.col("goles_visitante"))}
    )
    replaced = F.col("lambdas_fuente") != "features_equipo"
    quality = F.when(replaced, F.round(F.greatest(F.col("calidad_datos") - 0.25, F.lit(0.0)), 2)).otherwise(F.col("calidad_datos"))
    warnings = F.when(replaced, F.array_append("avisos", F.lit("lambdas_media_liga"))).otherwise(F.col("avisos"))
    return out.withColumns({"calidad_datos": quality, "avisos": warnings}).select(
        *[c for c in KEY if c in features.columns], "home", "away", "date",
        (F.col("calidad_datos") >= settings.BET_LIMITS["quality"]).alias("disponible"),
        F.lit("dixon_coles" if rho else "poisson_independiente").alias("modelo"), F.lit(rho).alias("rho"),
        F.round("lambda_home", 3).alias("lambda_local"), F.round("lambda_away", 3).alias("lambda_visitante"),
        "lambdas_fuente", F.col("top_marcadores")[0]["score"].alias("marcador_predicho"),
        F.round(F.col("top_marcadores")[0]["prob"], 4).alias("marcador_confianza"), "top_marcadores",
        "goles_local", "goles_visitante", F.col("_local.main").alias("seleccion_local"),
        F.col("_visitante.main").alias("seleccion_visitante"), F.col("_local.alternative").alias("alternativa_local"),
        F.col("_visitante.alternative").alias("alternativa_visitante"),
        F.round(F.col("_local.p") * F.col("_visitante.p"), 4).alias("seleccion_confianza"), "avisos", "calidad_datos",
    )


def match_numbers(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Attach the match number of a prediction by folded team names within its matchday."""
    keyed = matches.select(
        "jornada", F.col("num").alias("_num"), fold_name(F.col("local")).alias("_l"), fold_name(F.col("visitante")).alias("_v")
    ).groupBy("jornada", "_l", "_v").agg(F.min("_num").alias("_num"))
    out = predictions.withColumns({"_l": fold_name(F.col("home")), "_v": fold_name(F.col("away"))})
    joined = out.join(keyed, ["jornada", "_l", "_v"], "left")
    return joined.withColumn("num", F.coalesce(F.col("_num"), F.col("num"))).drop("_num", "_l", "_v")


def integrate_predictions(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Join predictions by number and gate them by data quality; other sources stay as comparison.

    ``predictions``: jornada, num, prob_1, prob_x, prob_2, signo_modelo, confianza, calidad_datos.
    """
    names = ("prob_1", "prob_x", "prob_2", "signo_modelo", "confianza", "calidad_datos")
    own = predictions.select(*KEY, *names, F.lit(True).alias("_known"))
    out = matches.join(own, list(KEY), "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    reliable = known & F.coalesce(F.col("calidad_datos") >= settings.BET_LIMITS["quality"], F.lit(False))
    reason = F.when(~known, "datos_insuficientes_o_error").when(~reliable, "baja_calidad_datos")
    return out.withColumns(
        {
            "modelo_disponible": reliable, "modelo_razon": reason,
            "modelo_probs": F.when(reliable, F.array("prob_1", "prob_x", "prob_2")),
            "fuente_principal": F.when(reliable, "motor_maestro_hibrido").otherwise("fallback_apu_lae_q15"),
        }
    ).drop("_known")


def with_recommendation(matches: DataFrame) -> DataFrame:
    """Single, double or triple per match from the model, else from apu percentages."""
    lim = settings.BET_LIMITS
    parts = [F.coalesce(F.col("apu")[s].cast("double"), F.lit(0.0)) for s in settings.SIGNS]
    total = parts[0] + parts[1] + parts[2]
    share = F.array(*[F.when(total > 0, p / total).otherwise(0.333) for p in parts])
    has_apu = F.coalesce(*[F.col("apu")[s] for s in settings.SIGNS]).isNotNull()
    from_model = F.col("modelo_probs").isNotNull()
    out = matches.withColumns(
        {
            "_p": F.when(from_model, F.col("modelo_probs")).when(has_apu, share),
            "fuente_utilizada": F.when(from_model, "motor_maestro").when(has_apu, "apu_fallback"),
        }
    )
    p = [F.col("_p1"), F.col("_px"), F.col("_p2")]
    out = out.withColumns({n: F.col("_p")[i] for i, n in enumerate(("_p1", "_px", "_p2"))})
    first, second = pr.top_two(*p)
    ready = F.col("_p").isNotNull() & (F.col("num") != SCORE_MATCH)
    out = out.withColumns(
        {
            "_first": first, "_second": second, "_confidence": F.coalesce(F.col("confianza"), F.lit(0.5)),
            "recomendacion_disponible": ready,
        }
    ).withColumn("_second_p", pr.value_of(F.col("_second"), p))
    ready, confidence, second_p = F.col("recomendacion_disponible"), F.col("_confidence"), F.col("_second_p")
    gap = F.greatest(*p) - second_p
    kind = (
        F.when((confidence >= lim["confidence"]) & (gap >= lim["gap"]), "simple")
        .when((confidence >= lim["double_confidence"]) & (second_p >= lim["second"]), "doble")
        .otherwise("triple")
    )
    out = out.withColumns(
        {
            "signo_principal": F.when(ready, F.col("_first")), "tipo_apuesta": F.when(ready, kind),
            "confianza_modelo": F.when(ready, F.round(confidence, 3)), "gap_probabilidad": F.when(ready, F.round(gap, 3)),
        }
    )
    bet = (
        F.when(F.col("tipo_apuesta") == "simple", F.col("_first"))
        .when(F.col("tipo_apuesta") == "doble", pr.play(F.col("_first"), F.col("_second")))
        .when(F.col("tipo_apuesta") == "triple", "1X2")
    )
    out = out.withColumn("apuesta_recomendada", bet)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def package_summary(matches: DataFrame) -> DataFrame:
    """Counts and mean confidence per matchday over matches 1 to 14."""
    main = F.col("num") != SCORE_MATCH
    with_model, with_bet = F.col("modelo_disponible"), F.col("recomendacion_disponible")

    def bets(kind: str) -> Column:
        return F.count_if(main & with_bet & (F.col("tipo_apuesta") == kind))

    confidence = F.sum(F.when(main & with_model, F.coalesce("confianza", F.lit(0.0)))) / F.greatest(
        F.lit(1), F.count_if(main & with_model)
    )
    return matches.groupBy("jornada").agg(
        F.count_if(main & with_model).alias("partidos_con_prediccion"),
        F.count_if(main & ~with_model).alias("partidos_sin_prediccion"),
        F.count_if(main & with_bet).alias("partidos_con_recomendacion"),
        F.count_if(main & ~with_bet).alias("partidos_sin_recomendacion"),
        bets("simple").alias("partidos_sin_dobles"), bets("doble").alias("partidos_con_dobles"),
        bets("triple").alias("partidos_con_triple"),
        F.coalesce(F.round(confidence, 3), F.lit(0.0)).alias("confianza_media"),
    )


def optimise_matchdays(
    matches: DataFrame, source: str = "q15", public: str = "lae", alpha: float = 0.6, override: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Best ticket and its ranked columns per matchday, over matches 1 to 14.

    Missing probabilities count as uniform; ``override`` names a probability array that goes first.
    """
    probs = ticket_ops.source_probs(F.col(override) if override else None, F.col(source))
    rows = ticket_ops.main_block(matches).select(
        *KEY, ticket_ops.fill_uniform(probs).alias("p"),
        ticket_ops.fill_uniform(odds.percent_to_probs(F.col(public))).alias("public"),
    )
    tickets = ticket_ops.collect_tickets(rows, ["jornada"], ("p", "public"))
    return ticket_ops.ticket_metrics(tickets), ticket_ops.ticket_columns(tickets, ["jornada"], alpha)


def api_contract(matches: DataFrame, score_match: DataFrame | None = None, version: str = "touchline") -> DataFrame:
    """One row per matchday: ordered array of 14 matches, match 15, and defaults of 0.333."""
    default = F.lit(0.333)
    probs = F.struct(*[
        F.coalesce(F.get("modelo_probs", F.lit(i)), default).alias(s) for i, s in enumerate(settings.SIGNS)
    ])
    item = F.struct(
        F.col("num").alias("numero"), "local", "visitante", probs.alias("probabilidades"),
        F.col("signo_principal").alias("signo_maestro"), F.col("apuesta_recomendada").alias("apuesta"),
        F.col("tipo_apuesta").alias("tipo"), F.col("confianza_modelo").alias("confianza"),
    )
    out = ticket_ops.main_block(matches).groupBy("jornada").agg(F.array_sort(F.collect_list(item)).alias("partidos"))
    if score_match is not None:
        chosen = F.struct(
            "local", "visitante", F.col("marcador_predicho").alias("marcador"),
            F.coalesce("seleccion_local", F.lit("1")).alias("pronostico_local"),
            F.coalesce("seleccion_visitante", F.lit("1")).alias("pronostico_visitante"),
        )
        out = out.join(score_match.select("jornada", chosen.alias("pleno15")), "jornada", "left")
    return out.withColumn("modelo_version", F.lit(version))


def cutoff_dates(matches: DataFrame) -> DataFrame:
    """Day before the earliest match of each matchday."""
    return matches.groupBy("jornada").agg(F.date_sub(F.min(F.to_date("fecha")), 1).alias("cutoff"))


# ---------------------------------------------------------------------------
# Odds timestamps
# ---------------------------------------------------------------------------

def odds_timestamp_issues(
    df: DataFrame, fields: tuple[str, str, str] = ("odds_observed_at", "prediction_cutoff_at", "kickoff_at")
) -> DataFrame:
    """Add ``issues``: odds seen <= cutoff < kick-off must hold and all three must be readable."""
    stamps, problems = [], []
    for name in fields:
        text = F.trim(F.col(name).cast("string"))
        stamp = text.try_cast("timestamp")
        absent = text.isNull() | (text == "")
        problems.append(F.when(absent, f"{name}_ausente").when(stamp.isNull(), f"{name}_invalido"))
        stamps.append(stamp)
    seen, cutoff, kickoff = stamps
    # Order is judged only when all three can be read.
    readable = seen.isNotNull() & cutoff.isNotNull() & kickoff.isNotNull()
    order = [
        F.when(readable & (seen > cutoff), "cuotas_observadas_despues_del_corte"),
        F.when(readable & ~(cutoff < kickoff), "corte_no_anterior_al_kickoff"),
    ]
    return df.withColumn("issues", F.array_compact(F.array(*problems, *order)))


def odds_timestamp_report(df: DataFrame) -> DataFrame:
    valid = F.size("issues") == 0
    return df.agg(
        (F.count_if(~valid) == 0).alias("ok"), F.count_if(valid).alias("partidos_validados"),
        F.count_if(~valid).alias("violaciones"),
    )


def require_valid_timestamps(df: DataFrame) -> DataFrame:
    """Strict mode: a violating row fails the job."""
    message = F.concat(F.lit("odds timestamps of match "), F.col("num").cast("string"), F.lit(": "), F.array_join("issues", ", "))
    ok = F.when(F.size("issues") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.filter(ok)
