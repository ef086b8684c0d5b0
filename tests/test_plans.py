"""Jobs end to end on small inputs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_outcomes import league
from tests.test_raw_data import COLUMNS, row
from tests.test_team_state import random_league, table
from touchline.operators import blend, features, models, priors
from touchline.plans import backtests, jobs, saved_models

FEED = ["match_id", "date", "league_name", "league_season", "round", "status", "home_name", "away_name", "home_goals", "away_goals", "sign"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    (base / "raw" / "SEGUNDA").mkdir(parents=True)
    lines = [",".join(COLUMNS)] + [",".join(row(HomeTeam=f"T{i}")[c] for c in COLUMNS) for i in range(3)]
    (base / "raw" / "SEGUNDA" / "SP2_2021.csv").write_text("\n".join(lines) + "\n")
    feed = [FEED] + [[str(i), f"2025-09-{i + 1:02d}", "La Liga", "2025", "R1", "Finished", "Osasuna", "Alavés", "2", "1", "1"] for i in range(3)]
    (base / "feed.csv").write_text("﻿" + "\n".join(",".join(r) for r in feed) + "\n", encoding="utf-8")
    (base / "roster.json").write_text(json.dumps({
        "season": "2026/27", "laliga_ea_sports": [{"team": "CA Osasuna", "status": "permanece"}, {"team": "Deportivo Alaves", "status": "permanece"}],
        "laliga_hypermotion": [{"team": "CD Eldense", "status": "ascendido_primera_rfef"}]}))
    side = {"pj": 1, "g": 1, "e": 0, "p": 0, "gf": 2, "gc": 1, "pts": 3}
    team = {"pj": 2, "g": 2, "e": 0, "p": 0, "gf": 4, "gc": 2, "dg": 2, "pts": 6, "home": {**side, "pj": None}, "away": side,
            "context": {"status_2026_27": "permanece", "confidence": "media", "raw_ppg": 3.0, "transition_factor": 1.0, "adjusted_ppg": 3.0, "transition": "misma_categoria"}}
    (base / "priors.json").write_text(json.dumps({"season_target": "2026/27", "teams": {"CA Osasuna": team}, "missing_or_partial": [],
                                                  "missing_data_strategy": {"teams": ["CA Osasuna"]}}))
    return {n: str(base / f) for n, f in (("history", "raw"), ("feed", "feed.csv"), ("roster", "roster.json"), ("prior_file", "priors.json"))}


def test_audit_of_all_families(spark, files):
    found, summary = jobs.audit_datasets(spark, **files)
    codes = {r["code"] for r in found.collect()}
    assert {"SEASON_INCOMPLETE", "HIGHLIGHTLY_UTF8_BOM_PRESENT", "TEAMS_COUNT_INVALID", "PRIOR_TEAM_SET_MISMATCH", "PRIOR_PARTIAL_NOT_LISTED"} <= codes
    assert "PRIOR_STRATEGY_TEAM_MISMATCH" not in codes and "PRIOR_SEASON_MISMATCH" not in codes
    assert sum(r["findings"] for r in summary.collect()) == len(codes)


def test_season_priors_from_files(spark, files):
    got = {r["team"]: r for r in jobs.prepare_priors(spark, files["feed"], files["roster"], "2025").collect()}
    assert (got["CA Osasuna"]["pj"], got["CA Osasuna"]["adjusted_ppg"], got["CA Osasuna"]["confidence"]) == (3, 3.0, "media")
    assert (got["CD Eldense"]["transition"], got["CD Eldense"]["adjusted_ppg"], got["CD Eldense"]["confidence"]) == ("primera_rfef_a_segunda", None, "baja")
    assert {r["team"] for r in priors.low_sample_teams(jobs.prepare_priors(spark, files["feed"], files["roster"], "2025")).collect()} == set(got)


def test_history_from_files(spark, files):
    rows = jobs.load_history(spark, files["history"]).collect()
    assert len(rows) == 3 and {r["season"] for r in rows} == {"2020-2021"} and rows[0]["home_xg"] is None


def test_models_are_saved_and_loaded(spark, tmp_path, monkeypatch):
    columns = ["elo_diff", "market_1", "table_pts_diff"]
    train = models.with_target(features.prematch_features(table(spark, random_league(6, n=150, days=120)))).cache()
    fitted = []

    def fit():
        logit, trees = models.LogitModel(columns, max_iter=10).fit(train), models.TreesModel(columns, rounds=2).fit(train)
        scored = logit.score(train).join(train.select("match_id", "target"), "match_id")
        calibrator = models.VectorScaling().fit(scored, [f"logit_prob_{s}" for s in models.PROBS])
        fitted.append(saved_models.PredictionModels(logit, trees, blend.make_config({"logit": 0.3, "hgb": 0.7, "market": 0.0, "poisson": 0.0}), calibrator))
        return fitted[-1]

    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        saved_models.load(spark, folder)
    trained = saved_models.load_or_train(spark, folder, fit)
    assert trained is fitted[0] and not [p for p in (tmp_path / "models").iterdir() if p.name.startswith("_")]
    loaded = saved_models.load_or_train(spark.newSession(), folder, fit)
    assert len(fitted) == 1 and loaded.config == trained.config and loaded.calibrator.rows == trained.calibrator.rows

    def scores(m):
        rows = models.score_sources(train, m.logit, m.trees)
        names = [f"logit_prob_{s}" for s in models.PROBS]
        rows = m.calibrator.transform(rows, names, [f"c_{s}" for s in models.PROBS])
        kept = [*names, *[f"hgb_prob_{s}" for s in models.PROBS], *[f"c_{s}" for s in models.PROBS]]
        return sorted(rows.select("match_id", *kept).collect())

    assert scores(trained) == scores(loaded)
    loaded.require_columns(train)
    with pytest.raises(ValueError, match="elo_diff"):
        loaded.require_columns(train.drop("elo_diff"))
    with pytest.raises(ValueError, match="table_pts_diff"):
        saved_models.load(spark, folder, known=["elo_diff", "market_1"])
    with pytest.raises(FileExistsError):
        saved_models.save(spark, trained, folder)
    monkeypatch.setattr(saved_models, "FORMAT", 2)
    with pytest.raises(ValueError, match="format 1"):
        saved_models.load(spark, folder)


def test_models_without_calibrator(spark, tmp_path):
    train = models.with_target(features.prematch_features(table(spark, random_league(6, n=150, days=120)))).cache()
    logit, trees = models.LogitModel(["market_1"], max_iter=5).fit(train), models.TreesModel(["market_1"], rounds=1).fit(train)
    folder = str(tmp_path / "models")
    saved_models.save(spark, saved_models.PredictionModels(logit, trees, blend.make_config()), folder)
    assert saved_models.load(spark, folder).calibrator is None
    (tmp_path / "models" / "manifest").rename(tmp_path / "manifest")  # an unfinished set is no set
    with pytest.raises(FileNotFoundError):
        saved_models.load(spark, folder)


def test_matchday_prediction_and_package(spark):
    history = table(spark, random_league(6, n=150, days=120)).cache()
    columns = ["elo_diff", "market_1", "table_pts_diff"]
    train = models.with_target(features.prematch_features(history)).cache()
    logit = models.LogitModel(columns, max_iter=10).fit(train)
    trees = models.TreesModel(columns, rounds=1).fit(train)
    upcoming = spark.createDataFrame(
        [(1, n, 1000 + n, f"T{n % 6}" if n < 15 else "Otro", f"T{(n + 1) % 6}" if n < 15 else "Nadie", date(2023, 12, 20)) for n in range(1, 16)],
        "jornada int, num int, match_id long, home string, away string, date date",
    )
    main, last = jobs.predict_matchday(upcoming, history, "2023-12-19", logit, trees, blend.make_config({"logit": 0.5, "hgb": 0.5, "market": 0.0, "poisson": 0.0}))
    main = main.cache()
    rows = main.collect()
    assert len(rows) == 14 and all(r["prob_1"] + r["prob_x"] + r["prob_2"] == pytest.approx(1, abs=1e-3) for r in rows)
    assert all("sin_cuotas_mercado" in r["avisos"] for r in rows)
    forecast = last.first()
    assert forecast["lambdas_fuente"] == "media_liga" and "lambdas_media_liga" in forecast["avisos"]
    pct = "struct<`1`:double,X:double,`2`:double>"
    sheet = spark.createDataFrame(
        [(1, n, f"T{n % 6}", "x", (50.0, 30.0, 20.0), (40.0, 30.0, 30.0), None, "2023-12-20") for n in range(1, 16)],
        f"jornada int, num int, local string, visitante string, q15 {pct}, lae {pct}, apu {pct}, fecha string",
    )
    matches, summary, ticket = jobs.matchday_package(sheet, main)
    s = summary.first()
    assert s["partidos_con_prediccion"] + s["partidos_sin_prediccion"] == 14 and s["partidos_con_recomendacion"] <= 14
    assert ticket.count() == 1 and matches.filter(F.col("num") == 15).first()["apuesta_recomendada"] is None


def test_strengths_against_form(spark):
    df = league(spark)
    r = backtests.strength_study(df, df, ["2017-2018", "2018-2019"], "2020-2021").first()
    assert r["matches"] == 175 and r["log_loss_strength"] > 0
