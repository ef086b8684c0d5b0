"""Tickets, scores, metrics, blends and matchday rules against brute force and known values."""

import itertools
import math
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.test_raw_data import counted
from touchline import settings
from touchline.catalog import training
from touchline.functions import probability as pr
from touchline.functions import scores as sc
from touchline.functions import tickets as tk
from touchline.operators import blend, matchday, metrics, models, ordinal
from touchline.operators import tickets as ops
from touchline.plans import backtests


def tickets(spark, probs_by_ticket):
    rows = [(t, n + 1, list(map(float, p)), list(map(float, p))) for t, ps in probs_by_ticket.items() for n, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "ticket_id long, num int, p array<double>, public array<double>")
    return ops.collect_tickets(df, ["ticket_id"], ("p", "public"))


def random_ticket(rng, ties):
    out = []
    for _ in range(14):
        w = [rng.randrange(1, 4 if ties else 1000) for _ in range(3)]
        out.append([x / sum(w) for x in w])
    return out


def test_uniform_ticket_is_binomial(spark):
    none = F.array().cast("array<int>")
    dist = ops.ticket_metrics(tickets(spark, {1: [[1 / 3] * 3] * 14}), none).first()["dist"]
    for k, p in enumerate(dist):
        assert p == pytest.approx(math.comb(14, k) * (1 / 3) ** k * (2 / 3) ** (14 - k))


def test_known_convolution(spark):
    df = spark.createDataFrame([([0.5, 0.25, 0.75],)], "h array<double>")
    assert df.select(tk.hit_distribution(F.col("h")).alias("d")).first()["d"] == pytest.approx([0.09375, 0.40625, 0.40625, 0.09375])


def test_best_doubles_equal_exhaustive_search(spark):
    rng = random.Random(7)
    data = {t: random_ticket(rng, t % 2 == 0) for t in range(12)}
    got = {r["ticket_id"]: r for r in ops.ticket_metrics(tickets(spark, data)).collect()}
    for t, ps in data.items():
        second = [round(sorted(p)[1], 12) for p in ps]
        best = max(itertools.combinations(range(14), 3), key=lambda c: round(sum(second[i] for i in c), 10))
        assert got[t]["doubles"] == list(best)
        cover = [sum(sorted(p)[1:]) if i in best else max(p) for i, p in enumerate(ps)]
        exact = [0.0] * 15
        for bits in range(1 << 14):
            q, k = 1.0, 0
            for i, h in enumerate(cover):
                if bits >> i & 1:
                    q, k = q * h, k + 1
                else:
                    q *= 1 - h
            exact[k] += q
        assert got[t]["p_ge_12"] == pytest.approx(sum(exact[12:]))
        if t > 3:
            break


def test_ranking_and_columns(spark):
    rng = random.Random(8)
    df = tickets(spark, {1: random_ticket(rng, False)}).cache()
    ranked = ops.ranked_combinations(df, ["ticket_id"]).orderBy("rank").collect()
    assert len(ranked) == 364 and ranked[0]["doubles"] == ops.ticket_metrics(df).first()["doubles"]
    hits = [r["expected_hits"] for r in ranked]
    assert all(a >= b - 1e-12 for a, b in zip(hits, hits[1:]))
    signs = ops.ticket_metrics(df).first()["signs"]
    columns = {r["column"] for r in ops.ticket_columns(df, ["ticket_id"]).collect()}
    assert columns == {"".join(c) for c in itertools.product(*signs)}


def test_ranking_against_plain_loops(spark):
    rng = random.Random(21)
    df = tickets(spark, {t: random_ticket(rng, t % 2 == 0) for t in range(70)}).cache()
    known = {r["ticket_id"]: [m["p"] for m in r["matches"]] for r in df.collect()}
    for ranking in ops.RANKINGS:
        got = {}
        for r in ops.ranked_combinations(df, ["ticket_id"], ranking=ranking).collect():
            got.setdefault(r["ticket_id"], []).append(r)
        top = ops.ranked_combinations(df, ["ticket_id"], top=10, ranking=ranking).collect()
        assert sorted(top) == sorted(r for rows in got.values() for r in rows if r["rank"] <= 10)
        for t in (0, 1, 63, 64, 69):
            assert sorted(r["combination"] for r in got[t]) == list(range(364))
            for r in got[t][::40]:
                covers = [sum(sorted(p)[1:]) if i in r["doubles"] else max(p) for i, p in enumerate(known[t])]
                dist = [1.0]
                for h in covers:
                    dist = [a * (1 - h) + b * h for a, b in zip([*dist, 0.0], [0.0, *dist])]
                assert r["expected_hits"] == pytest.approx(sum(covers)) and r["second_sum"] == pytest.approx(sum(sorted(known[t][i])[1] for i in r["doubles"]))
                assert [r[f"p_ge_{k}"] for k in tk.TAILS] == pytest.approx([sum(dist[k:]) for k in tk.TAILS])


def test_twelve_digits_as_decimal_and_binary():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(7_000_000_000_000, 9_000_000_000_000, 400) / 1e12 + 5e-13, rng.uniform(6, 9, 400)])
    want = [int(Decimal(repr(float(v))).scaleb(12).quantize(Decimal(1), ROUND_HALF_UP)) for v in values]
    assert ops._decimal_key(values[None]).tolist() == [want]
    assert ops._binary_key(values[None]).tolist() == [[int(np.floor(v * 1e12 + 0.5)) for v in values]]


def test_binary_ranking_adds_favourites_from_the_first_match(spark):
    """Three combinations of equal value lie on a half of the twelfth digit; DuckDB, reading matches in order, ranks them like this."""
    weights = [(2, 1, 5), (7, 2, 6), (2, 1, 2), (5, 4, 1), (3, 5, 3), (6, 1, 6), (1, 2, 6), (2, 3, 6), (6, 4, 5), (3, 5, 6), (2, 1, 4), (5, 2, 3), (5, 3, 5), (1, 2, 1)]
    df = tickets(spark, {1: [[x / sum(w) for x in w] for w in weights]})
    got = sorted((r["rank"], r["doubles"]) for r in ops.ranked_combinations(df, ["ticket_id"], top=10, ranking="binary").collect())
    assert [d for _, d in got[6:9]] == [[1, 5, 9], [3, 5, 9], [2, 5, 9]]


def test_full_ranking_stays_out_of_row_expressions(spark):
    """Nested lambdas over 364 combinations and 14 matches took longer than the limit at 1 GB."""
    plan = ops.ranked_combinations(tickets(spark, {1: random_ticket(random.Random(2), False)}), ["ticket_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_ranking_without_a_probability(spark):
    rows = random_ticket(random.Random(4), False)
    df = tickets(spark, {1: rows}).withColumn("matches", F.transform("matches", lambda m: F.struct(m["num"].alias("num"), F.when(m["num"] != 3, m["p"]).alias("p"))))
    got = ops.ranked_combinations(df, ["ticket_id"]).collect()
    assert len(got) == 364 and all(r["expected_hits"] is None and r["p_ge_10"] is None for r in got)


def test_columns_are_ranked_on_ten_digits(spark):
    p = [[0.4, 0.4 + 4e-12, 0.2 - 4e-12], [0.5, 0.3, 0.2], [0.5, 0.3, 0.2]] + [[0.8, 0.1, 0.1]] * 11
    df = spark.createDataFrame([(1, [(i + 1, x, [0.4, 0.3, 0.3]) for i, x in enumerate(p)])], "ticket_id long, matches array<struct<num:int,p:array<double>,public:array<double>>>")
    df = df.withColumn("matches", F.transform("matches", lambda m: F.struct(m["num"].alias("num"), m["p"].alias("p"), F.array(*[F.lit(1 / 3)] * 3).alias("public"))))
    got = [r["column"][:3] for r in ops.ticket_columns(df, ["ticket_id"]).orderBy("rank").collect()]
    assert got[:2] == ["111", "X11"]


def test_uniform_match_plays_x2_as_double_and_1_as_single(spark):
    df = spark.createDataFrame([([1 / 3, 1 / 3, 1 / 3],)], "p array<double>")
    r = df.select(tk.double_signs(F.col("p")).alias("d"), tk.favourite(F.col("p")).alias("s")).first()
    assert (r["d"], r["s"]) == ("X2", "1")


def test_expected_prize(spark):
    df = spark.createDataFrame([([0.0] * 12 + [1.0, 0.0, 0.0],), ([0.0] * 9 + [1.0] + [0.0] * 5,)], "d array<double>")
    assert [r["e"] for r in df.select(tk.expected_prize(F.col("d"), {12: 200.0}).alias("e")).collect()] == [200.0, 0.0]


def test_replacement_rule(spark):
    def decide(challenger, base):
        rows = [(f"20{i}-20{i + 1}", a, v, v, 0.0, 6.0, 1.0, 0.5, 8.0) for i in range(10, 15) for a, v in (("calibrado", challenger), ("activo", base))]
        df = spark.createDataFrame(rows, "season string, arm string, p_ge_12 double, p_ge_13 double, roi double, cost_eur double, prize_eur double, accuracy_simple double, mean_hits double")
        return ops.replacement_decision(df, "activo").first()
    assert (decide(0.05, 0.03)["wins"], decide(0.05, 0.03)["replaces"]) == (5, True)
    assert (decide(0.02, 0.05)["wins"], decide(0.02, 0.05)["replaces"]) == (0, False)


def test_score_grid(spark):
    df = spark.createDataFrame([(1.4, 1.1), (0.2, 3.0), (None, 1.0)], "lambda_home double, lambda_away double")
    out = sc.with_score_cells(df, -0.036)
    dc = sc.dixon_coles_1x2(F.col("lambda_home"), F.col("lambda_away"), -0.036)
    cells = [F.round(p, 9).alias(f"c{i}") for i, p in enumerate(sc.outcome_from_cells(F.col("cells")))]
    rows = out.select(*cells, *[F.round(p, 9).alias(f"d{i}") for i, p in enumerate(dc)], "cells").collect()
    for r in rows[:2]:
        assert sum(c["p"] for c in r["cells"]) == pytest.approx(1) and [r[f"c{i}"] for i in range(3)] == pytest.approx([r[f"d{i}"] for i in range(3)])
    assert rows[2]["cells"] is None and rows[2]["d0"] is None


def test_top_scores_round_only_cells_that_may_be_among_them(spark):
    rng = random.Random(8)
    grids = [[(h, a, rng.choice([0.1, 0.1 + 4e-13, 0.1 - 4e-13, 0.1 - 2e-12, rng.random()])) for h in range(8) for a in range(8)] for _ in range(40)]
    grids += [[(0, 0, 0.6), (0, 1, 0.4)], []]
    df = spark.createDataFrame([*enumerate(grids), (99, None)], "i int, cells array<struct<hg:int,ag:int,p:double>>")
    got = {r["i"]: r["top"] for r in df.select("i", sc.top_scores(F.col("cells"), 3).alias("top")).collect()}
    exact = df.filter("cells is not null").select("i", F.inline("cells")).withColumn("k", F.round("p", 12)).collect()
    for i, _ in enumerate(grids):
        want = sorted((-r["k"], r["hg"], r["ag"]) for r in exact if r["i"] == i)[:3]
        assert [(t["hg"], t["ag"]) for t in got[i]] == [w[1:] for w in want]
    assert got[99] is None
    plan = df.select(sc.top_scores(F.col("cells"), 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" in plan


def test_buckets(spark):
    cells = [(1, 1, 0.12), (0, 0, 0.10), (3, 2, 0.08), (7, 7, 0.80)]
    df = spark.createDataFrame([(cells,)], "cells array<struct<hg:int,ag:int,p:double>>")
    b = df.select(sc.bucket_probs(F.col("cells"), "hg").alias("b")).first()["b"]
    assert sum(b) == pytest.approx(1, abs=1e-3) and b[3] > 0
    df = spark.createDataFrame([([0.30, 0.25, 0.25, 0.20],), ([0.10, 0.80, 0.05, 0.05],)], "b array<double>")
    got = [(r["p"]["main"], r["p"]["alternative"]) for r in df.select(sc.pick_bucket(F.col("b")).alias("p")).collect()]
    assert got == [("0", "1"), ("1", None)]


def test_rho_grid_equals_direct_likelihood(spark):
    rng = random.Random(9)
    data = [(rng.uniform(0.5, 2.5), rng.uniform(0.5, 2.0), rng.randrange(5), rng.randrange(5)) for _ in range(40)]
    df = spark.createDataFrame(data, "lambda_home double, lambda_away double, FTHG int, FTAG int")
    got = {r["step"]: r["log_likelihood"] for r in models.rho_likelihoods(df).collect()}
    for step in (0, 17, 40):
        rho, total = -0.30 + 0.01 * step, 0.0
        for lh, la, h, a in data:
            tau = {(0, 0): 1 - lh * la * rho, (1, 0): 1 + lh * rho, (0, 1): 1 + la * rho, (1, 1): 1 - rho}
            w = {(i, j): max(math.exp(-lh) * lh**i / math.factorial(i) * math.exp(-la) * la**j / math.factorial(j) * tau.get((i, j), 1), 1e-15)
                 for i in range(8) for j in range(8)}
            total += math.log(w[(h, a)] / sum(w.values()))
        assert got[step] == pytest.approx(total)
    assert models.estimate_rho(df) == settings.DEFAULT_RHO


def test_confidence(spark):
    df = spark.createDataFrame([(0.90, 0.05, 0.05), (0.34, 0.33, 0.33)], "a double, b double, c double")
    high, low = [r["c"] for r in df.select(pr.entropy_confidence(*[F.col(x) for x in "abc"]).alias("c")).collect()]
    assert 0.5 < high < 0.8 and low < 0.1


def test_divergence_nudge(spark):
    df = spark.createDataFrame([(0.30, 0.35, 0.35, 0.37, 0.33, 0.30), (0.2, 0.3, 0.5, 0.6, 0.2, 0.2)], "a double, b double, c double, d double, e double, f double")
    out = df.select(*[p.alias(n) for p, n in zip(pr.nudge_by_divergence([F.col(x) for x in "abc"], [F.col(x) for x in "def"]), "xyz")]).collect()
    assert out[0]["x"] > 0.30 and [out[1][n] for n in "xyz"] == pytest.approx([0.2, 0.3, 0.5])


def test_mcnemar(spark):
    def exact(a, b):
        n, k = a + b, min(a, b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    data = [(3, 9), (0, 0), (5, 5), (400, 470)]
    df = spark.createDataFrame(data, "a long, b long")
    assert [r["p"] for r in df.select(metrics.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()] == pytest.approx([exact(*d) for d in data])


def test_mcnemar_at_any_size(spark):
    """Against exact sums on both sides of the series, and where symmetry gives the value: half of 2k + 1 tosses."""
    def exact(a, b):
        n, term, total = a + b, 1, 0
        for i in range(min(a, b) + 1):
            total += term
            term = term * (n - i) // (i + 1)
        return min(1.0, float(Fraction(2 * total, 2**n)))

    data = [(0, 5), (31, 60), (32, 60), (33, 60), (1000, 1100), (5000, 5300)]
    want = [exact(*d) for d in data] + [1.0, 1.0]
    df = spark.createDataFrame([*data, (10**6, 10**6 + 1), (10**9 + 1, 10**9)], "a long, b long")
    got = [r["p"] for r in df.select(metrics.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == pytest.approx(want, abs=1e-12, rel=1e-12)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(v,) for v in [1] * 60 + [0] * 30 + [-1] * 10], "v int")
    r = metrics.bootstrap_interval(df, "v", replicates=400).first()
    assert r["low"] < 0.5 < r["high"] and r["high"] - r["low"] < 0.35


def test_odds_timestamps(spark):
    t = ["2026-01-01 10:00:00", "2026-01-01 11:00:00", "2026-01-01 12:00:00"]
    data = [(1, t[0], t[1], t[2]), (2, t[0], t[0], t[2]), (3, t[0], t[2], t[2]), (4, t[1], t[0], t[2]), (5, None, "x", t[2])]
    df = spark.createDataFrame(data, "num int, odds_observed_at string, prediction_cutoff_at string, kickoff_at string")
    out = matchday.odds_timestamp_issues(df)
    assert [r["issues"] for r in out.orderBy("num").collect()] == [
        [], [], ["corte_no_anterior_al_kickoff"], ["cuotas_observadas_despues_del_corte"], ["odds_observed_at_ausente", "prediction_cutoff_at_invalido"]]
    assert matchday.odds_timestamp_report(out).first()["violaciones"] == 3
    with pytest.raises(Exception, match="odds timestamps of match"):
        matchday.require_valid_timestamps(out).collect()


def test_diagnosis_of_a_known_match(spark):
    schema = "jornada int, num int, local string, visitante string, q15 struct<`1`:double,X:double,`2`:double>, lae struct<`1`:double,X:double,`2`:double>, apu struct<`1`:double,X:double,`2`:double>"
    df = spark.createDataFrame([(74, 1, "Kristiansund", "Start", (69.0, 19.0, 12.0), (56.0, 26.0, 18.0), (43.0, 26.0, 31.0)), (74, 15, "A", "B", None, None, None),
                                (74, 2, "C", "D", None, None, None)], schema)
    rows = {r["num"]: r for r in matchday.diagnose(df).collect()}
    r = rows[1]
    assert (r["fuente_modelo"], r["riesgo"], r["gap_primero_segundo"]) == ("apu", "alto", 0.12)
    # Market 43/26/31 against public 69/19/12: p(1) < .50 and public > .65; p(2) >= .23 and public <= .14.
    assert r["etiquetas"] == ["partido trampa", "visitante de valor"]
    assert (r["conservadora"], r["equilibrada"], r["agresiva"]) == ("12", "X2", "2")
    assert rows[2]["diagnostico"] == "sin probabilidades suficientes" and rows[15]["etiquetas"] is None


def test_ordinals_and_blocks(spark):
    rng = random.Random(10)
    data = [(i, f"2024-01-{rng.randrange(1, 9):02d}", "P", f"h{rng.randrange(5)}", "a", f"s{i % 2}") for i in range(100)]
    df = spark.createDataFrame(data, "match_id long, date string, division string, home string, away string, season string")
    got = {r["match_id"]: r["ordinal"] for r in ordinal.with_ordinal(df).collect()}
    want = {r[0]: i for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[2], r[3], r[4], r[0])))}
    assert got == want
    blocks = ordinal.with_blocks(df, ["season"])
    assert blocks.count() == 90 and blocks.groupBy("season", "block").count().filter("count <> 15").count() == 0
    assert ordinal.temporal_split(df, 0.84).filter("is_train").count() == 84


def test_mixture_weights_find_the_best_source(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(400):
        r = rng.choice("1X2")
        good = [0.7 if s == r else 0.15 for s in "1X2"] if rng.random() < 0.9 else [1 / 3] * 3
        rows.append((r, *good, 1 / 3, 1 / 3, 1 / 3))
    df = spark.createDataFrame(rows, "result string, a1 double, ax double, a2 double, b1 double, bx double, b2 double")
    w = models.mixture_weights(df, {"a": ["a1", "ax", "a2"], "b": ["b1", "bx", "b2"]}, max_rounds=60)
    assert sum(w.values()) == pytest.approx(1) and w["a"] > 0.95


def test_mixture_weights_of_every_season_beat_the_grid(spark):
    rng = random.Random(17)
    rows = []
    for i in range(600):
        r, year = rng.choice("1X2"), 2015 + i // 200
        p, q = [[0.55 if s == r and rng.random() < hit else 0.225 for s in "1X2"] for hit in (0.6, 0.3 + 0.2 * (i // 200))]
        rows.append((f"{year}-{year + 1}", r, *p, *(None if i == 7 else x for x in q)))
    df = spark.createDataFrame(rows, "season string, result string, a1 double, ax double, a2 double, b1 double, bx double, b2 double")
    sources = {"a": ["a1", "ax", "a2"], "b": ["b1", "bx", "b2"]}
    earlier = ordinal.with_target_seasons(df).cache()
    assert {r["target_season"]: r["count"] for r in earlier.groupBy("target_season").count().collect()} == {"2016-2017": 200, "2017-2018": 400}
    found = models.mixture_weights_by(earlier, sources, "target_season")
    for season, w in found.items():
        mine = earlier.filter(F.col("target_season") == season)
        q = mine.select(*models.result_probabilities(sources)).dropna().collect()
        loss = -sum(math.log(w["a"] * r[0] + w["b"] * r[1]) for r in q) / len(q)
        assert sum(w.values()) == pytest.approx(1)
        assert loss <= models.mixture_grid(mine, sources, steps=20).agg(F.min("log_loss")).first()[0] + 1e-9
    assert models.mixture_weights_by(df.filter("false"), sources, "season") == {}


def test_rho_of_a_season_is_learnt_from_earlier_ones(spark):
    df = league(spark).cache()
    got = {r["season"]: r["rho"] for r in models.rho_before_seasons(df, min_rows=1).collect()}
    assert set(got) == {"2018-2019", "2019-2020", "2020-2021"}
    for season, rho in got.items():
        train, _ = ordinal.split_by_season(df, season)
        assert rho == models.best_rho(train, min_rows=1).first()["rho"]
    study = backtests.score_model_study(df).collect()
    assert {(r["season"], r["variant"]) for r in study} == {(s, v) for s in got for v in ("poisson_independiente", "dixon_coles")}


def league(spark, n=700):
    rng = random.Random(12)
    teams = [f"T{i}" for i in range(8)]
    rows = []
    for i in range(n):
        h, a = rng.sample(range(8), 2)
        hg, ag = min(5, int(rng.expovariate(1 / (1.8 - 0.1 * h)))), min(5, int(rng.expovariate(1 / (1.2 + 0.05 * a))))
        year = 2018 + i * 4 // n
        rows.append((i, f"{year}-{1 + i % 6:02d}-{1 + i % 28:02d}", "Primera" if i % 2 else "Segunda", f"{year - 1}-{year}", teams[h], teams[a], hg, ag,
                     "1" if hg > ag else "2" if hg < ag else "X", float(h), None if i % 9 == 0 else float(a), 0.5, 0.25, 0.25, 0.4, 0.3, 0.3, 1.4, 1.1))
    return spark.createDataFrame(
        rows, "match_id long, date string, division string, season string, home string, away string, FTHG int, FTAG int, result string, f1 double, f2 double, "
        "market_1 double, market_x double, market_2 double, poisson_1 double, poisson_x double, poisson_2 double, lambda_home double, lambda_away double")


def test_strengths_solve_the_likelihood_equations(spark):
    df = league(spark).cache()
    strengths = models.attack_defence(df).cache()
    # At the maximum every team scores, concedes, and every side scores what is expected of it.
    rows = models.strength_lambdas(df.select("home", "away", "FTHG", "FTAG"), strengths).collect()
    for t in {r["home"] for r in rows}:
        scored = [(r["FTHG"], r["strength_home"]) for r in rows if r["home"] == t] + [(r["FTAG"], r["strength_away"]) for r in rows if r["away"] == t]
        conceded = [(r["FTAG"], r["strength_away"]) for r in rows if r["home"] == t] + [(r["FTHG"], r["strength_home"]) for r in rows if r["away"] == t]
        for part in (scored, conceded):
            assert sum(g for g, _ in part) == pytest.approx(sum(e for _, e in part), rel=1e-5)
    assert sum(r["FTHG"] for r in rows) == pytest.approx(sum(r["strength_home"] for r in rows), rel=1e-5)
    assert sum(r["attack"] for r in strengths.collect()) == pytest.approx(0, abs=1e-9)
    goalless = models.attack_defence(spark.createDataFrame([("A", "B", 0, 0), ("B", "A", 0, 0)], "home string, away string, FTHG int, FTAG int"))
    assert goalless.count() == 2
    out = models.strength_lambdas(spark.createDataFrame([("T1", "Nadie")], "home string, away string"), strengths).first()
    assert (out["strength_home"], out["strength_away"]) == settings.FALLBACK_STRENGTH_LAMBDAS


def test_fits_over_the_same_rows_share_one_preparation(spark, monkeypatch):
    calls, learn = [], models.learn_preparation
    monkeypatch.setattr(models, "learn_preparation", lambda *args: calls.append(args) or learn(*args))
    logit, trees = backtests.fit_sources(league(spark, 200), backtests.TrainingOptions(["f1", "f2"], rounds=1, max_iter=5))
    assert len(calls) == 1
    assert {logit.preparation.columns, *[p.preparation.columns for p in trees.parts]} == {("f1", "f2")}


def test_preparation_takes_exact_medians_of_all_columns(spark, monkeypatch):
    monkeypatch.setattr(models, "MEDIAN_BINS", 4)
    rng = random.Random(3)
    columns = {
        "a": [rng.gauss(0, 1e3) for _ in range(301)], "b": [float(rng.randrange(3)) for _ in range(301)], "c": [rng.random() if i % 3 else None for i in range(301)],
        "d": [None] * 301, "e": [7.5] * 301, "f": [-1.7e308, 1.7e308, *[math.inf, math.nan, None] * 99, None, None],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    known = {c: [v for v in values if v is not None and math.isfinite(v)] for c, values in columns.items()}
    assert models.column_medians(df, list(columns)) == {c: statistics.median_low(v) if v else None for c, v in known.items()}
    got = models.learn_preparation(df, list("abcde"))
    assert got.columns == tuple("abce")
    for c in got.columns:
        filled = [got.medians[c] if v is None else v for v in columns[c]]
        assert (got.means[c], got.deviations[c]) == (pytest.approx(statistics.fmean(filled)), pytest.approx(statistics.pstdev(filled)))


def test_trees_of_several_labels_share_jobs_and_equal_sparks(spark):
    """A set of trees a label was fitted side by side, a job a level each; now a level of all labels is one job over packed rows."""
    rng = np.random.default_rng(5)
    n = 1200
    x = [rng.normal(size=n), rng.integers(0, 9, n).astype(float), rng.random(n) ** 3, np.full(n, 2.5), rng.integers(-3, 40, n) / 7]
    y = [x[0] + 0.3 * x[1] - x[2] + rng.normal(size=n) > 1, x[4] * x[2] + 0.5 * rng.normal(size=n) > 0.6, np.zeros(n) > 0]
    rows = [(i, *[float(v[i]) if i % 50 or c else None for c, v in enumerate(x)], *[bool(v[i]) for v in y]) for i in range(n)]
    df = spark.createDataFrame(rows, "match_id long, a double, b double, c double, d double, e double, y0 boolean, y1 boolean, y2 boolean").repartition(5).cache()
    parts = [models.BinaryTrees("abcde", rounds=4, max_depth=4, learning_rate=0.1) for _ in y]
    context = spark.sparkContext
    context.setJobGroup("trees", "trees")
    models._fit_trees(parts, df, [F.col(f"y{i}") for i in range(len(y))], None)
    jobs = len(context.statusTracker().getJobIdsForGroup("trees"))
    context.setJobGroup("other", "other")
    assert jobs < 3 * 4 * 4  # fewer than a job a label, round and level
    data = VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df.fillna(parts[0].preparation.medians))
    for i, part in enumerate(parts[:2]):
        want = GBTClassifier(labelCol="label", maxIter=4, maxDepth=4, stepSize=0.1, minInstancesPerNode=20).fit(data.withColumn("label", F.col(f"y{i}").cast("double")))
        both = want.transform(data).join(part.score(df), "match_id").select((F.get(vector_to_array("probability"), F.lit(1)) - F.col("score")).alias("d"))
        assert both.agg(F.max(F.abs("d"))).first()[0] < 1e-12
    assert {round(r["score"], 9) for r in parts[2].score(df).collect()} == {round(1 / (1 + math.exp(2 * margin)), 9) for margin in [never_margin(4, 0.1)]}


def test_trees_read_their_rows_once(spark):
    """Medians, deviations, bin ends and every classifier read the rows again."""
    df = models.with_target(league(spark, 100)).select("match_id", "f1", "f2", "target").cache()
    rows, seen = counted(spark, df)
    models.BinaryTrees(["f1", "f2"], rounds=1, max_depth=1).fit(rows, F.col("target") == 1.0)
    assert seen.value == df.count()


def test_backtest_fits_all_published_rounds():
    assert [p.rounds for p in models.TreesModel(rounds=training.BACKTEST.rounds).parts] == [settings.TREE_SETTINGS["rounds"]] * 3 == [300] * 3
    assert training.BACKTEST.max_iter == 3500


def never_margin(rounds, rate):
    """Margin against a label that no row has: every tree is one leaf."""
    margin = 1.0
    for _ in range(rounds - 1):
        margin += rate * 4 / (1 + math.exp(2 * margin))
    return margin


def test_season_backtest_runs_end_to_end(spark):
    options = backtests.TrainingOptions(["f1", "f2"], rounds=1, max_iter=15)
    configs = [blend.make_config({"logit": 0.5, "hgb": 0.2, "market": 0.2, "poisson": 0.1}), blend.make_config()]
    predictions, summary = backtests.season_backtest(league(spark), "2020-2021", options, configs)
    s = summary.first()
    assert s["train_matches"] == 525 and s["test_matches"] == 175 and 0 < s["accuracy_simple"] <= 1
    total = predictions.select(F.abs(F.col("latest_prob_1") + F.col("latest_prob_x") + F.col("latest_prob_2") - 1).alias("e")).agg(F.max("e")).first()[0]
    assert total < 1e-9
    with pytest.raises(ValueError):
        backtests.season_backtest(league(spark), "2017-2018", options, configs)
