"""Point-in-time state: no result of the same or a later day may be visible."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.operators import elo, features, form
from touchline.plans import jobs
from touchline.schemas import FEATURE_TABLE_COLUMNS, MATCH_SCHEMA, MODEL_COLUMNS


def match(i, day, home, away, hg, ag, division="Primera", season="2023-2024", **extra):
    result = None if hg is None else "1" if hg > ag else "2" if hg < ag else "X"
    base = dict(
        match_id=i, date=day, home=home, away=away, division=division, division_code=0, season=season, source_file="f",
        FTHG=hg, FTAG=ag, result=result, odd_1=2.0, odd_x=3.0, odd_2=4.0, open_odd_1=2.1, open_odd_x=3.1, open_odd_2=4.1,
        HS=10.0, AS=8.0, HST=4.0, AST=3.0, home_xg=None, away_xg=None,
    )
    return {**base, **extra}


def table(spark, rows):
    names = [f.name for f in MATCH_SCHEMA.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], MATCH_SCHEMA)


def by_id(df):
    return {r["match_id"]: r for r in df.collect()}


def random_league(seed, n=160, teams=6, days=60):
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(teams)]
    rows = []
    for i in range(n):
        h, a = rng.sample(names, 2)
        rows.append(match(i, date(2023, 8, 1) + timedelta(days=rng.randrange(days)), h, a, rng.randrange(4), rng.randrange(4)))
    return rows


def replay(rows):
    """Direct replay day by day, as the plain definition says."""
    order = lambda r: (r["date"], r["division"], r["home"], r["away"], r["match_id"])
    rows = sorted(rows, key=order)
    ratings, tables, lists, out = {}, {}, {}, {}
    for day in sorted({r["date"] for r in rows}):
        today = [r for r in rows if r["date"] == day]
        for r in today:
            t = tables.setdefault((r["division"], r["season"]), {})
            for x in (r["home"], r["away"]):
                t.setdefault(x, [0, 0, 0])
            ranked = sorted(t, key=lambda x: (-t[x][0], -(t[x][1] - t[x][2]), -t[x][1], x))
            last = lambda x: (lists.get(x) or [])[-5:]
            mean = lambda v: sum(v) / len(v) if v else None
            out[r["match_id"]] = dict(
                he=ratings.get(r["home"], 1500.0), ae=ratings.get(r["away"], 1500.0),
                hp=ranked.index(r["home"]) + 1, ap=ranked.index(r["away"]) + 1, form=mean(last(r["home"])),
            )
        for r in today:
            h, a = ratings.get(r["home"], 1500.0), ratings.get(r["away"], 1500.0)
            s = {"1": 1.0, "X": 0.5, "2": 0.0}[r["result"]]
            d = 24 * (s - 1 / (1 + 10 ** ((a - h - 55) / 400)))
            ratings[r["home"]], ratings[r["away"]] = h + d, a - d
            t = tables[(r["division"], r["season"])]
            pts = {"1": (3, 0), "X": (1, 1), "2": (0, 3)}[r["result"]]
            for x, p, gf, ga in ((r["home"], pts[0], r["FTHG"], r["FTAG"]), (r["away"], pts[1], r["FTAG"], r["FTHG"])):
                t[x] = [t[x][0] + p, t[x][1] + gf, t[x][2] + ga]
                lists.setdefault(x, []).append(p)
    return out


def test_same_day_is_invisible(spark):
    d = date(2024, 1, 1)
    out = by_id(features.prematch_features(table(spark, [match(1, d, "A", "B", 3, 0), match(2, d, "A", "C", 0, 1)])))
    for r in out.values():
        assert (r["home_elo"], r["home_table_pj"], r["home_table_pts"]) == (1500.0, 0.0, 0.0)
        assert r["home_form_pts_5"] is None and r["days_rest_home"] is None


def test_next_day_sees_the_past(spark):
    rows = [match(1, date(2024, 1, 1), "A", "B", 3, 0), match(2, date(2024, 1, 2), "A", "C", 1, 1)]
    r = by_id(features.prematch_features(table(spark, rows)))[2]
    assert (r["home_table_pj"], r["home_table_pts"], r["home_form_pts_5"], r["days_rest_home"]) == (1.0, 3.0, 3.0, 1.0)
    assert r["home_elo"] == pytest.approx(1500 + 24 * (1 - 1 / (1 + 10 ** (-55 / 400))))


def test_missing_value_empties_the_mean(spark):
    rows = [match(i, date(2024, 1, i), "A", "B", 1, 0, HST=None if i == 2 else 4.0) for i in range(1, 5)]
    r = by_id(features.prematch_features(table(spark, rows)))[4]
    assert r["home_sot_5"] is None and r["home_shots_5"] == 10.0


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_direct_replay(spark, seed):
    rows = random_league(seed)
    got, want = by_id(features.prematch_features(table(spark, rows))), replay(rows)
    for i, w in want.items():
        g = got[i]
        assert (g["home_table_pos"], g["away_table_pos"]) == (w["hp"], w["ap"])
        assert g["home_elo"] == pytest.approx(w["he"]) and g["away_elo"] == pytest.approx(w["ae"])
        assert g["home_form_pts_5"] == (None if w["form"] is None else pytest.approx(w["form"]))


def test_pools_stream_over_many_frames(spark):
    """Batches of three rows: days, pools and repeated rows cross their borders."""
    rows = [{**r, "division": "Primera" if int(r["home"][1:]) % 2 else "Segunda"} for r in random_league(3, n=60, teams=5, days=15)]
    rows += rows[10:13]
    df = table(spark, rows)
    whole = sorted(map(tuple, elo.elo_ratings(df, "division").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, elo.elo_ratings(df, "division").collect())) == whole and len(whole) == 63
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _countries(seed):
    """Three countries with two leagues each whose teams change league with the season; and a cup that joins two of them once."""
    rng, rows = random.Random(seed), []
    for i in range(400):
        c, day = rng.randrange(3), date(2019, 7, 1) + timedelta(days=rng.randrange(1500))
        year = day.year - (day.month < 7)
        h, a = rng.sample([f"{c}{t}" for t in range(8) if (t + year) % 2 == i % 2 or t > 5], 2)
        rows.append(match(i, day, h, a, rng.randrange(4), rng.randrange(4), division=f"L{c}{i % 2}", season="s"))
    for r in rows:
        r["match_id"] += 1 << 60  # beyond what a float holds
    rows += [match(900, date(2021, 1, 5), "01", "11", 2, 0, division="Cup", season="s"), match(901, date(2021, 1, 9), "01", "12", None, None, division="Cup", season="s")]
    return rows


@pytest.mark.parametrize("slice_rows", [10**6, 5])
def test_groups_and_seasons_equal_one_sequence(spark, slice_rows):
    rows = _countries(7)
    got = {r["match_id"]: r for r in elo.elo_ratings(table(spark, rows), slice_rows=slice_rows).collect()}
    ratings, order = {}, lambda r: (r["date"], r["division"], r["home"], r["away"], r["match_id"])
    for day in sorted({r["date"] for r in rows}):
        today = sorted((r for r in rows if r["date"] == day), key=order)
        for r in today:
            assert got[r["match_id"]]["home_elo"] == pytest.approx(ratings.get(r["home"], 1500.0), abs=1e-9)
            assert got[r["match_id"]]["away_elo"] == pytest.approx(ratings.get(r["away"], 1500.0), abs=1e-9)
        for r in today:
            h, a = ratings.get(r["home"], 1500.0), ratings.get(r["away"], 1500.0)
            d = 0 if r["result"] is None else 24 * ({"1": 1.0, "X": 0.5, "2": 0.0}[r["result"]] - 1 / (1 + 10 ** ((a - h - 55) / 400)))
            ratings[r["home"]], ratings[r["away"]] = h + d, a - d
            assert got[r["match_id"]]["home_elo_after"] == pytest.approx(h + d, abs=1e-9)
    assert len(got) == len(rows)


def test_leagues_that_share_teams_are_one_group(spark):
    rows = elo._prepare(table(spark, _countries(7)), None)
    whole = {r["division"]: r["group"] for r in elo.league_groups(rows, False)[0].collect()}
    assert whole["L00"] == whole["L01"] == whole["L10"] == whole["L11"] == whole["Cup"] == "Cup" and whole["L20"] == whole["L21"] == "L20"
    sliced = {(r["slice"], r["division"]): r["group"] for r in elo.league_groups(rows, True)[0].collect()}
    assert sliced[2020, "L00"] == sliced[2020, "L10"] and sliced[2021, "L00"] != sliced[2021, "L10"]
    apart = table(spark, [match(1, date(2020, 1, 1), "A", "B", 1, 0, division="x"), match(2, date(2020, 1, 1), "C", "D", 1, 0, division="y")])
    assert elo.league_groups(elo._prepare(apart, None), False) == (None, 1)
    assert elo.elo_ratings(table(spark, [])).count() == 0


def test_repeated_rows_do_not_multiply(spark):
    rows = random_league(6, n=30)
    out = features.prematch_features(table(spark, rows + [rows[7], rows[7], rows[20]]))
    assert out.count() == 33
    keyed = jobs.with_row_key(table(spark, rows + [rows[7], rows[7]]).drop("match_id").withColumn("source_file", F.lit("f")))
    assert keyed.select("match_id").distinct().count() == 32


def test_promoted_team_keeps_its_last_rating(spark):
    rows = [match(i, date(2023, 1, i), "A", "B", 5, 0, division="Segunda", season="2022-2023") for i in range(1, 6)]
    rows += [match(10 + i, date(2023, 9, i), "C", "A", 3, 0, division="Primera", season="2023-2024") for i in range(1, 4)]
    df = table(spark, rows)
    latest = {r["team"]: r["elo"] for r in elo.latest_elo(df, "division").collect()}
    after = {r["match_id"]: r for r in elo.elo_ratings(df, "division").collect()}
    assert latest["A"] == after[13]["away_elo_after"] < 1500 < after[5]["home_elo_after"]
    assert {r["team"] for r in elo.latest_elo(df).collect()} == {"A", "B", "C"}


def test_count_of_smaller_marks_equals_brute_force(spark):
    rng = random.Random(4)
    points = [("g", f"n{rng.randrange(12):02d}", rng.randrange(8), rng.random() < 0.5, str(i)) for i in range(60)]
    df = spark.createDataFrame(points, "g string, label string, at int, is_mark boolean, query_id string")
    got = {r["query_id"]: r["smaller"] for r in form.smaller_before(df, ["g"]).collect()}
    for _, label, at, _, q in points:
        assert got.get(q, 0) == sum(1 for _, la, t, m, _ in points if m and la < label and t <= at)


def test_upcoming_matches_ignore_later_rows_and_each_other(spark):
    past = random_league(5, n=80)
    cutoff = "2023-09-10"
    up = spark.createDataFrame(
        [(901, 1, "T0", "T1", date(2023, 9, 12)), (902, 2, "T0", "Nuevo", None)], "match_id long, num int, home string, away string, date date"
    )
    early = [r for r in past if r["date"] < date(2023, 9, 10)]
    a = by_id(features.upcoming_features(up, table(spark, past), cutoff))
    b = by_id(features.upcoming_features(up, table(spark, early), cutoff))
    assert a == b
    assert a[902]["away_elo"] == 1500.0 and a[902]["away_table_pj"] == 0.0 and a[902]["season"] == "2023-2024"
    # The state equals the features of a match played on the cutoff day.
    probe = match(900, date(2023, 9, 10), "T0", "T1", 1, 0)
    same = by_id(features.prematch_features(table(spark, [*early, probe])))[900]
    for c in ("home_elo", "away_elo", "home_form_pts_5", "home_table_pos", "away_table_pos", "home_home_pts_5", "home_sot_5", "lambda_home"):
        assert a[901][c] == pytest.approx(same[c])


def test_all_matchdays_at_once_equal_one_call_each(spark):
    past = random_league(8, n=90, teams=5)
    history = table(spark, past)
    cutoffs = ["2023-08-01", "2023-08-20", "2023-09-10", "2023-10-30"]
    rows = [
        (100 * j + k, k, j, home, away, date.fromisoformat(c), None if k == 3 else date.fromisoformat(c) + timedelta(days=k))
        for j, c in enumerate(cutoffs) for k, (home, away) in enumerate([("T0", "T1"), ("T2", "Nuevo"), ("Alta", "T0"), ("T3", "T4")])
    ]
    # A second matchday with the same cutoff whose newcomers the first one must not see.
    rows += [(900, 0, 9, "Otro", "T1", date(2023, 8, 20), None)]
    up = spark.createDataFrame(rows, "match_id long, num int, jornada int, home string, away string, cutoff date, date date")
    got = by_id(features.matchday_features(up, history, ["jornada"], keep=["jornada"]))
    assert len(got) == len(rows)
    for j, c in [*enumerate(cutoffs), (9, "2023-08-20")]:
        alone = by_id(features.upcoming_features(up.filter(F.col("jornada") == j).drop("cutoff"), history, c, keep=["jornada"]))
        assert {i: r for i, r in got.items() if r["jornada"] == j} == alone


def test_feature_table_reads_its_source_once(spark):
    source = table(spark, random_league(2, n=40)).withColumn("match_id", F.col("match_id") + F.rand(3).cast("int"))
    plan = features.prematch_features(source)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan  # only written tables are left
    assert plan.count("Exchange hashpartitioning") <= 24


def test_states_before_days_that_are_asked_for(spark):
    rows = random_league(9, n=70, teams=4, days=40)
    asks = [(f"T{t}", "Primera", "2023-2024", date(2023, 8, 1) + timedelta(days=7 * w)) for t in range(5) for w in range(8)] + [("T0", None, None, date(2023, 9, 1)), ("T1", "Segunda", "2023-2024", date(2023, 9, 1))]
    from touchline.operators import state

    frame = spark.createDataFrame([*asks, asks[0]], "team string, division string, season string, date date")
    got = state.states(table(spark, rows), frame).collect()
    assert len(got) == len(asks)
    order = lambda r: (r["date"], r["division"], r["home"], r["away"], r["match_id"])
    for g in got:
        own = [r for r in sorted(rows, key=order) if g["team"] in (r["home"], r["away"]) and r["date"] < g["date"]]
        pts = [3 if r["result"] == ("1" if r["home"] == g["team"] else "2") else 1 if r["result"] == "X" else 0 for r in own]
        assert g["team_pts"] == (pytest.approx(sum(pts[-5:]) / len(pts[-5:])) if pts else None)
        home = [p for p, r in zip(pts, own) if r["home"] == g["team"]][-5:]
        assert g["home_side_pts"] == (pytest.approx(sum(home) / len(home)) if home else None)
        assert g["last_date"] == (own[-1]["date"] if own else None)
        same = g["division"] == "Primera"
        assert (g["pj"], g["pts"]) == ((len(pts), sum(pts)) if same else (0, 0))


def test_published_columns(spark):
    assert len(FEATURE_TABLE_COLUMNS) == 88 and len(set(FEATURE_TABLE_COLUMNS)) == 88
    assert len(MODEL_COLUMNS) == 73 and set(MODEL_COLUMNS) < set(FEATURE_TABLE_COLUMNS)


def test_partial_odds_still_give_probabilities(spark):
    rows = [match(1, date(2024, 1, 1), "A", "B", 1, 0, odd_x=0.0), match(2, date(2024, 1, 1), "C", "D", 1, 0, odd_x=None)]
    for r in by_id(features.with_differences(features.prematch_features(table(spark, rows)))).values():
        assert r["market_1"] == pytest.approx((1 / 2) / (1 / 2 + 1 / 4)) and r["market_x"] is None


def test_xg_means_are_point_in_time(spark):
    rows = [match(i, date(2020, i, 5), "AA", "BB", 1, 0, home_xg=1.5, away_xg=0.8) for i in range(1, 5)]
    out = by_id(features.prematch_features(table(spark, rows)))
    assert out[1]["home_xg_5"] is None and out[4]["home_xg_5"] == pytest.approx(1.5) and out[4]["away_xg_against_5"] == pytest.approx(1.5)
    assert out[4]["xg_for_diff"] == pytest.approx(0.7)
    without = features.prematch_features(table(spark, rows).drop("home_xg", "away_xg")).filter(F.col("home_xg_5").isNotNull())
    assert without.count() == 0


def test_places_of_newcomers_in_bounded_windows(spark):
    rng = random.Random(17)
    teams = {t: (rng.randrange(3), rng.randrange(-1, 2), rng.randrange(2), 0) for t in "abcdef"} | {t: (0, 0, 0, 1) for t in "bdhik"} | {"z": (-1, -2, 1, 0)}
    old = sorted((t for t, v in teams.items() if not v[3]), key=lambda t: (-teams[t][0], -teams[t][1], -teams[t][2], t))
    rows = [(g, f"{g}:{i}", t, i, *teams[t][:3], bool(teams[t][3]), sum(1 for o in old if (-teams[o][0], -teams[o][1], -teams[o][2], o) < (-teams[t][0], -teams[t][1], -teams[t][2], t)))
            for g in (None, "x") for i, t in enumerate([*rng.choices("abcdefz", k=9), *rng.choices(sorted(teams), k=60), *sorted(teams), *rng.choices(sorted(teams), k=80)])]
    df = spark.createDataFrame(rows, "g string, query_id string, team string, at long, pts int, gd int, gf int, is_new boolean, better_old long")
    got = {r["query_id"]: r["position"] for r in form.positions_with_newcomers(df, ["g"]).collect()}
    assert len(got) == len(rows)
    for g, q, t, i, *_ in rows:
        inside = {o for o in teams if not teams[o][3]} | {r[2] for r in rows if r[0] == g and r[3] <= i}
        order = sorted(inside, key=lambda o: (-teams[o][0], -teams[o][1], -teams[o][2], o))
        assert got[q] == order.index(t) + 1, (q, t)
    # Rows after the last entry meet no window over the whole group: only one row a team does.
    plan = form.positions_with_newcomers(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_above" in plan and "Union" in plan
