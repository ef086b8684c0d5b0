"""Parsing, sanitising, audit, names, readers and writers."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from touchline.functions import odds, text
from touchline.operators import audit, cleaning, compare, feed_audit, missing, names, priors, xg
from touchline.sources import readers, writers

COLUMNS = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR",
           "B365H", "B365D", "B365A", "B365CH", "B365CD", "B365CA"]
NORMAL = ["01/09/2020", "Local", "Visitante", "2", "1", "H", "10", "8", "4", "3", "9", "11", "5", "2", "1", "2", "0", "0",
          "2.0", "3.0", "4.0", "2.1", "3.1", "4.1"]


def row(**changes):
    return {**dict(zip(COLUMNS, NORMAL)), **changes}


NO_CLOSE = dict(B365CH="", B365CD="", B365CA="")
ADMIN = {c: "" for c in COLUMNS[6:]} | dict(FTHG="0", FTAG="1", FTR="A")
EMPTY = {c: " " for c in COLUMNS}


def raw(spark, rows, columns=COLUMNS):
    data = [tuple(r.get(c) for c in COLUMNS) + ("SP2_2021.csv", "2020-2021", "Segunda", columns, i) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.createDataFrame(data, f"{schema}, _source_file string, _season string, _division string, _columns array<string>, _line int")


def values(spark, data, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    got = values(spark, ["1/9/20", "01/09/2020", "2020-09-01", "1-9-2020", "01-09-69", "20200901", "2020-09-01T10:30:00Z", "2020", "31/02/2020",
                         "no-es-fecha", "", None, "32/1/2020"], text.parse_date)
    assert [str(v) if v else None for v in got] == ["2020-09-01"] * 4 + ["1969-09-01"] + ["2020-09-01"] * 2 + [None] * 6


def test_numbers(spark):
    got = values(spark, [" 1,5 ", "2", "1e3", ".5", "nan", "inf", "1d", "", None, "a"], text.parse_number)
    assert got == [1.5, 2.0, 1000.0, 0.5] + [None] * 6


def test_name_folding(spark):
    assert values(spark, ["  Málaga  C.F.", "ÑOÑO", None, "ﬁn"], text.fold_name) == ["malaga cf", "nono", "", "fin"]
    assert values(spark, ["Atlético-Madrid!"], text.fold_words) == ["atletico madrid"]
    assert values(spark, ["RC Celta de Vigo"], text.fold_key) == ["rcceltadevigo"]
    assert values(spark, ["MÃ¡laga", "Málaga", "Ã€", "Ã"], text.repair_mojibake)[:2] == ["Málaga", "Málaga"]
    assert values(spark, ["Barcelona B", "Celta Fortuna", "Betis", "Sub U23"], text.is_reserve_name) == [True, True, False, True]


def test_results(spark):
    assert values(spark, ["h", "0", "1.0", "D", "2.0", "?"], odds.normalise_result) == ["1", "1", "X", "X", "2", None]


def counted(spark, df):
    """The rows and a number of how often one was worked out."""
    seen = spark.sparkContext.accumulator(0)

    def through(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return df.mapInPandas(through, df.schema), seen


def test_rows_are_worked_out_once(spark):
    rows, seen = counted(spark, raw(spark, [row(), row(**NO_CLOSE), row(**ADMIN), EMPTY]))
    got = {tuple(r) for r in cleaning.breakdown(cleaning.sanitise(rows)).collect()}
    assert got == {("kept", "Segunda/2020-2021", 2), ("excluded", "EMPTY_ROW", 1), ("excluded", "ADMINISTRATIVE_CANDIDATE", 1)} and seen.value == 4
    rows, seen = counted(spark, raw(spark, [row(), row(B365H="2.5")]))
    audit.observed_distribution(audit.row_facts(rows), "_overround", ["_division"]).collect()
    assert seen.value == 2


def test_distribution_writes_its_values_before_it_filters_them(spark, monkeypatch):
    """The filter carried the whole derivation of the value a second time, pushed below every projection."""
    staged, write = [], audit.stage
    monkeypatch.setattr(audit, "stage", lambda df, *args: staged.append(df) or write(df, *args))
    rows = spark.range(9).select(F.lit("a").alias("g"), F.when(F.col("id") != 3, F.col("id") * 2.0).alias("v"))
    got = audit.observed_distribution(rows, "v", ["g"]).first()
    assert tuple(got) == ("a", 0.0, 9.0, 16.0)
    assert staged and "Filter" not in staged[0]._jdf.queryExecution().optimizedPlan().toString()


def test_sanitise_case(spark):
    rows = cleaning.sanitise(raw(spark, [row(), row(**NO_CLOSE), row(**ADMIN), EMPTY, row(B365CH="5", B365CD="5", B365CA="5")])).cache()
    s = cleaning.sanitise_stats(rows).first()
    assert (s["input_rows"], s["output_rows"], s["excluded_rows"], s["has_real_close"], s["suspicious_odds"], s["has_shots"]) == (5, 3, 2, 2, 1, 3)
    assert {r["reason"]: r["rows"] for r in cleaning.exclusion_counts(rows).collect()} == {"EMPTY_ROW": 1, "ADMINISTRATIVE_CANDIDATE": 1}
    by_line = {r["_line"]: r for r in rows.collect()}
    assert by_line[1]["market_move_1"] is None and "MARKET_MOVE_AS_NAN_NO_REAL_CLOSE" in by_line[1]["transformaciones"]
    assert by_line[2]["transformaciones"] == ["EXCLUDED:ADMINISTRATIVE_CANDIDATE"] and by_line[2]["tiene_tiros"] is None


def test_administrative_needs_statistics_in_the_header(spark):
    header = [c for c in COLUMNS if c not in COLUMNS[6:18]]
    rows = cleaning.sanitise(raw(spark, [row(**ADMIN)], header))
    assert rows.first()["motivo_exclusion"] == "MISSING_REQUIRED_ODDS"


def test_alias_keeps_the_original(spark):
    r = cleaning.sanitise(raw(spark, [row(HomeTeam=" Leonesa "), row(AwayTeam="Celta")])).orderBy("_line").collect()
    assert (r[0]["HomeTeam"], r[0]["home_team_original"], r[1]["away_team_original"]) == ("Cultural Leonesa", "Leonesa", None)
    assert r[0]["transformaciones"][0] == "ALIAS_APPLIED:Leonesa->Cultural Leonesa"


def test_audit_case(spark):
    same = dict(B365CH="2.0", B365CD="3.0", B365CA="4.0")
    data = [row(**NO_CLOSE), row(HomeTeam="B", **same), row(HomeTeam="C", FTR="A", B365CH="5", B365CD="5", B365CA="5"),
            row(HomeTeam="D", Date="no-es-fecha"), row(HomeTeam="E", **ADMIN), EMPTY]
    facts = audit.row_facts(raw(spark, data), 0.8, 1.3).cache()
    c = audit.file_counters(facts).first()
    want = dict(raw=6, empty=1, usable=3, discarded=3, administrative=1, result_mismatches=1, equal_without_real_close=1,
                equal_with_real_close=1, overround_low=1, shot_rows_with_all_values=4, invalid_dates=1)
    assert {k: c[k] for k in want} == want
    assert {r["reason"]: r["rows"] for r in audit.reason_counts(facts).collect()} == {
        "EMPTY_ROW": 1, "INVALID_DATE": 1, "MISSING_REQUIRED_ODDS": 1}
    codes = {r["code"] for r in audit.history_findings(facts, 0.8, 1.3).collect()}
    assert codes == {"EMPTY_ROWS", "ROWS_DISCARDED", "RESULT_GOALS_MISMATCH", "DATE_INVALID", "SHOTS_VALUES_MISSING", "ODDS_OPEN_MISSING",
                     "ODDS_NO_REAL_CLOSE", "ODDS_OPEN_EQUALS_CLOSE_NO_REAL_CLOSE", "ODDS_OPEN_EQUALS_CLOSE_REAL", "ODDS_OVERROUND_OUT_OF_RANGE",
                     "SEASON_INCOMPLETE", "ADMINISTRATIVE_MATCH_CANDIDATE"}
    with pytest.raises(ValueError):
        audit.row_facts(raw(spark, data), 1.4, 1.0)


def test_feed_case(spark):
    cols = "match_id,date,league_name,league_season,round,status,home_name,away_name,home_goals,away_goals,sign".split(",")
    data = [("1", "2024-01-01", "La Liga", "2024", "R1", "Finished", "A", "B", "1", "0", "1"),
            ("2", "2024-01-01", "La Liga", "2024", "R1", "Finished", "A", "B", "1", "0", "1"),
            ("3", "2024-06-01", "La Liga", "2024", "Play-offs", "Cancelled", "C", "D", "", "", "")]
    facts = feed_audit.feed_facts(spark.createDataFrame(data, cols))
    s = feed_audit.feed_summary(facts).first()
    assert (s["non_finished"], s["playoffs"], s["without_goals"]) == (1, 1, 1)
    d = {r["kind"]: r for r in feed_audit.feed_duplicates(facts).collect()}
    assert (d["logical"]["groups"], d["logical"]["rows_involved"], d["logical"]["excess_rows"]) == (1, 2, 1)
    codes = {r["code"] for r in feed_audit.feed_findings(facts).collect()}
    assert {"HIGHLIGHTLY_NON_FINISHED", "HIGHLIGHTLY_PLAYOFF", "HIGHLIGHTLY_LOGICAL_DUPLICATE", "HIGHLIGHTLY_SEASON_INCOMPLETE"} <= codes


def test_encoding(spark):
    files = spark.createDataFrame([("a", bytearray(b"\xef\xbb\xbfx")), ("b", bytearray(b"\xff\xfe")), ("c", bytearray("�".encode()))], "path string, content binary")
    got = {r["path"]: (r["valid_utf8"], r["has_utf8_bom"], r["replacement_characters"]) for r in feed_audit.encoding_facts(files).collect()}
    assert got["a"] == (True, True, 0) and got["b"][0] is False and got["c"] == (True, False, 1)


def test_aliases(spark):
    df = spark.createDataFrame([("Málaga CF",), ("Real Sociedad B",), (" Unknown FC ",)], "n string")
    assert [r["n"] for r in names.resolve_names(df, ["n"]).collect()] == ["Malaga", "Sociedad B", "Unknown FC"]
    with pytest.raises(Exception, match="alias of two teams"):
        names.alias_table(spark, {"A": ["x"], "B": ["X."]}).collect()


def test_similar_names_equal_brute_force(spark):
    teams = ["Betis", "Real Betis", "Real Madrid", "Madrid", "Deportivo", "Deportivos", "Sporting Gijon", "Sporting Gijón", "Sportng Gijon", "Cadiz", "Cadis",
             "Club Cadiz", "Las Palmas", "Palmas Las", "Levante", "Levanto UD", "Levante UD", "FC", "Real"]
    df = spark.createDataFrame([(t,) for t in teams], "team string").withColumn("folded", text.fold_words(F.col("team")))
    got = {(r["left"], r["right"], r["method"]) for r in names.similar_name_pairs(df).collect()}
    folded = {r["team"]: r["folded"] for r in df.collect()}
    want = set()
    for a, b in itertools.combinations(sorted(teams), 2):
        x, y = set(folded[a].split()), set(folded[b].split())
        club = set(names.CLUB_WORDS)
        if (x < y and y - x <= club) or (y < x and x - y <= club):
            want.add((a, b, "tokens_with_club_qualifier"))
        elif SequenceMatcher(None, folded[a], folded[b]).ratio() >= 0.88:
            want.add((a, b, "high_string_similarity"))
    assert got == want


def _many_names(n=400):
    rng = random.Random(1)
    parts = "ca diz le van te ma la ga gi jon na va rra al me ri o vi edo ne fe hu es mur cia za go se lla bar ce lo ter uel".split()
    out = set()
    while len(out) < n:
        base = "".join(rng.choices(parts, k=rng.randint(2, 6))) + (" " + "".join(rng.choices(parts, k=rng.randint(1, 4))) if rng.random() < 0.4 else "")
        out |= {base, rng.choice(["real ", "cd ", "ud "]) + base if rng.random() < 0.2 else base}
        for _ in range(rng.randint(0, 2)):  # spelling variants
            t = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", "io"])
            out.add(" ".join("".join(t).split()) or base)
    return sorted(out)


def _similar(a, b):
    x, y, club = set(a.split()), set(b.split()), set(names.CLUB_WORDS)
    return (x < y and y - x <= club) or (y < x and x - y <= club) or SequenceMatcher(None, a, b).ratio() >= names.SIMILARITY


def test_similar_names_meet_by_segments(spark):
    teams = [*_many_names(), "a", "b", "ab", "real cd", "a" * 90 + "b", "a" * 91, "x" + "a" * 85]
    df = spark.createDataFrame([(t, t) for t in teams], "team string, folded string")
    every = list(itertools.combinations(sorted(teams), 2))
    want = {p for p in every if _similar(*p)}
    assert {(r["left"], r["right"]) for r in names.similar_name_pairs(df).collect()} == want
    assert names.name_candidates(df).count() < 0.05 * len(every) and len(want) > 100


def test_overlapping_names_leave_before_scoring(spark):
    teams = _many_names(60)
    rows = [(t, f"s{(n * 7 + k) % 5}") for n, t in enumerate(teams) for k in range(2)]
    frame = spark.createDataFrame(rows, "team string, season string")
    every, apart = names.alias_candidates(frame), names.alias_candidates(frame, keep_overlapping=False)
    pairs = lambda df: {(r["left"], r["right"], r["similarity"]) for r in df.collect()}
    assert pairs(apart) == pairs(every.filter(~F.col("overlaps"))) != pairs(every)
    assert not apart.filter("overlaps").count()


@pytest.mark.parametrize("limits", [(1024, 10_000), (4, 3)])
def test_exact_median_by_ranges(spark, monkeypatch, limits):
    import statistics

    from touchline.operators import ranks

    monkeypatch.setattr(ranks, "BINS", limits[0])
    monkeypatch.setattr(ranks, "SORTED_VALUES", limits[1])
    rng = random.Random(3)
    groups = {
        "even": [rng.random() for _ in range(400)], "odd": [rng.gauss(0, 1e6) for _ in range(301)], "ties": [1.0] * 500 + [rng.random() for _ in range(99)],
        "one": [-2.5], "two": [1.0, 4.0], "skewed": [1e-300 * 10**k for k in range(0, 300, 3)] + [-0.0, 0.0], "close": [1 + k * 2**-52 for k in range(50)], None: [3.0, 1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "division string, x double")
    got = {r["division"]: r["median"] for r in ranks.exact_median(df, "x", ["division"]).collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    assert [r["median"] for r in ranks.exact_median(df, "x").collect()] == [statistics.median(v for _, v in rows if v is not None)]
    assert ranks.exact_median(df.filter("false"), "x", ["division"]).count() == 0
    table = audit.observed_distribution(df, "x", ["division"])
    assert table.columns == ["division", "minimum", "median", "maximum"] and table.count() == len(groups)


def test_xg_window(spark):
    m = spark.createDataFrame([(1, "2024-01-01", "A", "B"), (2, "2024-02-01", "A", "B"), (3, "2024-03-01", "A", "B")], "match_id long, date string, home string, away string")
    m = m.withColumn("date", F.to_date("date"))
    x = [("2024-01-01", 1.0), ("2024-02-02", 2.0), ("2024-02-28", 3.0), ("2024-03-02", 4.0)]
    g = spark.createDataFrame([(d, "A", "B", v, v, v, v, v, v) for d, v in x], "date string, home string, away string, " + ", ".join(f"{c} double" for c in xg.XG))
    out = {r["match_id"]: r["home_xg"] for r in xg.merge_xg(m, g.withColumn("date", F.to_date("date"))).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: None}
    with pytest.raises(Exception, match="duplicate xG row"):
        xg.merge_xg(m, g.unionByName(g).withColumn("date", F.to_date("date"))).collect()
    assert xg.merge_xg(m, None).filter("home_xg is not null").count() == 0


def test_missing_matches(spark):
    h = spark.createDataFrame([("2025-08-15", "Ath Bilbao", "Celta")], "date string, home string, away string").withColumn("date", F.to_date("date"))
    f = spark.createDataFrame(
        [("1", "2025-08-15", "La Liga", "R1", "Athletic Club", "Celta de Vigo", "1", "0"), ("2", "2025-08-16", "Segunda División", "R1", "X", "Y", "0", "2")],
        "match_id string, date string, league_name string, round string, home_name string, away_name string, home_goals string, away_goals string")
    r = missing.missing_matches(f, h).collect()
    assert [(x["match_id"], x["division"], x["result"]) for x in r] == [(2, "Segunda", "A")]
    with pytest.raises(Exception, match="duplicate history match"):
        missing.missing_matches(f, h.unionByName(h)).collect()


def test_prior_mix_and_transition(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.5), (None, 0.0, 1.5), (1.0, 3.0, 1.5), (1.0, 1.0, None)], "ppg double, pj double, prior double")
    got = [r["x"] for r in df.select(priors.mix_prior(F.col("ppg"), F.col("pj"), F.col("prior")).alias("x")).collect()]
    assert got == [pytest.approx(2 / 3 + 0.5), 1.5, 1.0, 1.0]
    df = spark.createDataFrame([("La Liga", "p", "Segunda Division", 40), ("La Liga", "ascendido_primera_rfef", None, 0), ("La Liga", "p", "La Liga", 40)],
                               "t string, s string, l string, n int")
    keys = [r["k"] for r in df.select(priors.transition(*[F.col(c) for c in "tsln"]).alias("k")).collect()]
    assert keys == ["segunda_a_primera", "primera_rfef_a_segunda", "misma_categoria"]


def test_csv_files_with_different_headers(spark, tmp_path):
    for folder, name, lines in (("PRIMERA", "SP1_1819.csv", ["Date,HomeTeam,HS", "01/09/2018,A,3"]), ("SEGUNDA", "SP2_1920.csv", ["﻿Date,AwayTeam,HomeTeam", "02/09/2019,C,B"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = {r["HomeTeam"]: r for r in readers.read_raw_history(spark, str(tmp_path)).collect()}
    assert (rows["A"]["_season"], rows["A"]["_division"], rows["A"]["HS"], rows["A"]["AwayTeam"]) == ("2018-2019", "Primera", "3", None)
    assert (rows["B"]["_division"], rows["B"]["AwayTeam"], rows["B"]["_columns"]) == ("Segunda", "C", ["Date", "AwayTeam", "HomeTeam"])


def test_headers_are_matched_by_name(spark, tmp_path):
    files = {
        "a": ['', '"Date","Odds, open",Odds,,Odds', '01/09/2018,"1,5",2,x,3,beyond', '02/09/2018,"say ""hi"""'],
        "b": ["\ufeffOdds,Date\r", "7,03/09/2018\r"],
        "c": ["Date"],
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = {r["Date"]: r for r in readers.read_raw_history(spark, str(tmp_path)).collect()}
    assert rows["01/09/2018"]["_columns"] == ["Date", "Odds, open", "Odds", "unnamed_1", "Odds_2"]
    first = rows["01/09/2018"]
    assert (first["Odds, open"], first["Odds"], first["unnamed_1"], first["Odds_2"]) == ("1,5", "2", "x", "3")
    assert rows["02/09/2018"]["Odds"] is None and rows["03/09/2018"]["Odds"] == "7" and rows["03/09/2018"]["Odds, open"] is None
    assert len(rows) == 3 and rows["03/09/2018"]["_columns"] == ["Odds", "Date"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_raw_history(spark, str(tmp_path / "none"))


def test_documents_by_line(spark, tmp_path):
    (tmp_path / "days.json").write_text('{"jornada": 1, "partidos": [{"num": 1}]}\n{"jornada": 2, "partidos": [{"num": 1}, {"num": 2}]}\n')
    rows = readers.read_matchdays(spark, str(tmp_path / "days.json"), lines=True)
    assert sorted((r["jornada"], r["num"]) for r in rows.collect()) == [(1, 1), (2, 1), (2, 2)]


def test_outputs_are_never_overwritten(spark, tmp_path):
    rows = cleaning.sanitise(raw(spark, [row(), EMPTY]))
    out = writers.write_sanitised(rows, str(tmp_path / "out"))
    again = spark.read.option("header", "true").csv(out["historico_saneado"])
    assert again.columns[:2] == ["tiene_cierre_real", "tiene_tiros"] and again.count() == 1
    with pytest.raises(FileExistsError):
        writers.write_sanitised(rows, str(tmp_path / "out"))
    assert spark.read.json(out["manifiesto"]).first()["excluded_rows"] == 1


def test_a_failure_leaves_no_output(spark, tmp_path, monkeypatch):
    rows = cleaning.sanitise(raw(spark, [row(), EMPTY]))
    out = tmp_path / "out"
    left = lambda: sorted(p.name for p in out.iterdir()) if out.exists() else []

    with monkeypatch.context() as broken:  # the third part fails while it is written
        broken.setattr(cleaning, "sanitise_stats", lambda _: rows.select(F.raise_error(F.lit("lost")).alias("x")))
        with pytest.raises(Exception, match="lost"):
            writers.write_sanitised(rows, str(out))
    assert left() == []

    with monkeypatch.context() as raced:  # the third target appears after all parts are written
        check, calls = writers.require_absent, []

        def late(session, paths):
            calls.append(1)
            if len(calls) == 2:
                raise FileExistsError("not overwritten: somebody else")
            check(session, paths)

        raced.setattr(writers, "require_absent", late)
        with pytest.raises(FileExistsError):
            writers.write_sanitised(rows, str(out))
    assert left() == []

    with monkeypatch.context() as stuck:  # the third rename fails: the two before are taken back
        located, renames = writers._located, []

        class Files:
            def __init__(self, inner):
                self.inner = inner

            def __getattr__(self, name):
                return getattr(self.inner, name)

            def rename(self, a, b):
                renames.append(b)
                return len(renames) < 3 and self.inner.rename(a, b)

        stuck.setattr(writers, "_located", lambda s, p: (Files((at := located(s, p))[0]), at[1]))
        with pytest.raises(OSError, match="not renamed"):
            writers.write_sanitised(rows, str(out))
    assert len(renames) == 3 and left() == []
    assert set(writers.write_sanitised(rows, str(out))) == set(writers.SANITISE_OUTPUTS) == set(left())


def test_every_writer_refuses_a_second_run(spark, tmp_path):
    predictions = spark.createDataFrame([(1, "2018-2019", float("nan"))], "match_id long, season string, p double")
    days = spark.createDataFrame([(74, "x")], "jornada int, note string")
    absent = spark.createDataFrame([("2019-01-01", "Primera", "a")], "date string, division string, home string")
    for again in (False, True):
        for write in (
            lambda: writers.write_backtest(predictions, predictions, f"{tmp_path}/backtest"),
            lambda: writers.write_matchdays(days, f"{tmp_path}/days/"),
            lambda: writers.write_missing(absent, f"{tmp_path}/missing"),
        ):
            if again:
                with pytest.raises(FileExistsError):
                    write()
            else:
                write()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["backtest", "days", "missing"]
    assert sorted(p.name for p in (tmp_path / "backtest").iterdir()) == ["metrics", "predictions"]
    assert spark.read.json(f"{tmp_path}/days").first()["jornada"] == 74
    assert spark.read.parquet(f"{tmp_path}/backtest/predictions").first()["season"] == "2018-2019"


def test_matchday_json(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"jornada": 74, "partidos": [{"num": 1, "local": "Kristiansund", "q15": {"1": 69, "X": 19, "2": 12}, "apu": null}, {"num": 15, "q15": null}]}')
    rows = {r["num"]: r for r in readers.read_matchdays(spark, str(tmp_path / "j.json")).collect()}
    assert rows[1]["q15"]["1"] == 69.0 and rows[1]["apu"] is None and rows[15]["q15"] is None and rows[1]["jornada"] == 74


def test_repeated_predictions_are_refused(spark):
    a = spark.createDataFrame([("d", "P", "a", "b", "1", 1), ("d", "P", "a", "b", "1", 2)], "date string, division string, home string, away string, result string, v int")
    with pytest.raises(Exception, match="duplicate prediction"):
        compare.align(a, a).collect()
