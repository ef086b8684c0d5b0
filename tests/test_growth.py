"""Steps whose cost grew faster than their input: what they return and the plan they run."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.catalog import feature_tables, file_sources, views
from touchline.functions import text
from touchline.operators import blend, cleaning, elo, features
from touchline.schemas import FEATURE_TABLE_COLUMNS
from touchline.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def source_rows(rng, n):
    names = [f"{s}_{c}" for s in ("logit_prob", "hgb_prob", "market", "poisson") for c in ("1", "x", "2")]
    out = []
    for i in range(n):
        p = {c: rng.choice([0.1, 0.25, 0.3, 0.5, 0.0, rng.random()]) for c in names}
        p |= {c: None for c in names if rng.random() < 0.04}
        out.append({"match_id": i, "date": f"2001-01-{i % 9 + 1:02d}", "division": rng.choice(["Primera", "Segunda"]), "home": f"a{i % 9}", "away": f"b{i % 7}",
                    "season": rng.choice(["s1", "s2"]), "result": rng.choice(["1", "X", "2", None, ""])} | p)
    kinds = ["match_id long", "date string", *[f"{c} string" for c in ("division", "home", "away", "season", "result")], *[f"{c} double" for c in names]]
    return out, ", ".join(kinds)


def judged(m, c):
    """Prediction, its confidence, score and double of one match, in plain Python."""
    w = c["weights"]
    parts = []
    for s in ("1", "x", "2"):
        own = [m[f"logit_prob_{s}"], m[f"hgb_prob_{s}"]]
        parts.append(None if None in own else w["logit"] * own[0] + w["hgb"] * own[1] + w["market"] * (m[f"market_{s}"] or 0.0) + w["poisson"] * (m[f"poisson_{s}"] or 0.0))
    if parts[1] is not None:
        parts[1] += c["draw_boost"] + (c["segunda_draw_boost"] if m["division"] == "Segunda" else 0.0)
    total = sum(p or 0.0 for p in parts)
    p = [None if x is None or total == 0 else x / total for x in parts]
    known = [x for x in p if x is not None]
    if not known:
        return None, 0.0, -1e9, ""
    top = p.index(max(known))
    ge = lambda i, j: p[i] is not None and p[j] is not None and p[i] >= p[j]
    second = (1 if ge(1, 2) else 2) if top == 0 else (0 if ge(0, 2) else 2) if top == 1 else (0 if ge(0, 1) else 1)
    signs = "1X2"
    by_draw = p[1] is not None and p[1] >= c["double_draw_threshold"] and top != 1
    double = ("1X" if top == 0 else "X2") if by_draw else "".join(s for i, s in enumerate(signs) if i in (top, second))
    market = [m[f"market_{s}"] for s in ("1", "x", "2")]
    favourite = None if None in market else signs[market.index(max(market))]
    pred = signs[top]
    if c["x_disagreement_strategy"] == "market_pick_only" and pred == "X" and favourite not in (None, "X"):
        pred = favourite
    gaps = [(m[f"logit_prob_{s}"], m[f"hgb_prob_{s}"]) for s in ("1", "x", "2")]
    if p[1] is None or any(None in g for g in gaps):
        return pred, max(known), -1e9, double
    gap = sum(abs(a - b) for a, b in gaps) / 3.0
    bonus = c["double_segunda_bonus"] if m["division"] == "Segunda" else 0.0
    return pred, max(known), (1 - max(known)) + c["double_draw_weight"] * p[1] + c["double_disagreement_weight"] * gap + bonus, double


def test_configs_equal_plain_loops_without_unfolding_them(spark):
    """F8: configurations multiplied the rows and were worked out by interpreted functions over nested arrays."""
    rows, schema = source_rows(random.Random(8), 400)
    configs = blend.candidate_configs()[::5] + [
        blend.make_config({"logit": 0.4, "hgb": 0.3, "market": 0.2, "poisson": 0.1}, draw_boost=0.05, segunda_draw_boost=0.02, x_disagreement_strategy="market_pick_only")
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("date", F.col("date").cast("date"))
    found = blend.evaluate_configs(blend.with_market_baseline(df), configs)
    got = {(r["season"], r["config_id"]): r for r in found.collect()}
    assert len(got) == 2 * len(configs)
    for season in ("s1", "s2"):
        own = sorted((r for r in rows if r["season"] == season), key=lambda r: (r["date"], r["division"], r["home"], r["away"], r["match_id"]))
        for i, c in enumerate(configs):
            all_judged = [(*judged(m, c), m["result"]) for m in own]
            r = got[season, i]
            assert r["matches"] == len(own)
            assert r["accuracy_simple"] == pytest.approx(sum(j[0] is not None and j[0] == j[4] for j in all_judged) / len(own))
            assert r["avg_confidence"] == pytest.approx(sum(j[1] for j in all_judged) / len(own))
            draws = [j for j in all_judged if j[0] == "X"]
            assert r["accuracy_pick_x"] == (pytest.approx(sum(j[4] == "X" for j in draws) / len(draws)) if draws else None)
            hits = []
            for at in range(0, len(own) - 14, 15):
                block = sorted(range(at, at + 15), key=lambda k: (-all_judged[k][2], k))
                hits.append(sum(all_judged[k][4] is not None and all_judged[k][4] in all_judged[k][3] for k in block[:3])
                            + sum(all_judged[k][0] is not None and all_judged[k][0] == all_judged[k][4] for k in block[3:]))
            assert r["mean_hits_3_dobles"] == pytest.approx(sum(hits) / len(hits)) and r["best_jornada_3_dobles"] == max(hits)
    assert "Generate" not in plan(found) and "transform(" not in plan(found)


def longest_method(df):
    """Bytecode of the longest method of fused code: beyond 8,000 bytes the JVM never compiles it."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenString(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


SF = "/root/testdata/sf0.001"


def test_reading_of_raw_rows_is_compiled_and_done_once(spark):
    """the filter on whole rows repeated every reading, in one method of 46,733 bytes."""
    raw = views.raw_history(spark, SF)
    typed = cleaning.typed_matches(raw)
    assert longest_method(raw) < 8000 and longest_method(typed) < 8000
    assert plan(typed).count("transform(") == 1


def test_folding_leaves_single_spaces_and_plain_letters_alone(spark):
    """each space was a match of its own, and each plain letter met a class of hundreds of characters."""
    texts = ["", " ", "a", " a  b\tc \n d", "ﬁn  Ǆ…½", "É.é\x1cx\x1fy", "Straße  ẞ", "a\x0bb\x0cc\rd", "a\x00\x7fb", "…", "a - b_c", "\t", "x y", "Ł Ø ¼ z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = lambda c: F.regexp_replace(F.translate(expanded(c), text._FOLD_FROM, text._FOLD_TO), r"\p{M}+", "")

    def expanded(c):
        for char, plain in text._FOLD_LONGER:
            c = F.replace(c, F.lit(char), F.lit(plain))
        return c

    t = F.col("t")
    want = {
        "name": F.trim(F.regexp_replace(F.replace(F.lower(strip(t)), F.lit("."), F.lit("")), r"[\s\u001c-\u001f]+", " ")),
        "words": F.trim(F.regexp_replace(strip(F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))), "[^a-z0-9]+", " ")),
        "key": F.regexp_replace(F.lower(strip(t)), "[^a-z0-9]", ""),
    }
    for name, fold in (("name", text.fold_name), ("words", text.fold_words), ("key", text.fold_key)):
        found = rows.select(fold(t).alias("found"), want[name].alias("want")).collect()
        assert [r["found"] for r in found] == [r["want"] for r in found]


def test_published_rows_are_derived_and_judged_once(spark, monkeypatch, tmp_path):
    """rows were derived for each kind of header and judged for each output again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return df.mapInArrow(run, df.schema)

    raw = views.raw_history(spark, SF)
    n = raw.count()
    monkeypatch.setattr(views, "raw_history", lambda *_: counted(raw))
    file_sources.history_files(spark, SF)
    assert seen.value == n
    writers.write_sanitised(counted(cleaning.sanitise(raw)), str(tmp_path / "out"))
    assert seen.value == 2 * n


def test_feature_formulas_are_compiled(spark):
    """F12, F16: all formulas and roundings of the feature table were one method of 33,407 bytes, which the JVM never compiles."""
    kinds = ", ".join(f"`{c}` {'date' if c == 'date' else 'double'}" for c in FEATURE_TABLE_COLUMNS)
    row = tuple(date(2001, 1, 1) if c == "date" else 1.5 for c in FEATURE_TABLE_COLUMNS)
    known = spark.createDataFrame([(1, *row)], f"match_id long, {kinds}")
    out = feature_tables._compared(features.with_derived(known), "match_id")
    assert longest_method(out) < 8000
    r = out.first()
    assert r["date"] == date(2001, 1, 1) and (r["lambda_home"], r["elo_diff"], r["market_1"]) == (0.975, 55.0, 0.333333)


def test_rounding_takes_halves_away_from_zero(spark):
    """F12, F16: the rounding in plain arithmetic, as the oracle has it."""
    values = [1 / 128, -1 / 128, 0.0, -0.0, 1e-9, 2.5, None, float("nan"), float("inf"), float("-inf"), 1e15 + 0.3, 123.4567891, -123.4567891]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(feature_tables._rounded("v")).collect()]
    assert [str(v) for v in got] == ["0.007813", "-0.007813", "0.0", "0.0", "0.0", "2.5", "None", "nan", "inf", "-inf", str(1e15 + 0.3), "123.456789", "-123.456789"]


def league_rows(seed, n=500):
    rng, rows = random.Random(seed), []
    for i in range(n):
        h, a = rng.sample(["A", "B", "C", "D", "E", None], 2)
        score = None if rng.random() < 0.1 else rng.randrange(3)
        rows.append(((1 << 60) + i, rng.choice([None, date(2020, 1, 1)]) if rng.random() < 0.02 else date(2019, 12, 1) + timedelta(days=rng.randrange(60)), rng.choice(["x", "y", None]),
                     "s", h, a, None if score is None else 1, 1, None if score is None else "1X2"[score]))
    return rows, "match_id long, date date, division string, season string, home string, away string, FTHG int, FTAG int, result string"


@pytest.mark.parametrize("pool", ["division", None])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_ratings_by_day_equal_ratings_by_match(spark, pool, batch):
    """F12, F16: a row a match went through two tasks and was joined again by match; a team and day needs one."""
    rows, schema = league_rows(12)
    df = spark.createDataFrame(rows, schema)
    want, order = {}, lambda r: (r["date"] or date.min, r["division"] or "", r["home"] or "", r["away"] or "", r["match_id"])
    found = {r["match_id"]: r for r in elo.elo_ratings(df, pool).collect()}
    for r in sorted((r.asDict() for r in df.collect()), key=order):
        e, day = found[r["match_id"]], r["date"] and (r["date"] - date(1970, 1, 1)).days
        for side in ("home", "away"):
            key = (r["division"] if pool else "all", r[side], -(1 << 31) if day is None else day)
            before, after, last = want.get(key, (e[f"{side}_elo"], e[f"{side}_elo"], None))
            if r["result"]:
                after, last = e[f"{side}_elo_after"], r["match_id"]
            want[key] = (before, after, last)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = elo.elo_days(df, pool).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["pool"], r["team"], r["day"]): (r["before"], r["after"], r["match_id"]) for r in got} == want and len(got) == len(want)


def test_feature_table_reads_ratings_by_team_and_day(spark):
    """the ratings were joined by match, which sorted and moved all rows with all their columns."""
    rows, schema = league_rows(13, 60)
    assert "match_id" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan(features.with_elo(spark.createDataFrame(rows, schema), "division"))))


def test_settled_tables_are_looked_up(spark, monkeypatch):
    """F16: the places of every match were worked out by its order in the matchday, though teams enter in few matchdays only."""
    rows = [(i, date(2020, 8, 1) + timedelta(days=i // 3), "Primera", "2020-2021", *random.Random(i).sample("ABCD", 2), 1, i % 3, "1" if i % 3 == 0 else "X" if i % 3 == 1 else "2") for i in range(180)]
    history = spark.createDataFrame(rows, "match_id long, date date, division string, season string, home string, away string, FTHG int, FTAG int, result string")
    upcoming = history.select("match_id", F.col("match_id").alias("num"), "home", "away", "date", F.lit("").alias("division"), F.lit("").alias("season"), F.trunc("date", "month").alias("cutoff"))
    seen, whole = [], features.form.positions_with_newcomers
    monkeypatch.setattr(features.form, "positions_with_newcomers", lambda shown, group: (seen.append(shown.select("match_id").distinct().count()), whole(shown, group))[1])
    got = {r["match_id"]: r for r in features.matchday_features(upcoming, history, ["cutoff"]).collect()}
    assert len(got) == 180 and seen == [93]  # the matches of August
    for i, r in got.items():
        before = [m for m in rows if m[1] < rows[i][1].replace(day=1)]
        points = {t: (sum((3 if m[8] == "1" else m[8] == "X") * (m[4] == t) + (3 if m[8] == "2" else m[8] == "X") * (m[5] == t) for m in before),
                      sum((m[6] - m[7]) * ((m[4] == t) - (m[5] == t)) for m in before), sum(m[6] * (m[4] == t) + m[7] * (m[5] == t) for m in before)) for t in "ABCD"}
        if before:
            order = sorted("ABCD", key=lambda t: (*[-v for v in points[t]], t))
            assert (r["home_table_pos"], r["away_table_pos"]) == (order.index(rows[i][4]) + 1, order.index(rows[i][5]) + 1)
