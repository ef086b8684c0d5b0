"""Queries over score models, blends, doubles and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog import views
from touchline.catalog.raw_data import FACTS
from touchline.catalog.registry import query, r6
from touchline.functions import probability as pr
from touchline.functions import scores as sc
from touchline.operators import blend, cleaning, compare, metrics, models, ordinal
from touchline.plans import backtests

S = f"with s as ({views.SOURCES_SQL})"
RHO = -0.036
# Source means: home and away goals expected from the keys, so that every match has them.
_GOALS = "cast(0.4 + (match_id % 23) / 10.0 as double) as lh, cast(0.3 + (cust % 17) / 10.0 as double) as la"
GRID = f"""with m as ({views.MATCHES_SQL}), l as (select match_id, season, division, fthg, ftag, result, {_GOALS} from m), k as (select unnest(range(8)) as g),
c as (select l.*, a.g as hg, b.g as ag, exp(-lh) * pow(lh, a.g) / factorial(cast(a.g as int)) * exp(-la) * pow(la, b.g) / factorial(cast(b.g as int)) as base from l, k a, k b),
q as (select *, greatest(base * case when hg = 0 and ag = 0 then 1 - lh * la * ({RHO}) when hg = 1 and ag = 0 then 1 + lh * ({RHO}) when hg = 0 and ag = 1 then 1 + la * ({RHO})
    when hg = 1 and ag = 1 then 1 - ({RHO}) else 1 end, 1e-15) as w from c),
p as (select *, w / sum(w) over (partition by match_id) as p from q),
rk as (select *, row_number() over (partition by match_id order by round(p, 12) desc, hg, ag) as r from p)
"""


def goal_means(spark: SparkSession, sf: str) -> DataFrame:
    m = views.matches(spark, sf)
    return m.withColumns(
        {
            "lambda_home": F.lit(0.4) + (F.col("match_id") % 23) / 10.0,
            "lambda_away": F.lit(0.3) + (F.col("cust") % 17) / 10.0,
        }
    )


@query("F9 J20", GRID + """
select match_id, round(sum(case when hg > ag then p else 0 end), 6) as dc_1, round(sum(case when hg = ag then p else 0 end), 6) as dc_x,
  round(sum(case when hg < ag then p else 0 end), 6) as dc_2 from p group by match_id""")
def dixon_coles_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    parts = sc.dixon_coles_1x2(F.col("lambda_home"), F.col("lambda_away"), RHO)
    return goal_means(spark, sf).select("match_id", *[F.round(p, 6).alias(f"dc_{s}") for p, s in zip(parts, ("1", "x", "2"))])


@query("F9 F12 T2", GRID + """
select match_id, string_agg(concat(hg, '-', ag), '|' order by r) as top_scores, round(max(case when r = 1 then p end), 6) as best_prob,
  round(max(lh), 6) as lambda_home from rk where r <= 3 group by match_id""")
def score_forecast(spark: SparkSession, sf: str) -> DataFrame:
    out = backtests.with_score_forecast(goal_means(spark, sf), RHO, max_goals=7)
    top = F.from_json("pleno15_top_scores", "array<struct<score:string,prob:double>>")
    return out.select(
        "match_id", F.array_join(F.transform(top, lambda t: t["score"]), "|").alias("top_scores"),
        r6("pleno15_confianza", "best_prob"), r6("pleno15_local_goles_esperados", "lambda_home"),
    )


@query("F10 F11", GRID + """, b as (select match_id, least(hg, 3) as b, round(sum(p), 4) as p from p group by 1, 2),
o as (select *, row_number() over (partition by match_id order by p desc, b) as r from b)
select match_id, string_agg(cast(p as varchar), '|' order by b) as buckets_n, max(case when r = 1 then case b when 3 then 'M' else cast(b as varchar) end end) as main,
  case when max(case when r = 1 then p end) - max(case when r = 2 then p end) < 0.10 then max(case when r = 2 then case b when 3 then 'M' else cast(b as varchar) end end) end as alternative
from o group by match_id""".replace("string_agg(cast(p as varchar), '|' order by b) as buckets_n", "round(max(case when b = 0 then p end), 4) as p0, round(max(case when b = 3 then p end), 4) as pm"))
def goal_buckets(spark: SparkSession, sf: str) -> DataFrame:
    out = sc.with_score_cells(goal_means(spark, sf), RHO).withColumn("b", sc.bucket_probs(F.col("cells"), "hg"))
    out = out.withColumn("pick", sc.pick_bucket(F.col("b")))
    return out.select("match_id", F.col("b")[0].alias("p0"), F.col("b")[3].alias("pm"), F.col("pick.main").alias("main"),
                      F.col("pick.alternative").alias("alternative"))


@query("E8", GRID + """
select division, count(*) as matches, round(avg(case when e.r = 1 then 1 else 0 end), 6) as exact, round(avg(case when e.r <= 3 then 1 else 0 end), 6) as in_top
from rk e where e.hg = least(e.fthg, 7) and e.ag = least(e.ftag, 7) group by division""")
def score_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    top = sc.with_score_cells(goal_means(spark, sf), RHO).withColumn("top", sc.top_scores(F.col("cells"), 3))
    return metrics.score_hits(top, ["division"]).select("division", "matches", r6("exact"), r6("in_top"))


@query("E9 J13", GRID.split(", k as")[0] + """
select season, round(avg(-ln(least(greatest(exp(-lh) * pow(lh, fthg) / factorial(fthg) * exp(-la) * pow(la, ftag) / factorial(ftag), 1e-10), 1.0))), 6) as score_log_loss
from l group by season""")
def score_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.score_log_loss(F.col("FTHG"), F.col("FTAG"), F.col("lambda_home"), F.col("lambda_away"))
    return goal_means(spark, sf).groupBy("season").agg(F.round(F.avg(loss), 6).alias("score_log_loss"))


_STEPS = "select unnest(range(41)) as step"


_RHO = f"""with m as ({views.MATCHES_SQL}), l as (select season, fthg, ftag, {_GOALS} from m), k as (select unnest(range(8)) as g), st as ({_STEPS}),
h as (select *, row_number() over () as i from l),
c as (select h.i, h.season, h.fthg, h.ftag, st.step, a.g as hg, b.g as ag, greatest(exp(-lh) * pow(lh, a.g) / factorial(cast(a.g as int)) * exp(-la) * pow(la, b.g) / factorial(cast(b.g as int))
    * case when a.g = 0 and b.g = 0 then 1 - lh * la * (-0.3 + 0.01 * step) when a.g = 1 and b.g = 0 then 1 + lh * (-0.3 + 0.01 * step)
      when a.g = 0 and b.g = 1 then 1 + la * (-0.3 + 0.01 * step) when a.g = 1 and b.g = 1 then 1 - (-0.3 + 0.01 * step) else 1 end, 1e-15) as w
  from h, st, k a, k b),
t as (select i, season, step, sum(w) as tot, sum(case when hg = least(fthg, 7) and ag = least(ftag, 7) then w end) as own from c group by i, season, step)"""


@query("M8 J19", _RHO + """
select cast(step as int) as step, round(sum(ln(own / tot)), 4) as log_likelihood, count(*) as matches from t group by step""")
def rho_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    out = models.rho_likelihoods(goal_means(spark, sf))
    return out.select("step", F.round("log_likelihood", 4).alias("log_likelihood"), "matches")


@query("M8 M19", _RHO + """
, sm as (select season, step, round(sum(ln(own / tot)), 9) as ll, count(*) as n from t group by season, step),
b as (select *, row_number() over (partition by season order by ll desc, step) as k from sm)
select season, n as matches, round(case when n >= 200 then -0.3 + 0.01 * step else -0.036 end, 6) as rho from b where k = 1""")
def rho_by_season(spark: SparkSession, sf: str) -> DataFrame:
    return models.best_rho(goal_means(spark, sf), ["season"]).select("season", "matches", r6("rho"))


# ---------------------------------------------------------------------------
# Blends and picks
# ---------------------------------------------------------------------------

BASE = S + """, b as (select *, case when market_1 is not null and market_x is not null and market_2 is not null then
    case when market_1 >= market_x and market_1 >= market_2 then '1' when market_x >= market_2 then 'X' else '2' end end as fav from s)"""
# Uneven weights: equal sums of different terms do not occur, so picks do not hang on rounding.
_W = {"logit": 0.3517, "hgb": 0.2071, "market": 0.2983, "poisson": 0.1429}


def blend_sql(w: dict[str, float], boost: float, segunda: float, name: str = "bl", source: str = "b") -> str:
    def part(s: str, extra: str = "") -> str:
        return (f"{w['logit']} * logit_prob_{s} + {w['hgb']} * hgb_prob_{s} + {w['market']} * coalesce(market_{s}, 0) + "
                f"{w['poisson']} * coalesce(poisson_{s}, 0){extra}")
    x = part("x", f" + {boost} + case when division = 'Segunda' then {segunda} else 0 end")
    return (f", {name}_0 as (select *, {part('1')} as a1, {x} as ax, {part('2')} as a2 from {source}), "
            f"{name} as (select *, a1 / (a1 + ax + a2) as p1, ax / (a1 + ax + a2) as px, a2 / (a1 + ax + a2) as p2, "
            "(abs(logit_prob_1 - hgb_prob_1) + abs(logit_prob_x - hgb_prob_x) + abs(logit_prob_2 - hgb_prob_2)) / 3 as gap "
            f"from {name}_0)")


_PRED = "case when p1 >= px and p1 >= p2 then '1' when px >= p2 then 'X' else '2' end"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return blend.with_market_baseline(views.matches_with_sources(spark, sf))


_CONFIG = blend.make_config(_W, draw_boost=0.013, segunda_draw_boost=0.0071, x_disagreement_strategy="market_pick_only")


@query("P23 P24 P45", BASE + blend_sql(_W, 0.013, 0.0071) + f""", c as (select *, {_PRED} as top from bl)
select match_id, round(p1, 6) as prob_1, round(px, 6) as prob_x, round(p2, 6) as prob_2, fav as favorite_market,
  cast(case when fav = result then 1 else 0 end as int) as favorite_market_hit, case when top = 'X' and fav is not null and fav <> 'X' then fav else top end as pred,
  round(gap, 6) as model_disagreement from c""")
def blended_predictions(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.apply_config(sources(spark, sf), _CONFIG, "b")
    return out.select(
        "match_id", r6("b_prob_1", "prob_1"), r6("b_prob_x", "prob_x"), r6("b_prob_2", "prob_2"), "favorite_market", "favorite_market_hit",
        F.col("b_pred").alias("pred"), r6("model_disagreement"),
    )


@query("F13 F14 T3", BASE + blend_sql(_W, 0.013, 0.0071) + """, u as (select *, p1 as r1, px as rx, p2 as r2 from bl)
select match_id, case when px >= 0.3 and not (rx > r1 and rx >= r2) then case when r1 >= rx and r1 >= r2 then '1X' else 'X2' end
    else case when r1 >= r2 and rx >= r2 then '1X' when r1 >= rx and r2 > rx then '12' when r1 >= rx then '1X' else 'X2' end end as double_pick,
  round((1 - greatest(p1, px, p2)) + 0.7 * px + 0.2 * gap + case when division = 'Segunda' then 0.05 else 0 end, 6) as double_value_score from u""")
def doubles_and_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.apply_config(sources(spark, sf), _CONFIG, "b")
    p = [F.col(f"b_prob_{s}") for s in ("1", "x", "2")]
    score = blend.double_value_score(*p, F.col("model_disagreement"), F.col("division"), 0.7, 0.2, 0.05)
    return out.select("match_id", pr.double_for(*p, 0.3).alias("double_pick"), F.round(score, 6).alias("double_value_score"))


_DOUBLES_SQL = """, z as (select *, case when top = 'X' and fav is not null and fav <> 'X' then fav else top end as pred from (select *, {pred} as top from bl) y),
o as (select *, row_number() over (partition by season order by match_date, division, home, away, match_id) - 1 as pos, count(*) over (partition by season) as n from z),
g as (select *, floor(pos / 15) + 1 as block, p1 as r1, px as rx, p2 as r2,
    (1 - greatest(p1, px, p2)) + 0.7 * px + 0.2 * gap + case when division = 'Segunda' then 0.05 else 0 end as score from o where (floor(pos / 15) + 1) * 15 <= n),
h as (select *, row_number() over (partition by season, block order by score desc, pos) as k,
    case when px >= 0.3 and not (rx > r1 and rx >= r2) then case when r1 >= rx and r1 >= r2 then '1X' else 'X2' end
    else case when r1 >= r2 and rx >= r2 then '1X' when r1 >= rx and r2 > rx then '12' when r1 >= rx then '1X' else 'X2' end end as dbl from g)
""".replace("{pred}", _PRED)


@query("W11 W12 F15", BASE + blend_sql(_W, 0.013, 0.0071) + _DOUBLES_SQL + """
select season, cast(block as bigint) as block, cast(sum(case when k <= 3 then case when contains(dbl, result) then 1 else 0 end when pred = result then 1 else 0 end) as bigint) as hits_3_dobles
from h group by season, block""")
def doubles_hits(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.apply_config(sources(spark, sf), _CONFIG, "b")
    hits = blend.simulate_doubles(out, "b", _CONFIG, ["season"])
    return hits.select("season", F.col("block").cast("bigint").alias("block"), "hits_3_dobles")


@query("A1 A2 E4", BASE + blend_sql(_W, 0.013, 0.0071) + _DOUBLES_SQL + """, a as (select season, count(*) as matches, avg(case when pred = result then 1.0 else 0 end) as acc,
    avg(case when fav = result then 1.0 else 0 end) as mkt, avg(greatest(p1, px, p2)) as conf, avg(case when pred = 'X' then case when result = 'X' then 1.0 else 0 end end) as ax from z group by season),
d as (select season, avg(hits) as mh, max(hits) as bh from (select season, block, sum(case when k <= 3 then case when contains(dbl, result) then 1 else 0 end when pred = result then 1 else 0 end) as hits
    from h group by season, block) q group by season)
select a.season, a.matches, round(a.acc, 6) as accuracy_simple, round(a.mkt, 6) as accuracy_market_favorite, round(a.conf, 6) as avg_confidence, round(a.ax, 6) as accuracy_pick_x,
  round(d.mh, 6) as mean_hits_3_dobles, cast(d.bh as int) as best_jornada_3_dobles, round(a.acc + 0.017 * coalesce(d.mh, 0), 6) as score
from a left join d on d.season = a.season""")
def config_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.evaluate_configs(sources(spark, sf), [_CONFIG], ["season"])
    return out.select(
        "season", F.col("matches").cast("bigint").alias("matches"), r6("accuracy_simple"), r6("accuracy_market_favorite"), r6("avg_confidence"),
        r6("accuracy_pick_x"), r6("mean_hits_3_dobles"), F.col("best_jornada_3_dobles").cast("int").alias("best_jornada_3_dobles"), r6("score"),
    )


@query("J18 M9 A3 T5")
def config_grid(spark: SparkSession, sf: str) -> DataFrame:
    per_season = blend.evaluate_configs(sources(spark, sf), blend.candidate_configs(), ["season"])
    return blend.rank_configs(per_season).select("config_id", r6("mean_score"), r6("std_score"), "splits", r6("final_metric"))


@query("A1 E4", BASE + blend_sql(_W, 0.013, 0.0071) + f""", c as (select *, {_PRED} as top from bl), d as (select *, case when top = 'X' and fav is not null and fav <> 'X' then fav else top end as pred from c)
select division, count(*) as matches, round(avg(case when pred = result then 1.0 else 0 end), 6) as accuracy_simple, round(avg(case when fav = result then 1.0 else 0 end), 6) as accuracy_market_favorite
from d group by division""")
def division_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.division_breakdown(blend.apply_config(sources(spark, sf), _CONFIG, "b"), "b")
    return out.select("division", "matches", r6("accuracy_simple"), r6("accuracy_market_favorite"))


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------

_SOURCES = {"logit": "logit_prob", "hgb": "hgb_prob", "market": "market", "poisson": "poisson"}
_LONG = " union all ".join(
    f"select match_id, season, division, result, '{n}' as candidate, {c}_1 as p1, {c}_x as px, {c}_2 as p2 from s where {c}_1 is not null" for n, c in _SOURCES.items()
)
LONG = S + f", lg as ({_LONG})"
_METRIC = """, e as (select *, greatest(p1, px, p2) as conf, case when p1 >= px and p1 >= p2 then '1' when px >= p2 then 'X' else '2' end as pred,
    -ln(greatest(case result when '1' then p1 when 'X' then px else p2 end, 2.220446049250313e-16)) as ll,
    pow(p1 - case when result = '1' then 1 else 0 end, 2) + pow(px - case when result = 'X' then 1 else 0 end, 2) + pow(p2 - case when result = '2' then 1 else 0 end, 2) as br from lg),
bn as (select {by}, greatest(1, ceil(conf * 10)) as b, count(*) as n, sum(case when pred = result then 1.0 else 0 end) as hits, sum(conf) as cf, sum(ll) as ll, sum(br) as br from e group by {by}, b)
"""


def long_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf)
    stacked = metrics.stack_candidates(
        rows, {n: [F.col(f"{c}_{s}") for s in ("1", "x", "2")] for n, c in _SOURCES.items()},
        ["match_id", "season", "division", "result"],
    )
    return stacked.filter(F.col("p1").isNotNull())


@query("E1 E2 E3 E4", LONG + _METRIC.replace("{by}", "candidate, season") + """
select candidate, season, cast(sum(n) as bigint) as matches, round(sum(hits) / sum(n), 6) as accuracy, round(sum(ll) / sum(n), 6) as log_loss, round(sum(br) / sum(n), 6) as brier,
  round(sum(abs(hits - cf)) / sum(n), 6) as ece from bn group by candidate, season""")
def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.outcome_metrics(long_sources(spark, sf), ["candidate", "season"])
    return out.select("candidate", "season", "matches", *[r6(c) for c in ("accuracy", "log_loss", "brier", "ece")])


@query("A28 M23 T4", LONG + _METRIC.replace("{by}", "candidate, season") + """, x as (select candidate, season, sum(hits) / sum(n) as acc, sum(ll) / sum(n) as ll from bn group by 1, 2)
select x.candidate, cast(sum(case when x.acc > y.acc then 1 else 0 end) as bigint) as wins, count(*) as groups, round(avg(x.acc), 6) as accuracy, round(avg(x.ll), 6) as log_loss
from x join x y on y.season = x.season and y.candidate = 'market' where x.candidate <> 'market' group by x.candidate""")
def wins_over_market(spark: SparkSession, sf: str) -> DataFrame:
    per_season = metrics.outcome_metrics(long_sources(spark, sf), ["candidate", "season"])
    out = metrics.wins_over(per_season, "market", ["season"])
    return out.select("candidate", "wins", "groups", r6("accuracy"), r6("log_loss"))


@query("E10", S + """, lg as (select 'raw' as stage, season, result, logit_prob_1 as p1, logit_prob_x as px, logit_prob_2 as p2 from s
  union all select 'calibrated', season, result, hgb_prob_1, hgb_prob_x, hgb_prob_2 from s)""" + _METRIC.replace("{by}", "stage") + """
select stage, cast(sum(n) as bigint) as matches, round(sum(hits) / sum(n), 6) as accuracy, round(sum(ll) / sum(n), 6) as log_loss, round(sum(br) / sum(n), 6) as brier,
  round(sum(abs(hits - cf)) / sum(n), 6) as ece from bn group by stage""")
def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf)
    out = metrics.calibration_report(rows, [f"logit_prob_{s}" for s in ("1", "x", "2")], [f"hgb_prob_{s}" for s in ("1", "x", "2")])
    return out.select("stage", "matches", *[r6(c) for c in ("accuracy", "log_loss", "brier", "ece")])


@query("E5", """with d as (select l.doc_id, l.quality as label, (d.n_chars % 997) / 997.0 as score from labels l join documents d on d.doc_id = l.doc_id),
r as (select label, score, avg(rn) over (partition by score) as rk from (select *, row_number() over (order by score) as rn from d) q)
select count(*) as rows, round((sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * cast(count(*) - sum(label) as double)), 6) as auc,
  round(sum(case when label = 1 and score > 0.3 then 1.0 else 0 end) / sum(case when score > 0.3 then 1 else 0 end), 6) as precision,
  round(sum(case when label = 1 and score > 0.3 then 1.0 else 0 end) / sum(label), 6) as recall, round(avg(label), 6) as base_rate from r""")
def binary_classifier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 997) / 997.0).alias("score"))
    rows = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    out = metrics.binary_metrics(rows)
    return out.select("rows", r6("auc"), r6("precision"), r6("recall"), r6("base_rate"))


@query("E6 M21 U6 J12", BASE + """, c as (select result, case when logit_prob_1 >= logit_prob_x and logit_prob_1 >= logit_prob_2 then '1' when logit_prob_x >= logit_prob_2 then 'X' else '2' end as pa, fav as pb from b where match_id % 100 < 3 or fav is not null),
n as (select count(*) as matches, sum(case when pa <> pb then 1 else 0 end) as dif, sum(case when pa = result and pb <> result then 1 else 0 end) as oa,
    sum(case when pa <> result and pb = result then 1 else 0 end) as ob from c)
select matches, cast(dif as bigint) as different_picks, cast(oa as bigint) as only_a, cast(ob as bigint) as only_b,
  round((oa - ob) / cast(matches as double), 6) as accuracy_difference,
  round(least(1.0, 2 * (select sum(exp(lgamma(oa + ob + 1) - lgamma(i + 1) - lgamma(oa + ob - i + 1) - (oa + ob) * ln(2))) from unnest(range(cast(least(oa, ob) as bigint) + 1)) t(i))), 6) as mcnemar_p
from n""".replace(" where match_id % 100 < 3 or fav is not null", " where fav is not null"))
def paired_contrast(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources(spark, sf).filter(F.col("favorite_market").isNotNull())
    mine = pr.argmax_sign(*[F.col(f"logit_prob_{s}") for s in ("1", "x", "2")])
    out = metrics.paired_contrast(rows.select("result", mine.alias("pick_a"), F.col("favorite_market").alias("pick_b")))
    return out.select("matches", "different_picks", "only_a", "only_b", r6("accuracy_difference"), r6("mcnemar_p"))


@query("E7")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources(spark, sf).filter(F.col("favorite_market").isNotNull())
    mine = pr.argmax_sign(*[F.col(f"logit_prob_{s}") for s in ("1", "x", "2")])
    gap = (mine == F.col("result")).cast("int") - F.col("favorite_market_hit")
    return metrics.bootstrap_interval(rows.select(gap.alias("gap")), "gap")


@query("J12 U6", FACTS + """
select cast(count(*) - count(case when d is not null and hg is not null and ag is not null and res is not null and ovr is not null and has_open then 1 end) as bigint) as only_a,
  cast(0 as bigint) as only_b, false as equal from x""")
def key_set_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of all matches against those that survive typing of their raw rows."""
    every = views.matches(spark, sf).select("match_id")
    raw = views.raw_history(spark, sf).withColumn("match_id", F.col("_line"))
    return compare.same_keys(every, cleaning.typed_matches(raw).select("match_id"), ["match_id"])


@query("A22 T4 M14", BASE + """, q as (select season, avg(case when logit_prob_1 >= logit_prob_x and logit_prob_1 >= logit_prob_2 then case when result = '1' then 1.0 else 0 end
    when logit_prob_x >= logit_prob_2 then case when result = 'X' then 1.0 else 0 end else case when result = '2' then 1.0 else 0 end end) as accuracy,
    avg(case when fav = result then 1.0 else 0 end) as market from b group by season),
z as (select *, row_number() over (order by season) - 1 as i from q)
select count(*) as temporadas, round(avg(accuracy), 6) as mean_accuracy, round(stddev_pop(accuracy), 6) as std_accuracy, round(stddev_pop(accuracy) / avg(accuracy), 6) as cv_accuracy,
  round(min(accuracy), 6) as min_accuracy, round(max(accuracy), 6) as max_accuracy, round(regr_slope(accuracy, i), 6) as trend, round(avg(accuracy - market), 6) as mean_gap_vs_market,
  max_by(season, accuracy) as best_season, min_by(season, accuracy) as worst_season from z""")
def season_stability(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources(spark, sf)
    mine = pr.argmax_sign(*[F.col(f"logit_prob_{s}") for s in ("1", "x", "2")])
    seasons = rows.groupBy("season").agg(
        F.avg((mine == F.col("result")).cast("int")).alias("accuracy"), F.avg("favorite_market_hit").alias("market")
    )
    out = metrics.stability(seasons)
    return out.select(
        "temporadas", *[r6(c) for c in ("mean_accuracy", "std_accuracy", "cv_accuracy", "min_accuracy", "max_accuracy", "trend", "mean_gap_vs_market")],
        "best_season", "worst_season",
    )


@query("A23 U2", S + """, d as (select result, '1' as sign, hgb_prob_1 as m, market_1 as k from s union all select result, 'X', hgb_prob_x, market_x from s union all select result, '2', hgb_prob_2, market_2 from s),
e as (select *, case when m - k > -1 and m - k <= -0.1 then 0 when m - k > -0.1 and m - k <= -0.05 then 1 when m - k > -0.05 and m - k <= 0.05 then 2
    when m - k > 0.05 and m - k <= 0.1 then 3 when m - k > 0.1 and m - k <= 1 then 4 end as b from d)
select cast(b as int) as diff_bin, count(*) as count, round(avg(case when result = sign then 1.0 else 0 end), 6) as actual_rate, round(avg(k), 6) as avg_market, round(avg(m), 6) as avg_model,
  round(avg(case when result = sign then 1.0 else 0 end) - avg(k), 6) as value from e where b is not null group by b""")
def divergence_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf).withColumns({f"model_{s}": F.col(f"hgb_prob_{s}") for s in ("1", "x", "2")})
    out = metrics.divergence_profile(rows)
    return out.select("diff_bin", "count", *[r6(c) for c in ("actual_rate", "avg_market", "avg_model", "value")])


@query("P42 P41", S + """, n as (select match_id, market_1 / (market_1 + market_x + market_2) as m1, market_x / (market_1 + market_x + market_2) as mx,
    market_2 / (market_1 + market_x + market_2) as m2, hgb_prob_1 / (hgb_prob_1 + hgb_prob_x + hgb_prob_2) as h1, hgb_prob_x / (hgb_prob_1 + hgb_prob_x + hgb_prob_2) as hx,
    hgb_prob_2 / (hgb_prob_1 + hgb_prob_x + hgb_prob_2) as h2 from s where market_1 is not null),
c as (select match_id, m1 + case when h1 - m1 >= 0.05 and h1 - m1 <= 0.10 then (h1 - m1) * 0.5 else 0 end as a1,
    mx + case when hx - mx >= 0.05 and hx - mx <= 0.10 then (hx - mx) * 0.5 else 0 end as ax, m2 + case when h2 - m2 >= 0.05 and h2 - m2 <= 0.10 then (h2 - m2) * 0.5 else 0 end as a2 from n)
select match_id, round(a1 / (a1 + ax + a2), 6) as prob_1, round(ax / (a1 + ax + a2), 6) as prob_x, round(a2 / (a1 + ax + a2), 6) as prob_2 from c""")
def divergence_nudge(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf).filter(F.col("market_1").isNotNull())
    parts = pr.nudge_by_divergence([F.col(f"market_{s}") for s in ("1", "x", "2")], [F.col(f"hgb_prob_{s}") for s in ("1", "x", "2")])
    return rows.select("match_id", *[F.round(p, 6).alias(f"prob_{s}") for p, s in zip(parts, ("1", "x", "2"))])


@query("P43", S + """
select match_id, round(logit_prob_1 / (logit_prob_1 + logit_prob_2) * (1 - hgb_prob_x), 6) as prob_1, round(hgb_prob_x, 6) as prob_x,
  round(logit_prob_2 / (logit_prob_1 + logit_prob_2) * (1 - hgb_prob_x), 6) as prob_2 from s""")
def draw_substitution(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf)
    parts = pr.substitute_draw(F.col("logit_prob_1"), F.col("logit_prob_2"), F.col("hgb_prob_x"))
    return rows.select("match_id", *[F.round(p, 6).alias(f"prob_{s}") for p, s in zip(parts, ("1", "x", "2"))])


@query("P31", S + """
select match_id, round(1 + (logit_prob_1 * ln(logit_prob_1) + logit_prob_x * ln(logit_prob_x) + logit_prob_2 * ln(logit_prob_2)) / ln(3), 4) as confidence from s""")
def entropy_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = [F.col(f"logit_prob_{s}") for s in ("1", "x", "2")]
    return views.matches_with_sources(spark, sf).select("match_id", pr.entropy_confidence(*p).alias("confidence"))


@query("M10")
def mixture_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Optimal source weights of every target season, fitted on all earlier seasons."""
    rows = views.matches_with_sources(spark, sf).select("season", "result", *[f"{c}_{s}" for c in _SOURCES.values() for s in ("1", "x", "2")])
    earlier = ordinal.with_target_seasons(rows)
    found = models.mixture_weights_by(earlier, {n: [f"{c}_{s}" for s in ("1", "x", "2")] for n, c in _SOURCES.items()}, "target_season")
    table = [(season, *[round(w[n], 4) for n in _SOURCES]) for season, w in found.items()]
    return spark.createDataFrame(table, "season string, " + ", ".join(f"w_{n} double" for n in _SOURCES))


@query("M10", S + """, g as (select a.i as a, b.i as b, c.i as c from unnest(range(11)) a(i), unnest(range(11)) b(i), unnest(range(11)) c(i) where a.i + b.i + c.i <= 10),
q as (select case result when '1' then logit_prob_1 when 'X' then logit_prob_x else logit_prob_2 end as l, case result when '1' then hgb_prob_1 when 'X' then hgb_prob_x else hgb_prob_2 end as h,
    case result when '1' then market_1 when 'X' then market_x else market_2 end as m, case result when '1' then poisson_1 when 'X' then poisson_x else poisson_2 end as p from s)
select round(a / 10.0, 6) as w_logit, round(b / 10.0, 6) as w_hgb, round(c / 10.0, 6) as w_market, round((10 - a - b - c) / 10.0, 6) as w_poisson,
  round(avg(-ln(greatest(a / 10.0 * l + b / 10.0 * h + c / 10.0 * m + (10 - a - b - c) / 10.0 * p, 1e-9))), 6) as log_loss from q, g where l is not null and h is not null and m is not null and p is not null group by a, b, c""")
def mixture_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf)
    out = models.mixture_grid(rows, {n: [f"{c}_{s}" for s in ("1", "x", "2")] for n, c in _SOURCES.items()})
    return out.select(*[r6(f"w_{n}") for n in _SOURCES], r6("log_loss"))

