"""Queries over pool tickets, economics and matchday rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import settings
from touchline.catalog import views
from touchline.catalog.outcomes import _CONFIG, _W, BASE, S, blend_sql, sources
from touchline.catalog.registry import b6, query, r6
from touchline.functions import odds
from touchline.functions import tickets as tk
from touchline.functions.text import infer_season
from touchline.operators import features as ft
from touchline.operators import blend, matchday, models
from touchline.operators import tickets as ops
from touchline.plans import backtests

# Fifteen consecutive matches form a matchday; match 15 is the score match.
TICKETS = S + """, tk as (select match_id, cast(match_id // 15 as bigint) as ticket_id, cast(match_id % 15 + 1 as int) as num, result, logit_prob_1 as p1, logit_prob_x as px, logit_prob_2 as p2,
    coalesce(market_1, 1 / 3.0) as q1, coalesce(market_x, 1 / 3.0) as qx, coalesce(market_2, 1 / 3.0) as q2 from s),
t as (select * from tk where num <= 14 and ticket_id in (select ticket_id from tk group by ticket_id having count(*) = 15)),
z as (select *, greatest(p1, px, p2) as best, p1 + px + p2 - greatest(p1, px, p2) - least(p1, px, p2) as second, least(p1, px, p2) as low from t),
c as (select *, row_number() over (partition by ticket_id order by round(second, 12) desc, num) <= 3 as dbl from z),
cv as (select *, case when dbl then case when p1 = low then px + p2 when px = low then p1 + p2 else p1 + px end else best end as h,
    case when dbl then case when p1 = low then 'X2' when px = low then '12' else '1X' end when p1 = best then '1' when px = best then 'X' else '2' end as signs from c)
"""
# Exact convolution of the 14 Bernoulli covers, one match per step.
DIST = TICKETS + """, dist as (with recursive d(ticket_id, num, v) as (
    select distinct ticket_id, 0, list_transform(range(15), lambda k: case when k = 0 then 1.0::double else 0.0::double end) from cv
    union all
    select cv.ticket_id, cv.num, list_transform(d.v, lambda x, k: x * (1 - cv.h) + case when k > 1 then d.v[k - 1] * cv.h else 0 end)
    from d join cv on cv.ticket_id = d.ticket_id and cv.num = d.num + 1)
  select ticket_id, v from d where num = 14)
"""


def ticket_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf)
    out = rows.select(
        "match_id", F.floor(F.col("match_id") / 15).alias("ticket_id"), (F.col("match_id") % 15 + 1).cast("int").alias("num"), "result",
        F.array("logit_prob_1", "logit_prob_x", "logit_prob_2").alias("p"),
        ops.fill_uniform(F.when(F.col("market_1").isNotNull(), F.array("market_1", "market_x", "market_2"))).alias("public"),
    )
    # Only complete matchdays make a ticket.
    return out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticket_id"))).filter("n = 15").drop("n")


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return ops.collect_tickets(ticket_rows(spark, sf), ["ticket_id"], ("p", "public", "result"))


@query("T6 J21 F16 F17 F18 F19 F20", DIST + """
select x.ticket_id, x.doubles, x.signs, round(x.expected_hits, 6) as expected_hits, round(x.second_sum, 6) as second_sum, """
       + ", ".join(f"round(list_sum(list_slice(dist.v, {k + 1}, 15)), 6) as p_ge_{k}" for k in tk.TAILS) + """
from (select ticket_id, string_agg(case when dbl then cast(num - 1 as varchar) end, '|' order by num) as doubles, string_agg(signs, '|' order by num) as signs, sum(h) as expected_hits,
  sum(case when dbl then second end) as second_sum from cv group by ticket_id) x join dist on dist.ticket_id = x.ticket_id""")
def best_tickets(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.ticket_metrics(packed(spark, sf))
    return out.select(
        "ticket_id", F.array_join(F.transform("doubles", lambda i: i.cast("string")), "|").alias("doubles"), F.array_join("signs", "|").alias("signs"),
        r6("expected_hits"), r6("second_sum"), *[r6(f"p_ge_{k}") for k in tk.TAILS],
    )


@query("T6 J21", TICKETS + """, a as (select ticket_id, sum(best) as base from z group by ticket_id),
k as (select x.ticket_id, concat(x.num - 1, '|', y.num - 1, '|', w.num - 1) as doubles, x.num as i, y.num as j, w.num as k, x.second + y.second + w.second as s
  from z x join z y on y.ticket_id = x.ticket_id and y.num > x.num join z w on w.ticket_id = x.ticket_id and w.num > y.num),
r as (select k.*, a.base + k.s as e, row_number() over (partition by k.ticket_id order by round(a.base + k.s, 12) desc, i, j, k.k) as rank from k join a on a.ticket_id = k.ticket_id)
select ticket_id, cast(rank as int) as rank, doubles, round(e, 6) as expected_hits, round(s, 6) as second_sum from r where rank <= 10""")
def top_double_combinations(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.ranked_combinations(packed(spark, sf), ["ticket_id"], top=10, ranking="binary")
    return out.select("ticket_id", "rank", F.array_join(F.transform("doubles", lambda i: i.cast("string")), "|").alias("doubles"), r6("expected_hits"), r6("second_sum"))


@query("T6 J21 F18 F19 F20", TICKETS + """, a as (select ticket_id, list(best order by num) as bl, list(list_sort([p1, px, p2])[2] order by num) as sl, list_reduce(bl, lambda x, y: x + y) as base from z group by ticket_id),
n as (select unnest(range(1, 15)) as i),
cb as (select cast(row_number() over (order by x.i, y.i, w.i) - 1 as int) as combination, x.i as i, y.i as j, w.i as k from n x, n y, n w where y.i > x.i and w.i > y.i),
r as (select ticket_id, combination, i, j, k, base + (sl[i] + sl[j] + sl[k]) as e, sl[i] + sl[j] + sl[k] as s, bl, sl from a, cb),
dist as (with recursive d(ticket_id, combination, num, h, v) as (
    select ticket_id, combination, 0, list_transform(range(1, 15), lambda x: bl[x] + case when x in (i, j, k) then sl[x] else 0 end),
      list_transform(range(15), lambda x: case when x = 0 then 1.0::double else 0.0::double end) from r
    union all
    select ticket_id, combination, num + 1, h, list_transform(v, lambda x, y: x * (1 - h[num + 1]) + case when y > 1 then v[y - 1] * h[num + 1] else 0 end) from d where num < 14)
  select ticket_id, combination, v from d where num = 14)
select r.ticket_id, cast(row_number() over (partition by r.ticket_id order by round(cast(cast(e as varchar) as decimal(38, 20)), 12) desc, r.combination) as int) as rank, r.combination,
  round(e, 6) as expected_hits, round(s, 6) as second_sum, """
       + ", ".join(f"round(list_sum(list_slice(v, {k + 1}, 15)), 6) as p_ge_{k}" for k in tk.TAILS) + """
from r join dist on dist.ticket_id = r.ticket_id and dist.combination = r.combination""")
def full_combination_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All 364 combinations per ticket with exact tails."""
    out = ops.ranked_combinations(packed(spark, sf), ["ticket_id"])
    return out.select("ticket_id", "rank", "combination", b6("expected_hits"), b6("second_sum"), *[b6(f"p_ge_{k}") for k in tk.TAILS])


@query("T8 J22 F21", TICKETS + """, b as (select *, row_number() over (partition by ticket_id, dbl order by num) - 1 as di from cv),
k as (select unnest(range(8)) as c), e as (select b.ticket_id, k.c, b.num, case when not dbl then signs when (k.c // cast(pow(2, 2 - di) as int)) % 2 = 0 then substr(signs, 1, 1) else substr(signs, 2, 1) end as sg, p1, px, p2, q1, qx, q2 from b, k),
v as (select ticket_id, c, string_agg(sg, '' order by num) as col, sum(ln(greatest(case sg when '1' then p1 when 'X' then px else p2 end, 1e-12))) - 0.6 * sum(ln(greatest(case sg when '1' then q1 when 'X' then qx else q2 end, 1e-12))) as value
  from e group by ticket_id, c)
select ticket_id, cast(row_number() over (partition by ticket_id order by round(value, 10) desc, c) as int) as rank, col as "column", round(value, 6) as value from v""")
def ticket_columns(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.ticket_columns(packed(spark, sf), ["ticket_id"])
    return out.select("ticket_id", "rank", "column", r6("value"))


@query("F23 F24 F25", DIST + """, sc as (select * from (values ('facil', 3250.0, 45.0, 6.0, 1.5, 0.0), ('normal', 40000.0, 500.0, 35.0, 5.5, 2.25), ('dificil', 150000.0, 6000.0, 500.0, 45.0, 10.0)) q(scenario, a, b, c, d, e))
select ticket_id, scenario, round(v[15] * a + v[14] * b + v[13] * c + v[12] * d + v[11] * e, 6) as ev_prizes, round(v[15] * a + v[14] * b + v[13] * c + v[12] * d + v[11] * e - 6.0, 6) as ev_net,
  round((v[15] * a + v[14] * b + v[13] * c + v[12] * d + v[11] * e - 6.0) / 6.0, 6) as roi from dist, sc""")
def economics_by_scenario(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.economics_by_scenario(ops.ticket_metrics(packed(spark, sf)), ["ticket_id"])
    return out.select("ticket_id", "scenario", r6("ev_prizes"), r6("ev_net"), r6("roi"))


@query("F25", DIST + """, fv as (with recursive d(ticket_id, num, v) as (
    select distinct ticket_id, 0, list_transform(range(15), lambda k: case when k = 0 then 1.0::double else 0.0::double end) from cv
    union all
    select cv.ticket_id, cv.num, list_transform(d.v, lambda x, k: x * (1 - greatest(q1, qx, q2)) + case when k > 1 then d.v[k - 1] * greatest(q1, qx, q2) else 0 end)
    from d join cv on cv.ticket_id = d.ticket_id and cv.num = d.num + 1)
  select ticket_id, v from d where num = 14),
e as (select dist.ticket_id, dist.v[15] * 40000 + dist.v[14] * 500 + dist.v[13] * 35 + dist.v[12] * 5.5 + dist.v[11] * 2.25 as m,
    fv.v[15] * 40000 + fv.v[14] * 500 + fv.v[13] * 35 + fv.v[12] * 5.5 + fv.v[11] * 2.25 as k, dist.v[13] + dist.v[14] + dist.v[15] as mp, fv.v[13] + fv.v[14] + fv.v[15] as kp
  from dist join fv on fv.ticket_id = dist.ticket_id)
select ticket_id, round(m - 6, 6) as model_ev_net, round(k - 6, 6) as market_ev_net, round((k - 0.75) / 0.75, 6) as market_roi_one_column, round(m - k, 6) as delta_ev_net, round(mp - kp, 6) as delta_p_ge_12 from e""")
def model_against_market(spark: SparkSession, sf: str) -> DataFrame:
    rows = ticket_rows(spark, sf).withColumns({"model": F.col("p"), "market": F.col("public")})
    out = ops.compare_with_market(rows, ["ticket_id"])
    return out.select("ticket_id", *[r6(c) for c in ("model_ev_net", "market_ev_net", "market_roi_one_column", "delta_ev_net", "delta_p_ge_12")])


_SETTLED = S + """, o as (select season, result, logit_prob_1 as p1, logit_prob_x as px, logit_prob_2 as p2, market_1 as q1, market_x as qx, market_2 as q2,
    row_number() over (partition by season order by match_date, division, home, away, match_id) - 1 as pos, count(*) over (partition by season) as n from s),
b as (select *, floor(pos / 15) + 1 as block, pos % 15 + 1 as num from o where (floor(pos / 15) + 1) * 15 <= n),
g as (select * from b where num <= 14), ok as (select season, block from g group by season, block having count(q1) = 14),
z as (select g.*, greatest(p1, px, p2) as best, least(p1, px, p2) as low, p1 + px + p2 - greatest(p1, px, p2) - least(p1, px, p2) as second from g join ok on ok.season = g.season and ok.block = g.block),
c as (select *, row_number() over (partition by season, block order by round(second, 12) desc, num) <= 3 as dbl from z),
h as (select season, block, sum(case when contains(case when dbl then case when p1 = low then 'X2' when px = low then '12' else '1X' end when p1 = best then '1' when px = best then 'X' else '2' end, result) then 1 else 0 end) as mh,
    sum(case when case when q1 >= qx and q1 >= q2 then '1' when qx >= q2 then 'X' else '2' end = result then 1 else 0 end) as kh from c group by season, block),
w as (select *, case mh when 14 then 40000.0 when 13 then 500.0 when 12 then 35.0 when 11 then 5.5 when 10 then 2.25 else 0 end as mp,
    case kh when 14 then 40000.0 when 13 then 500.0 when 12 then 35.0 when 11 then 5.5 when 10 then 2.25 else 0 end as kp from h)
"""


def settled(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf).withColumns(
        {
            "model": F.array("logit_prob_1", "logit_prob_x", "logit_prob_2"),
            "market": odds.row_probs(("market_1", "market_x", "market_2")),
        }
    )
    return ops.settle_blocks(rows, ["season"])


@query("F26 P49 F15", _SETTLED + """
select season, cast(block as bigint) as block, cast(mh as int) as model_hits, cast(kh as int) as market_hits, cast(mp as double) as model_prize, cast(kp as double) as market_prize from w""")
def settled_tickets(spark: SparkSession, sf: str) -> DataFrame:
    return settled(spark, sf).withColumn("block", F.col("block").cast("bigint"))


@query("F26", _SETTLED + """
select season, count(*) as jornadas, round(avg(mh), 6) as model_mean_hits, round(avg(kh), 6) as market_mean_hits, round(sum(mp), 6) as model_prize_eur,
  round((sum(mp) - 6.0 * count(*)) / (6.0 * count(*)), 6) as model_roi, round((sum(kp) - 0.75 * count(*)) / (0.75 * count(*)), 6) as market_roi_1col,
  round((sum(kp) - 6.0 * count(*)) / (6.0 * count(*)), 6) as market_roi_full, round(avg(case when mh >= 10 then 1.0 else 0 end), 6) as model_p_ge_10,
  round(avg(case when mh >= 12 then 1.0 else 0 end), 6) as model_p_ge_12 from w group by season""")
def season_economics(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.season_economics(settled(spark, sf))
    return out.select("season", "jornadas", *[r6(c) for c in (
        "model_mean_hits", "market_mean_hits", "model_prize_eur", "model_roi", "market_roi_1col", "market_roi_full", "model_p_ge_10", "model_p_ge_12")])


@query("F26 F24", _SETTLED + """, x as (select 'model' as arm, mh as hits from w union all select 'market', kh from w),
y as (select 'facil' as scenario, arm, case hits when 14 then 3250.0 when 13 then 45.0 when 12 then 6.0 when 11 then 1.5 else 0 end as prize from x
  union all select 'normal', arm, case hits when 14 then 40000.0 when 13 then 500.0 when 12 then 35.0 when 11 then 5.5 when 10 then 2.25 else 0 end from x
  union all select 'dificil', arm, case hits when 14 then 150000.0 when 13 then 6000.0 when 12 then 500.0 when 11 then 45.0 when 10 then 10.0 else 0 end from x)
select scenario, arm, round(sum(prize), 6) as prize_eur, round(6.0 * count(*), 6) as cost_eur, round((sum(prize) - 6.0 * count(*)) / (6.0 * count(*)), 6) as roi from y group by scenario, arm""")
def scenario_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.scenario_sensitivity(settled(spark, sf))
    return out.select("scenario", "arm", r6("prize_eur"), r6("cost_eur"), r6("roi"))


def arm_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches_with_sources(spark, sf)
    arms = F.array(*[
        F.struct(F.lit(name).alias("arm"), odds.row_probs([f"{c}_{s}" for s in ("1", "x", "2")]).alias("p"))
        for name, c in (("activo", "hgb_prob"), ("calibrado", "logit_prob"))
    ])
    return ops.evaluate_arms(rows.withColumn("arms", arms))


_ARMS = S + """, a0 as (select 'activo' as arm, s.*, hgb_prob_1 as p1, hgb_prob_x as px, hgb_prob_2 as p2 from s union all select 'calibrado', s.*, logit_prob_1, logit_prob_x, logit_prob_2 from s),
a as (select arm, season, match_date, division, home, away, match_id, result, p1 / (p1 + px + p2) as p1, px / (p1 + px + p2) as px, p2 / (p1 + px + p2) as p2 from a0),
o as (select *, row_number() over (partition by arm, season order by match_date, division, home, away, match_id) - 1 as pos, count(*) over (partition by arm, season) as n from a),
g as (select *, floor(pos / 15) + 1 as block, pos % 15 + 1 as num from o where (floor(pos / 15) + 1) * 15 <= n),
z as (select *, greatest(p1, px, p2) as best, least(p1, px, p2) as low, p1 + px + p2 - greatest(p1, px, p2) - least(p1, px, p2) as second from g where num <= 14),
c as (select *, row_number() over (partition by arm, season, block order by round(second, 12) desc, num) <= 3 as dbl from z),
h as (select arm, season, block, sum(case when contains(case when dbl then case when p1 = low then 'X2' when px = low then '12' else '1X' end when p1 = best then '1' when px = best then 'X' else '2' end, result) then 1 else 0 end) as hits from c group by arm, season, block),
w as (select *, case hits when 14 then 40000.0 when 13 then 500.0 when 12 then 35.0 when 11 then 5.5 when 10 then 2.25 else 0 end as prize from h),
acc as (select arm, season, avg(case when case when p1 >= px and p1 >= p2 then '1' when px >= p2 then 'X' else '2' end = result then 1.0 else 0 end) as acc from a group by arm, season),
ps as (select w.arm, w.season, count(*) as jornadas, avg(hits) as mean_hits, avg(case when hits >= 12 then 1.0 else 0 end) as p12, avg(case when hits >= 13 then 1.0 else 0 end) as p13, sum(prize) as prize, 6.0 * count(*) as cost,
    (sum(prize) - 6.0 * count(*)) / (6.0 * count(*)) as roi, max(acc.acc) as acc from w join acc on acc.arm = w.arm and acc.season = w.season group by w.arm, w.season)
"""


@query("F27 M24", _ARMS + """
select arm, season, jornadas, round(acc, 6) as accuracy_simple, round(mean_hits, 6) as mean_hits, round(p12, 6) as p_ge_12, round(p13, 6) as p_ge_13, round(prize, 6) as prize_eur, round(cost, 6) as cost_eur, round(roi, 6) as roi from ps""")
def arm_seasons(spark: SparkSession, sf: str) -> DataFrame:
    return arm_results(spark, sf).select("arm", "season", "jornadas", *[r6(c) for c in ("accuracy_simple", "mean_hits", "p_ge_12", "p_ge_13", "prize_eur", "cost_eur", "roi")])


@query("A24", _ARMS + """
select arm, count(*) as temporadas, round((sum(prize) - sum(cost)) / sum(cost), 6) as roi_global, round(avg(acc), 6) as mean_accuracy, round(avg(mean_hits), 6) as mean_hits, round(avg(p12), 6) as mean_p_ge_12,
  round(stddev_pop(p12), 6) as std_p_ge_12, round(avg(p13), 6) as mean_p_ge_13, round(avg(roi), 6) as mean_roi_seasonal, round(stddev_pop(roi), 6) as std_roi_seasonal from ps group by arm""")
def arm_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.aggregate_arms(arm_results(spark, sf))
    return out.select("arm", "temporadas", *[r6(c) for c in (
        "roi_global", "mean_accuracy", "mean_hits", "mean_p_ge_12", "std_p_ge_12", "mean_p_ge_13", "mean_roi_seasonal", "std_roi_seasonal")])


@query("A25", _ARMS + """, l5 as (select distinct season from ps order by season desc limit 5),
du as (select sum(case when c.p12 > a.p12 then 1 else 0 end) as wins, sum(case when c.p12 = a.p12 then 1 else 0 end) as ties from ps c join ps a on a.season = c.season and a.arm = 'activo' where c.arm = 'calibrado' and c.season in (select season from l5)),
sc as (select arm, avg(p12) - 0.5 * stddev_pop(p12) as score from ps group by arm)
select 'calibrado' as arm, cast(wins as bigint) as wins, cast(ties as bigint) as ties, round(c.score, 6) as score, round(a.score, 6) as baseline_score, wins >= 4 and c.score > a.score as replaces
from du, sc c, sc a where c.arm = 'calibrado' and a.arm = 'activo'""")
def replacement_decision(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.replacement_decision(arm_results(spark, sf), "activo")
    return out.select("arm", "wins", "ties", r6("score"), r6("baseline_score"), "replaces")


# ---------------------------------------------------------------------------
# Matchday rows
# ---------------------------------------------------------------------------

_PCT = """, pc as (select match_id, cast(match_id // 15 as int) as jornada, cast(match_id % 15 + 1 as int) as num, home as local, away as visitante, result, match_date,
    case when match_id % 9 = 0 then null else cast(round(logit_prob_1 * 100) as double) end as a1, cast(round(logit_prob_x * 100) as double) as ax, cast(round(logit_prob_2 * 100) as double) as a2,
    cast(round(hgb_prob_1 * 100) as double) as l1, case when match_id % 11 = 0 then null else cast(round(hgb_prob_x * 100) as double) end as lx, cast(round(hgb_prob_2 * 100) as double) as l2,
    case when match_id % 13 = 0 then null else cast(round(market_1 * 100) as double) end as q1, cast(round(market_x * 100) as double) as qx, cast(round(market_2 * 100) as double) as q2,
    cust, price_cents from s)"""
PCT = S + _PCT
_SRC = """, sr as (select *, a1 is not null as ha, lx is not null as hl, q1 is not null and qx is not null as hq from pc),
mk as (select *, case when ha then 'apu' when hl then 'lae' when hq then 'q15' end as src, case when ha then a1 / (a1 + ax + a2) when hl then l1 / (l1 + lx + l2) when hq then q1 / (q1 + qx + q2) end as m1,
    case when ha then ax / (a1 + ax + a2) when hl then lx / (l1 + lx + l2) when hq then qx / (q1 + qx + q2) end as mx, case when ha then a2 / (a1 + ax + a2) when hl then l2 / (l1 + lx + l2) when hq then q2 / (q1 + qx + q2) end as m2,
    case when hq then q1 / (q1 + qx + q2) when hl then l1 / (l1 + lx + l2) end as u1, case when hq then qx / (q1 + qx + q2) when hl then lx / (l1 + lx + l2) end as ux,
    case when hq then q2 / (q1 + qx + q2) when hl then l2 / (l1 + lx + l2) end as u2 from sr where num < 15),
rd as (select *, case when m1 >= mx and m1 >= m2 then '1' when mx >= m2 then 'X' else '2' end as fav, greatest(m1, mx, m2) as fp from mk where m1 is not null and u1 is not null),
rr as (select *, case fav when '1' then case when mx >= m2 then 'X' else '2' end when 'X' then case when m1 >= m2 then '1' else '2' end else case when m1 >= mx then '1' else 'X' end end as sec,
    case fav when '1' then greatest(mx, m2) when 'X' then greatest(m1, m2) else greatest(m1, mx) end as sp, case fav when '1' then m1 - u1 when 'X' then mx - ux else m2 - u2 end as fvv,
    case fav when '1' then u1 when 'X' then ux else u2 end as fpub, m1 - u1 as v1, mx - ux as vx, m2 - u2 as v2 from rd),
lb as (select *, fp >= 0.6 and fvv > -0.10 as fixed, fp >= 0.5 and fvv <= -0.15 as over, fp < 0.5 and fpub > 0.65 as trap, mx >= 0.28 and ux <= 0.22 as hid, m2 >= 0.23 and u2 <= 0.14 as vis,
    least(m1, mx, m2) >= 0.25 and greatest(m1, mx, m2) <= 0.40 as tri, case when v1 >= vx and v1 >= v2 then '1' when vx >= v2 then 'X' else '2' end as bv from rr)
"""


def matchdays(spark: SparkSession, sf: str) -> DataFrame:
    s = views.matches_with_sources(spark, sf)

    def pct(prefix: str, gap: int | None, where: str) -> Column:
        fields = []
        for sign, c in zip(settings.SIGNS, ("1", "x", "2")):
            value = F.round(F.col(f"{prefix}_{c}") * 100)
            if gap and c == where:
                value = F.when(F.col("match_id") % gap != 0, value)
            fields.append(value.alias(sign))
        return F.struct(*fields)

    return s.select(
        "match_id", F.floor(F.col("match_id") / 15).cast("int").alias("jornada"), (F.col("match_id") % 15 + 1).cast("int").alias("num"),
        F.col("home").alias("local"), F.col("away").alias("visitante"), "result", F.col("date").cast("string").alias("fecha"),
        pct("logit_prob", 9, "1").alias("apu"), pct("hgb_prob", 11, "x").alias("lae"), pct("market", 13, "1").alias("q15"),
        F.when(F.col("match_id") % 45 > 0, F.get(F.array(F.lit("1"), F.lit("X"), F.lit("2")), (F.col("cust") % 3).cast("int"))).alias("sistema"),
        "cust", "price_cents", "date", "home", "away",
    )


def _diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    out = matchday.diagnose(matchdays(spark, sf))
    return out.filter((F.col("num") < 15) & F.col("diagnostico").isNull())


@query("F31 SRC7 SRC13 P25 P26 P27 P28 T3 P38", PCT + _SRC + """
select match_id, src as fuente_modelo, round(fp - sp, 4) as gap_primero_segundo, case when fp - sp >= 0.25 then 'bajo' when fp - sp >= 0.15 then 'medio' when fp - sp >= 0.07 then 'alto' else 'extremo' end as riesgo,
  case when fixed or over or trap or hid or vis or tri then concat_ws('|', case when fixed then 'fijo logico' end, case when over then 'favorito sobreapostado' end, case when trap then 'partido trampa' end,
    case when hid then 'empate oculto' end, case when vis then 'visitante de valor' end, case when tri then 'triple candidato' end) when fp >= 0.5 then 'favorito razonable' else 'partido abierto' end as etiquetas from lb""")
def matchday_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    out = _diagnosed(spark, sf)
    return out.select("match_id", "fuente_modelo", "gap_primero_segundo", "riesgo", F.array_join("etiquetas", "|").alias("etiquetas"))


_PLAY = "concat(case when '1' in ({0}, {1}) then '1' else '' end, case when 'X' in ({0}, {1}) then 'X' else '' end, case when '2' in ({0}, {1}) then '2' else '' end)"


@query("P29", PCT + _SRC + f""", nb as (select *, case bv when '1' then case when vx >= v2 then 'X' else '2' end when 'X' then case when v1 >= v2 then '1' else '2' end else case when v1 >= vx then '1' else 'X' end end as bv2,
    case bv when '1' then m1 when 'X' then mx else m2 end as bvp from lb)
select match_id, case when trap or over then {_PLAY.format("fav", "sec")} when tri or hid then {_PLAY.format("fav", "'X'")} else fav end as conservadora,
  case when trap or over then {_PLAY.format("bv", "bv2")} when tri then '1X2' when hid then {_PLAY.format("fav", "'X'")} when sp >= 0.24 then {_PLAY.format("fav", "sec")} else fav end as equilibrada,
  case when trap or over or tri then bv when hid then 'X' when bv <> fav and bvp >= 0.20 then bv else fav end as agresiva from nb""")
def matchday_picks(spark: SparkSession, sf: str) -> DataFrame:
    out = _diagnosed(spark, sf)
    return out.select("match_id", "conservadora", "equilibrada", "agresiva")


@query("A20", PCT + _SRC + """
select jornada, e as etiqueta, count(*) as partidos from (select jornada, unnest(case when fixed or over or trap or hid or vis or tri then
  [case when fixed then 'fijo logico' end, case when over then 'favorito sobreapostado' end, case when trap then 'partido trampa' end, case when hid then 'empate oculto' end, case when vis then 'visitante de valor' end, case when tri then 'triple candidato' end]
  else [case when fp >= 0.5 then 'favorito razonable' else 'partido abierto' end] end) as e from lb) z where e is not null group by 1, 2""")
def matchday_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matchday.label_counts(_diagnosed(spark, sf))


# Predictions of the model by match: quality and confidence from the keys.
_PRED = """, pr as (select match_id, jornada, num, round(logit_p1, 4) as p1, round(logit_px, 4) as px, round(logit_p2, 4) as p2, (match_id % 10) / 10.0 as quality, (cust % 11) / 10.0 as conf, a1, ax, a2, hm
  from (select pc.*, s2.market_1 is not null as hm, s2.logit_prob_1 as logit_p1, s2.logit_prob_x as logit_px, s2.logit_prob_2 as logit_p2 from pc join s s2 on s2.match_id = pc.match_id) y),
it as (select *, hm and quality >= 0.2 as ok from pr),
us as (select *, case when ok then p1 when a1 is not null or ax is not null then coalesce(a1, 0) / (coalesce(a1, 0) + ax + a2) end as r1, case when ok then px when ax is not null then ax / (coalesce(a1, 0) + ax + a2) end as rx,
    case when ok then p2 when ax is not null then a2 / (coalesce(a1, 0) + ax + a2) end as r2, case when hm then conf else 0.5 end as cf from it where num < 15),
rk as (select *, case when r1 >= rx and r1 >= r2 then '1' when rx >= r2 then 'X' else '2' end as f from us),
rs as (select *, case f when '1' then greatest(rx, r2) when 'X' then greatest(r1, r2) else greatest(r1, rx) end as s2, greatest(r1, rx, r2) as s1,
    case f when '1' then case when rx >= r2 then 'X' else '2' end when 'X' then case when r1 >= r2 then '1' else '2' end else case when r1 >= rx then '1' else 'X' end end as g from rk),
bt as (select *, case when cf >= 0.7 and s1 - s2 >= 0.25 then 'simple' when cf >= 0.5 and s2 >= 0.25 then 'doble' else 'triple' end as tipo from rs)
"""


def recommended(spark: SparkSession, sf: str) -> DataFrame:
    rows = matchdays(spark, sf)
    p = views.matches_with_sources(spark, sf).filter(F.col("market_1").isNotNull())
    predictions = p.select(
        F.floor(F.col("match_id") / 15).cast("int").alias("jornada"), (F.col("match_id") % 15 + 1).cast("int").alias("num"),
        *[F.round(f"logit_prob_{s}", 4).alias(f"prob_{s}") for s in ("1", "x", "2")], F.lit("1").alias("signo_modelo"),
        ((F.col("cust") % 11) / 10.0).alias("confianza"), ((F.col("match_id") % 10) / 10.0).alias("calidad_datos"),
    )
    return matchday.with_recommendation(matchday.integrate_predictions(rows, predictions))


@query("J9 P32", PCT + _PRED + f"""
select match_id, ok as modelo_disponible, f as signo_principal, tipo as tipo_apuesta, case tipo when 'simple' then f when 'doble' then {_PLAY.format("f", "g")} else '1X2' end as apuesta_recomendada,
  round(s1 - s2, 3) as gap_probabilidad from bt""")
def matchday_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    out = recommended(spark, sf).filter(F.col("num") < 15)
    return out.select("match_id", "modelo_disponible", "signo_principal", "tipo_apuesta", "apuesta_recomendada", "gap_probabilidad")


@query("A21 SNK6", PCT + _PRED + """
select jornada, cast(sum(case when ok then 1 else 0 end) as bigint) as partidos_con_prediccion, cast(sum(case when ok then 0 else 1 end) as bigint) as partidos_sin_prediccion,
  count(*) as partidos_con_recomendacion, cast(sum(case when tipo = 'simple' then 1 else 0 end) as bigint) as partidos_sin_dobles, cast(sum(case when tipo = 'doble' then 1 else 0 end) as bigint) as partidos_con_dobles,
  cast(sum(case when tipo = 'triple' then 1 else 0 end) as bigint) as partidos_con_triple, round(sum(case when ok then conf else 0 end) / greatest(1, sum(case when ok then 1 else 0 end)), 3) as confianza_media from bt group by jornada""")
def matchday_summary(spark: SparkSession, sf: str) -> DataFrame:
    return matchday.package_summary(recommended(spark, sf)).drop("partidos_sin_recomendacion")


@query("SNK7 SNK10", PCT + _PRED + f"""
select jornada, cast(count(*) as int) as partidos, string_agg(concat(num, ':', f, ':', case tipo when 'simple' then f when 'doble' then {_PLAY.format("f", "g")} else '1X2' end), '|' order by num) as apuestas,
  round(sum(case when ok then p1 else 0.333 end), 4) as suma_p1 from bt group by jornada""")
def matchday_contract(spark: SparkSession, sf: str) -> DataFrame:
    out = matchday.api_contract(recommended(spark, sf))
    bets = F.transform("partidos", lambda m: F.concat_ws(":", m["numero"].cast("string"), m["signo_maestro"], m["apuesta"]))
    total = F.aggregate("partidos", F.lit(0.0), lambda acc, m: acc + m["probabilidades"]["1"])
    return out.select("jornada", F.size("partidos").alias("partidos"), F.array_join(bets, "|").alias("apuestas"), F.round(total, 4).alias("suma_p1"))


@query("F30 P39 P40 P38", PCT + """, t as (select jornada, num, case when q1 is null or qx is null then 1 / 3.0 else q1 / (q1 + qx + q2) end as p1, case when q1 is null or qx is null then 1 / 3.0 else qx / (q1 + qx + q2) end as px,
    case when q1 is null or qx is null then 1 / 3.0 else q2 / (q1 + qx + q2) end as p2 from pc where num < 15),
z as (select *, greatest(p1, px, p2) as best, least(p1, px, p2) as low from t), y as (select *, case when best = p1 then greatest(px, p2) when best = px then greatest(p1, p2) else greatest(p1, px) end as second from z),
c as (select *, row_number() over (partition by jornada order by round(second, 12) desc, num) <= 3 as dbl from y)
select jornada, round(sum(case when dbl then best + second else best end), 6) as expected_hits, round(sum(case when dbl then second end), 6) as second_sum,
  string_agg(case when dbl then case when p1 = low then 'X2' when px = low then '12' else '1X' end when p1 = best then '1' when px = best then 'X' else '2' end, '|' order by num) as signs from c group by jornada""")
def optimised_matchdays(spark: SparkSession, sf: str) -> DataFrame:
    best, _ = matchday.optimise_matchdays(matchdays(spark, sf))
    return best.select("jornada", r6("expected_hits"), r6("second_sum"), F.array_join("signs", "|").alias("signs"))


@query("F29", TICKETS.split(", z as")[0] + """, f as (select t.*, case when s.match_id % 45 > 0 then case s.cust % 3 when 0 then '1' when 1 then 'X' else '2' end end as sg from t join s on s.match_id = t.match_id)
select ticket_id, case when count(sg) = 14 then string_agg(sg, '' order by num) end as signs, round(case when count(sg) = 14 then sum(case sg when '1' then p1 when 'X' then px else p2 end) end, 6) as expected_hits from f group by ticket_id""")
def reference_tickets(spark: SparkSession, sf: str) -> DataFrame:
    signs = matchdays(spark, sf).select("match_id", "sistema")
    rows = ticket_rows(spark, sf).filter(F.col("num") < 15).join(signs, "match_id")
    out = ops.reference_ticket(rows, ["ticket_id"], "sistema")
    return out.select("ticket_id", F.array_join("signs", "").alias("signs"), r6("expected_hits"))


@query("P37", PCT + " select jornada, cast(min(match_date) - interval 1 day as date) as cutoff from pc group by jornada")
def matchday_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return matchday.cutoff_dates(matchdays(spark, sf))


@query("P35", S + """ select match_id, case when match_id % 7 = 0 then '2025-2026' else season end as season from s""")
def inferred_seasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.matches(spark, sf)
    return rows.select("match_id", infer_season(F.when(F.col("match_id") % 7 != 0, F.col("date"))).alias("season"))


_STAMPS = """with e as (select event_id, case event_id % 17 when 0 then null when 1 then ' ' when 2 then 'ayer' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as odds_observed_at,
    case event_id % 19 when 0 then null else strftime(ts + case event_id % 5 when 0 then interval 0 second when 1 then -interval 1 hour else interval 2 hour end, '%Y-%m-%d %H:%M:%S') end as prediction_cutoff_at,
    case event_id % 23 when 0 then '' else strftime(ts + case event_id % 7 when 0 then interval 2 hour else interval 1 day end, '%Y-%m-%d %H:%M:%S') end as kickoff_at from events),
i as (select event_id, concat_ws('|', case when odds_observed_at is null or trim(odds_observed_at) = '' then 'odds_observed_at_ausente' when odds_observed_at = 'ayer' then 'odds_observed_at_invalido' end,
    case when prediction_cutoff_at is null then 'prediction_cutoff_at_ausente' end, case when kickoff_at = '' then 'kickoff_at_ausente' end) as miss, try_cast(odds_observed_at as timestamp) as o, try_cast(prediction_cutoff_at as timestamp) as c, try_cast(kickoff_at as timestamp) as k from e),
r as (select event_id, case when miss <> '' then miss else concat_ws('|', case when o > c then 'cuotas_observadas_despues_del_corte' end, case when not (c < k) then 'corte_no_anterior_al_kickoff' end) end as issues from i)
"""


def stamped(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    i = F.col("event_id")

    def shown(hours: Column) -> Column:
        return F.date_format(F.from_unixtime(F.unix_timestamp("ts") + hours * 3600).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")

    return e.select(
        "event_id", i.alias("num"),
        F.when(i % 17 == 1, " ").when(i % 17 == 2, "ayer").when(i % 17 != 0, shown(F.lit(0))).alias("odds_observed_at"),
        F.when(i % 19 != 0, shown(F.when(i % 5 == 0, 0).when(i % 5 == 1, -1).otherwise(2))).alias("prediction_cutoff_at"),
        F.when(i % 23 == 0, "").otherwise(shown(F.when(i % 7 == 0, 2).otherwise(24))).alias("kickoff_at"),
    )


@query("P33", _STAMPS + "select event_id, issues from r")
def odds_timestamp_issues(spark: SparkSession, sf: str) -> DataFrame:
    out = matchday.odds_timestamp_issues(stamped(spark, sf))
    return out.select("event_id", F.array_join("issues", "|").alias("issues"))


@query("P33", _STAMPS + """select sum(case when issues <> '' then 1 else 0 end) = 0 as ok, cast(sum(case when issues = '' then 1 else 0 end) as bigint) as partidos_validados,
  cast(sum(case when issues <> '' then 1 else 0 end) as bigint) as violaciones from r""")
def odds_timestamp_report(spark: SparkSession, sf: str) -> DataFrame:
    return matchday.odds_timestamp_report(matchday.odds_timestamp_issues(stamped(spark, sf)))


_QUALITY = S + """, f as (select match_id, odd_1, logit_prob_1, cust % 3 as hpj, match_id % 4 as apj, case when cust % 5 = 0 then 1500.0 else 1500.0 + cust % 7 end as he, case when match_id % 2 = 0 then 1500.0 else 1490.0 end as ae, case when cust % 6 = 0 then null else 1.0 end as fm from s),
q as (select match_id, odd_1 is null as a, hpj = 0 as b, apj = 0 as c, he = 1500 and ae = 1500 as d, fm is null as e from f)
select match_id, concat_ws('|', case when a then 'sin_cuotas_mercado' end, case when b then 'sin_partidos_local' end, case when c then 'sin_partidos_visitante' end, case when d then 'equipos_sin_elo' end, case when e then 'sin_forma_local' end) as avisos,
  round(greatest(0, 1 - case when a then 0.3 else 0 end - case when b then 0.2 else 0 end - case when c then 0.2 else 0 end - case when d then 0.15 else 0 end - case when e then 0.1 else 0 end) + 1e-9, 2) as calidad_datos from q"""


@query("P30", _QUALITY)
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    s = views.matches_with_sources(spark, sf)
    rows = s.select(
        "match_id", "odd_1", F.lit(0.5).alias("market_1"), (F.col("cust") % 3).cast("double").alias("home_table_pj"), (F.col("match_id") % 4).cast("double").alias("away_table_pj"),
        F.when(F.col("cust") % 5 == 0, 1500.0).otherwise(1500.0 + F.col("cust") % 7).alias("home_elo"), F.when(F.col("match_id") % 2 == 0, 1500.0).otherwise(1490.0).alias("away_elo"),
        F.when(F.col("cust") % 6 != 0, 1.0).alias("home_form_pts_5"),
    )
    return matchday.with_data_quality(rows).select("match_id", F.array_join("avisos", "|").alias("avisos"), "calidad_datos")


@query("M18 F10 F11 A5 J15")
def score_match_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Score forecast of every fifteenth match to come after the cutoff."""
    history = views.matches(spark, sf)
    cutoff = "2000-07-01"
    numbered = history.withColumn("num", (F.col("match_id") % 15 + 1).cast("int"))
    to_come = numbered.filter(F.col("date") >= F.lit(cutoff).cast("date"))
    upcoming = to_come.filter(F.col("num") == settings.BLOCK_SIZE).select(
        "match_id", "num", "home", "away", "date", "odd_1", "odd_x", "odd_2"
    )
    features = ft.upcoming_features(upcoming, history, cutoff, pool="division")
    return matchday.predict_score_match(features, models.league_mean_goals(history, cutoff))



@query("J10 P38", PCT + " select match_id, cast(min(num) over (partition by jornada, local, visitante) as int) as num from pc")
def matched_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions find their match number by folded team names within the matchday."""
    rows = matchdays(spark, sf)
    predictions = rows.select("match_id", "jornada", F.lit(0).alias("num"), F.upper("home").alias("home"), F.lower("away").alias("away"))
    return matchday.match_numbers(predictions, rows).select("match_id", "num")


@query("A29 A1", BASE + blend_sql(_W, 0.013, 0.0071) + """, c as (select season, division, case when p1 >= px and p1 >= p2 then '1' when px >= p2 then 'X' else '2' end as top, fav, result from bl),
d as (select season, division, count(*) as n, avg(case when case when top = 'X' and fav is not null and fav <> 'X' then fav else top end = result then 1.0 else 0 end) as acc from c group by 1, 2)
select season, string_agg(concat(division, ':', n), '|' order by division) as divisiones, round(sum(acc), 6) as accuracy_sum from d group by season""")
def season_report(spark: SparkSession, sf: str) -> DataFrame:
    predictions = blend.apply_config(sources(spark, sf), _CONFIG, "latest")
    summary = predictions.select("season").distinct()
    out = backtests.season_report(predictions, summary)
    entries = F.map_entries("divisiones")
    text = F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"]["matches"].cast("string")))
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"]["accuracy_simple"])
    return out.select("season", F.array_join(text, "|").alias("divisiones"), F.round(total, 6).alias("accuracy_sum"))
