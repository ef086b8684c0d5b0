"""Queries over standings, positions, form, Elo and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog import views
from touchline.catalog.registry import query, r6
from touchline.operators import elo as elo_ops
from touchline.operators import features as ft
from touchline.operators import form
from touchline.operators import models, ordinal
from touchline.session import stage

M = f"with m as ({views.MATCHES_SQL})"
TEAM = """, t as (
  select match_id, match_date, division, season, home, away, 'H' as side, home as team,
    case result when '1' then 3 when 'X' then 1 else 0 end as pts, fthg as gf, ftag as ga, hs as shots, "as" as shots_against,
    hst as sot, ast as sot_against, home_xg as xg, away_xg as xg_against from m
  union all
  select match_id, match_date, division, season, home, away, 'A', away,
    case result when '2' then 3 when 'X' then 1 else 0 end, ftag, fthg, "as", hs, ast, hst, away_xg, home_xg from m)
"""
_STATS = form.FORM_STATS
# Last five rows before the day, found by row number: independent of the first-row rule in Spark.
FORM = TEAM + f""", n as (
  select *, row_number() over (partition by team order by match_date, division, home, away, match_id, side) as rn,
    row_number() over (partition by team, side order by match_date, division, home, away, match_id) as srn from t),
b as (select team, match_date, min(rn) - 1 as cnt, max(match_date) as d from n group by team, match_date),
sb as (select team, side, match_date, min(srn) - 1 as cnt from n group by team, side, match_date),
f as (select b.team, b.match_date,
    {", ".join(f"case when count(u.team) > 0 and count(u.{s}) = count(u.team) then avg(u.{s}) end as {s}" for s in _STATS)},
    max(u.match_date) as last_date
  from b left join n u on u.team = b.team and u.rn between b.cnt - 4 and b.cnt group by b.team, b.match_date),
v as (select sb.team, sb.side, sb.match_date, avg(u.pts) as side_pts
  from sb left join n u on u.team = sb.team and u.side = sb.side and u.srn between sb.cnt - 4 and sb.cnt
  group by sb.team, sb.side, sb.match_date)
"""


@query("P7 F7 W4 W5 T1 U5", M + TEAM + """
select division, season, team, cast(row_number() over (partition by division, season order by pts desc, gd desc, gf desc, team) as bigint) as position,
  pj, pts, pg, pe, pp, gf, ga, gd, round(pts / cast(pj as double), 6) as ppg
from (select division, season, team, count(*) as pj, cast(sum(pts) as bigint) as pts,
    cast(sum(case when pts = 3 then 1 else 0 end) as bigint) as pg, cast(sum(case when pts = 1 then 1 else 0 end) as bigint) as pe,
    cast(sum(case when pts = 0 then 1 else 0 end) as bigint) as pp, cast(sum(gf) as bigint) as gf, cast(sum(ga) as bigint) as ga,
    cast(sum(gf) - sum(ga) as bigint) as gd from t group by division, season, team) x""")
def league_table(spark: SparkSession, sf: str) -> DataFrame:
    table = form.final_standings(form.team_rows(form.played(views.matches(spark, sf)), form.GOALS))
    return table.withColumn("position", F.col("position").cast("bigint")).withColumn("ppg", F.round("ppg", 6))


@query("W4 J14 W9", M + TEAM + """, d as (
  select division, season, team, match_date, count(*) as pj, sum(pts) as pts, sum(gf) as gf, sum(ga) as ga,
    sum(case when pts = 3 then 1 else 0 end) as pg, sum(case when pts = 1 then 1 else 0 end) as pe
  from t group by division, season, team, match_date)
select division, season, team, match_date as date, cast(coalesce(sum(pj) over w, 0) as bigint) as pj,
  cast(coalesce(sum(pts) over w, 0) as bigint) as pts, cast(coalesce(sum(pg) over w, 0) as bigint) as pg,
  cast(coalesce(sum(pe) over w, 0) as bigint) as pe, cast(coalesce(sum(gf) over w, 0) as bigint) as gf,
  cast(coalesce(sum(ga) over w, 0) as bigint) as ga
from d window w as (partition by division, season, team order by match_date rows between unbounded preceding and 1 preceding)""")
def standings_before_match_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = form.standings_before(form.team_rows(form.played(views.matches(spark, sf)), form.GOALS))
    return rows.drop("pp")


# A match sees every team that appeared before it in match order, with standings of earlier days.
@query("W5 W9", M + TEAM + """, fa as (
  select division, season, team, min(match_date) as d0 from t group by division, season, team),
o as (select *, row_number() over (partition by division, season, match_date order by home, away, match_id) as at from m),
fo as (select fa.division, fa.season, fa.team, fa.d0, min(o.at) as at0 from fa join o on o.division = fa.division and o.season = fa.season
    and o.match_date = fa.d0 and fa.team in (o.home, o.away) group by fa.division, fa.season, fa.team, fa.d0),
dd as (select distinct division, season, match_date from m),
s as (select dd.division, dd.season, dd.match_date, fo.team, fo.d0, fo.at0, coalesce(sum(t.pts), 0) as pts,
    coalesce(sum(t.gf - t.ga), 0) as gd, coalesce(sum(t.gf), 0) as gf
  from dd join fo on fo.division = dd.division and fo.season = dd.season and fo.d0 <= dd.match_date
  left join t on t.division = dd.division and t.season = dd.season and t.team = fo.team and t.match_date < dd.match_date
  group by dd.division, dd.season, dd.match_date, fo.team, fo.d0, fo.at0),
x as (select o.match_id, o.match_date, o.at, o.home, o.away, s.team,
    row_number() over (partition by o.match_id order by s.pts desc, s.gd desc, s.gf desc, s.team) as pos
  from o join s on s.division = o.division and s.season = o.season and s.match_date = o.match_date
    and (s.d0 < o.match_date or s.at0 <= o.at))
select match_id, cast(max(case when team = home then pos end) as bigint) as home_pos, cast(max(case when team = away then pos end) as bigint) as away_pos
from x group by match_id""")
def table_positions(spark: SparkSession, sf: str) -> DataFrame:
    places = form.table_positions(views.matches(spark, sf))
    return places.groupBy("match_id").agg(
        F.max(F.when(F.col("side") == "H", F.col("position"))).cast("bigint").alias("home_pos"),
        F.max(F.when(F.col("side") == "A", F.col("position"))).cast("bigint").alias("away_pos"),
    )


@query("W1 W2 W3 W9 W16", M + FORM + f"""
select f.team, v.side, f.match_date as date, {", ".join(f"round(f.{s}, 6) as team_{s}" for s in _STATS)}, f.last_date,
  round(v.side_pts, 6) as side_pts
from f join v on v.team = f.team and v.match_date = f.match_date""")
def recent_form(spark: SparkSession, sf: str) -> DataFrame:
    out = form.recent_form(form.team_rows(form.played(views.matches(spark, sf))))
    return out.select("team", "side", "date", *[r6(f"team_{s}") for s in _STATS], "last_date", r6("side_pts"))


_LAMBDA = """, p as (select m.match_id, h.gf as hgf, h.ga as hga, h.sot as hs, h.sot_against as hsa,
    a.gf as agf, a.ga as aga, a.sot as as_, a.sot_against as asa
  from m left join f h on h.team = m.home and h.match_date = m.match_date
  left join f a on a.team = m.away and a.match_date = m.match_date),
g as (select match_id, case when hgf is null then aga when aga is null then hgf else (hgf + aga) / 2 end as lh,
    case when agf is null then hga when hga is null then agf else (agf + hga) / 2 end as la,
    0.3 * case when hs is null then asa when asa is null then hs else (hs + asa) / 2 end as sh,
    0.3 * case when as_ is null then hsa when hsa is null then as_ else (as_ + hsa) / 2 end as sa from p),
l as (select match_id, case when sh is null then lh when lh is null then sh else (lh + sh) / 2 end as lambda_home,
    case when sa is null then la when la is null then sa else (la + sa) / 2 end as lambda_away from g)
"""
LAMBDAS = M + FORM + _LAMBDA


def lambdas(spark: SparkSession, sf: str) -> DataFrame:
    return ft.with_expected_goals(ft.with_form(views.matches(spark, sf)))


@query("W7 P47 F8 J20", LAMBDAS + """, k as (select unnest(range(8)) as x), c as (
  select l.match_id, l.lambda_home, l.lambda_away, a.x as hg, b.x as ag,
    exp(-lambda_home) * pow(lambda_home, a.x) / factorial(cast(a.x as int)) * exp(-lambda_away) * pow(lambda_away, b.x) / factorial(cast(b.x as int)) as p
  from l, k a, k b)
select match_id, round(max(lambda_home), 6) as lambda_home, round(max(lambda_away), 6) as lambda_away,
  round(sum(case when hg > ag then p end) / sum(p), 6) as poisson_1, round(sum(case when hg = ag then p end) / sum(p), 6) as poisson_x,
  round(sum(case when hg < ag then p end) / sum(p), 6) as poisson_2
from c group by match_id""")
def expected_goals_and_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = ft.with_outcome_model(lambdas(spark, sf))
    return out.select("match_id", *[r6(c) for c in ("lambda_home", "lambda_away", "poisson_1", "poisson_x", "poisson_2")])


@query("P21 P22 P16", M + """, i as (select match_id,
    case when odd_1 <> 0 then 1 / odd_1 end as i1, case when odd_x <> 0 then 1 / odd_x end as ix, case when odd_2 <> 0 then 1 / odd_2 end as i2,
    1 / open_odd_1 as o1, 1 / open_odd_x as ox, 1 / open_odd_2 as o2 from m),
q as (select match_id, i1 / (coalesce(i1, 0) + coalesce(ix, 0) + coalesce(i2, 0)) as p1, ix / (coalesce(i1, 0) + coalesce(ix, 0) + coalesce(i2, 0)) as px,
    i2 / (coalesce(i1, 0) + coalesce(ix, 0) + coalesce(i2, 0)) as p2, o1 / (coalesce(o1, 0) + coalesce(ox, 0) + coalesce(o2, 0)) as q1,
    ox / (coalesce(o1, 0) + coalesce(ox, 0) + coalesce(o2, 0)) as qx, o2 / (coalesce(o1, 0) + coalesce(ox, 0) + coalesce(o2, 0)) as q2 from i)
select match_id, round(p1, 6) as market_1, round(px, 6) as market_x, round(p2, 6) as market_2, round(q1, 6) as open_market_1,
  round(qx, 6) as open_market_x, round(q2, 6) as open_market_2, round(p1 - q1, 6) as market_move_1, round(px - qx, 6) as market_move_x,
  round(p2 - q2, 6) as market_move_2, round(-(p1 * ln(p1) + px * ln(px) + p2 * ln(p2)), 6) as market_entropy,
  round(greatest(p1, px, p2) - greatest(q1, qx, q2), 6) as close_open_fav_gap
from q""")
def implied_market(spark: SparkSession, sf: str) -> DataFrame:
    names = ("market_1", "market_x", "market_2")
    return ft.with_market(views.matches(spark, sf)).select(
        "match_id", *[r6(n) for n in names], *[r6(f"open_{n}") for n in names],
        *[r6(f"market_move_{s}") for s in ("1", "x", "2")], r6("market_entropy"), r6("close_open_fav_gap"),
    )


# The oracle replays all matches one by one with the ratings of both divisions in one list.
@query("W6 W9", M + """, tm as (select team, row_number() over (partition by division order by team) as ti, division from (
    select home as team, division from m union select away, division from m) z),
o as (select m.match_id, m.division, m.match_date, m.home, m.away, h.ti as hi, a.ti as ai,
    case result when '1' then 1.0 when 'X' then 0.5 else 0.0 end as s,
    row_number() over (partition by m.division order by m.match_date, m.home, m.away, m.match_id) as i
  from m join tm h on h.team = m.home and h.division = m.division join tm a on a.team = m.away and a.division = m.division),
z as (with recursive e(division, i, r) as (
    select division, cast(0 as bigint), list_transform(range(40), lambda x: cast(1500 as double)) from (select distinct division from o)
    union all
    select x.division, x.i, list_transform(e.r, lambda v, j: case
        when j = x.hi then v + 24 * (x.s - 1 / (1 + pow(10, (e.r[x.ai] - e.r[x.hi] - 55) / 400)))
        when j = x.ai then v - 24 * (x.s - 1 / (1 + pow(10, (e.r[x.ai] - e.r[x.hi] - 55) / 400))) else v end)
    from e join o x on x.division = e.division and x.i = e.i + 1)
  select * from e),
b as (select division, match_date, min(i) - 1 as i0 from o group by division, match_date)
select o.match_id, round(z0.r[o.hi], 6) as home_elo, round(z0.r[o.ai], 6) as away_elo, round(z1.r[o.hi], 6) as home_elo_after,
  round(z1.r[o.ai], 6) as away_elo_after
from o join b on b.division = o.division and b.match_date = o.match_date
join z z0 on z0.division = o.division and z0.i = b.i0 join z z1 on z1.division = o.division and z1.i = o.i""")
def elo_ratings(spark: SparkSession, sf: str) -> DataFrame:
    # Teams never change division here, so each division is a pool of its own.
    out = elo_ops.elo_ratings(views.matches(spark, sf), pool="division")
    return out.select("match_id", *[r6(c) for c in ("home_elo", "away_elo", "home_elo_after", "away_elo_after")])


# One list of twenty ratings a country, replayed match by match.
@query("W6 W9", f"""with c as ({views.COUNTRIES_SQL}), o as (
  select match_id, country, match_date, cast(right(home_team, 2) as int) + 1 as hi, cast(right(away_team, 2) as int) + 1 as ai,
    case result when '1' then 1.0 when 'X' then 0.5 else 0.0 end as s,
    row_number() over (partition by country order by match_date, league, home_team, away_team, match_id) as i from c),
z as (with recursive e(country, i, r) as (
    select country, cast(0 as bigint), list_transform(range(20), lambda x: cast(1500 as double)) from (select distinct country from o)
    union all
    select x.country, x.i, list_transform(e.r, lambda v, j: case
        when j = x.hi then v + 24 * (x.s - 1 / (1 + pow(10, (e.r[x.ai] - e.r[x.hi] - 55) / 400)))
        when j = x.ai then v - 24 * (x.s - 1 / (1 + pow(10, (e.r[x.ai] - e.r[x.hi] - 55) / 400))) else v end)
    from e join o x on x.country = e.country and x.i = e.i + 1)
  select * from e),
b as (select country, match_date, min(i) - 1 as i0 from o group by country, match_date)
select o.match_id, round(z0.r[o.hi], 6) as home_elo, round(z0.r[o.ai], 6) as away_elo, round(z1.r[o.hi], 6) as home_elo_after,
  round(z1.r[o.ai], 6) as away_elo_after
from o join b on b.country = o.country and b.match_date = o.match_date
join z z0 on z0.country = o.country and z0.i = b.i0 join z z1 on z1.country = o.country and z1.i = o.i""")
def elo_by_country(spark: SparkSession, sf: str) -> DataFrame:
    # No pool is named: the groups of leagues are found from the fixtures.
    out = elo_ops.elo_ratings(views.country_matches(spark, sf))
    return out.select("match_id", *[r6(c) for c in ("home_elo", "away_elo", "home_elo_after", "away_elo_after")])


CUTOFF = "1999-07-01"


@query("J15 W10 W16", M + TEAM + f""", n as (
  select *, row_number() over (partition by team order by match_date desc, division desc, home desc, away desc, match_id desc) as k,
    row_number() over (partition by team, side order by match_date desc, division desc, home desc, away desc, match_id desc) as sk
  from t where match_date < date '{CUTOFF}')
select team, {", ".join(f"round(case when count(case when k <= 5 then {s} end) = count(case when k <= 5 then 1 end) then avg(case when k <= 5 then {s} end) end, 6) as team_{s}" for s in _STATS)},
  max(match_date) as last_date, round(avg(case when sk <= 5 and side = 'H' then pts end), 6) as home_side_pts,
  round(avg(case when sk <= 5 and side = 'A' then pts end), 6) as away_side_pts, max(case when k = 1 then division end) as last_division
from n group by team""")
def team_state_at_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    history = views.matches(spark, sf)
    state = ft.team_state(history, CUTOFF)
    last = ft.last_divisions(history.filter(F.col("date") < F.lit(CUTOFF).cast("date")))
    out = state.join(last.withColumnRenamed("division", "last_division"), "team")
    return out.select("team", *[r6(f"team_{s}") for s in _STATS], "last_date", r6("home_side_pts"), r6("away_side_pts"), "last_division")


@query("W13 T1", M + """, o as (select match_id, row_number() over (order by match_date, division, home, away, match_id) - 1 as pos, count(*) over () as n from m)
select match_id, cast(pos as bigint) as pos, pos < floor(n * 0.8) as train_80, pos < floor(n * 0.84) as train_84 from o""")
def temporal_splits(spark: SparkSession, sf: str) -> DataFrame:
    out = ordinal.with_ordinal(views.matches(spark, sf), name="pos", size="n")
    return out.select(
        "match_id", F.col("pos").cast("bigint").alias("pos"),
        (F.col("pos") < F.floor(F.col("n") * F.lit(0.8))).alias("train_80"),
        (F.col("pos") < F.floor(F.col("n") * F.lit(0.84))).alias("train_84"),
    )


@query("W11 W15", M + """, o as (select match_id, season, row_number() over (partition by season order by match_date, division, home, away, match_id) - 1 as pos,
    count(*) over (partition by season) as n from m),
b as (select match_id, season, cast(floor(pos / 15) + 1 as bigint) as block, cast(pos % 15 + 1 as int) as num, n from o)
select match_id, season, block, num, block <= greatest(1, floor(floor(n / 15) * 0.4)) as is_holdout from b where block * 15 <= n""")
def ticket_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = ordinal.with_calibration_holdout(ordinal.with_blocks(views.matches(spark, sf), ["season"]))
    return blocks.select("match_id", "season", F.col("block").cast("bigint").alias("block"), "num", "is_holdout")


@query("W14 A27 U5", M + """
select target, division, cast(sum(case when cast(substr(m.season, 1, 4) as int) < cast(substr(target, 1, 4) as int) then 1 else 0 end) as bigint) as train_matches,
  cast(sum(case when m.season = target then 1 else 0 end) as bigint) as test_matches,
  count(distinct case when cast(substr(m.season, 1, 4) as int) < cast(substr(target, 1, 4) as int) then m.season end) as train_seasons
from m, (select distinct season as target from m) s group by target, division""")
def walk_forward_splits(spark: SparkSession, sf: str) -> DataFrame:
    # One row per season and division is all that the splits of every target read.
    counts = stage(views.matches(spark, sf).groupBy("season", "division").agg(F.count(F.lit(1)).alias("n")))
    divisions = counts.select("division").distinct()
    out = None
    for target in ordinal.seasons_in_order(counts):
        train, test = ordinal.split_by_season(counts, target)
        sizes = divisions.join(
            train.groupBy("division").agg(F.sum("n").alias("train_matches"), F.count_distinct("season").alias("train_seasons")), "division", "left"
        ).join(test.groupBy("division").agg(F.sum("n").alias("test_matches")), "division", "left")
        part = sizes.fillna(0).withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return out



@query("A5", M + """
select round(coalesce(avg(fthg), 1.45), 6) as mean_home, round(coalesce(avg(ftag), 1.10), 6) as mean_away from m where match_date < date '1999-07-01'""")
def league_mean_goals(spark: SparkSession, sf: str) -> DataFrame:
    return models.league_mean_goals(views.matches(spark, sf), CUTOFF).select(r6("mean_home"), r6("mean_away"))
