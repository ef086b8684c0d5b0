"""Queries over the whole feature table: history, one cutoff, and all matchdays in one plan. All 88 columns have an oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog import views
from touchline.catalog.registry import REGISTRY, query
from touchline.catalog.team_state import CUTOFF, FORM, M, TEAM
from touchline.operators import features as ft
from touchline.operators import form
from touchline.schemas import FEATURE_TABLE_COLUMNS
from touchline.session import in_small_methods


def _exact(sql: str) -> str:
    """A registered oracle without its rounding, to go on calculating with."""
    return re.sub(r"round\((.+?), 6\)", r"\1", sql)


_NAMES = {"pts": "form_pts_5"} | {s: f"{s}_5" for s in form.FORM_STATS if s != "pts"}
_STATS = ", ".join(f"f.{s}" for s in form.FORM_STATS)

# What follows from the state of both sides: h_ and a_ columns to lambdas, outcome model and differences.
_FROM_STATE = """,
g as (
  select *, case when h_gf is null then a_ga when a_ga is null then h_gf else (h_gf + a_ga) / 2 end as lh,
    case when a_gf is null then h_ga when h_ga is null then a_gf else (a_gf + h_ga) / 2 end as la,
    0.3 * case when h_sot is null then a_sot_against when a_sot_against is null then h_sot else (h_sot + a_sot_against) / 2 end as sh,
    0.3 * case when a_sot is null then h_sot_against when h_sot_against is null then a_sot else (a_sot + h_sot_against) / 2 end as sa from both_sides
),
l as (
  select *, case when sh is null then lh when lh is null then sh else (lh + sh) / 2 end as lambda_home,
    case when sa is null then la when la is null then sa else (la + sa) / 2 end as lambda_away from g
),
pk as (
  select l.match_id, a.x as hg, b.x as ag, exp(-lambda_home) * pow(lambda_home, a.x) / factorial(cast(a.x as int))
    * exp(-lambda_away) * pow(lambda_away, b.x) / factorial(cast(b.x as int)) as p
  from l, (select unnest(range(8)) as x) a, (select unnest(range(8)) as x) b
),
po as (
  select match_id, sum(case when hg > ag then p end) / sum(p) as poisson_1, sum(case when hg = ag then p end) / sum(p) as poisson_x,
    sum(case when hg < ag then p end) / sum(p) as poisson_2 from pk group by match_id
)"""


def _columns() -> dict[str, str]:
    """SQL of every published column."""
    out = {c: f"l.{c}" for c in ("home", "away", "division", "division_code", "season", "source_file", "FTHG", "FTAG", "result")}
    out["date"] = "l.match_date"
    out |= {c: f"l.{c}" for c in ("odd_1", "odd_x", "odd_2", "open_odd_1", "open_odd_x", "open_odd_2", "lambda_home", "lambda_away")}
    out |= {f"poisson_{s}": f"po.poisson_{s}" for s in "1x2"}
    for side, p in (("home", "h"), ("away", "a")):
        out |= {f"{side}_{n}": f"{p}_{s}" for s, n in _NAMES.items()}
        out |= {f"{side}_{side}_pts_5": f"{p}_side_pts", f"{side}_elo": f"{p}_elo", f"days_rest_{side}": f"cast(date_diff('day', {p}_last_date, l.match_date) as double)"}
        out |= {f"{side}_table_{s}": f"cast(coalesce({p}_t{s}, 0) as double)" for s in ("pts", "pj", "gf", "ga")}
        out |= {f"{side}_table_gd": f"cast(coalesce({p}_tgf - {p}_tga, 0) as double)", f"{side}_table_ppg": f"case when {p}_tpj > 0 then {p}_tpts / cast({p}_tpj as double) end"}
        out[f"{side}_table_pos"] = f"cast({p}_pos as double)"
    minus = lambda a, b: f"({out[a]}) - ({out[b]})"
    pairs = {
        "table_pos_diff": ("away_table_pos", "home_table_pos"), "table_pts_diff": ("home_table_pts", "away_table_pts"), "table_ppg_diff": ("home_table_ppg", "away_table_ppg"),
        "table_gf_diff": ("home_table_gf", "away_table_gf"), "table_ga_diff": ("away_table_ga", "home_table_ga"), "table_gd_diff": ("home_table_gd", "away_table_gd"),
        "days_rest_diff": ("days_rest_home", "days_rest_away"), "form_pts_diff": ("home_form_pts_5", "away_form_pts_5"), "goal_for_diff": ("home_gf_5", "away_gf_5"),
        "goal_against_diff": ("away_ga_5", "home_ga_5"), "venue_form_diff": ("home_home_pts_5", "away_away_pts_5"), "shots_diff": ("home_shots_5", "away_shots_5"),
        "shots_against_diff": ("away_shots_against_5", "home_shots_against_5"), "sot_diff": ("home_sot_5", "away_sot_5"), "sot_against_diff": ("away_sot_against_5", "home_sot_against_5"),
        "xg_for_diff": ("home_xg_5", "away_xg_5"), "xg_against_diff": ("away_xg_against_5", "home_xg_against_5"),
    }
    out |= {name: minus(*sides) for name, sides in pairs.items()}
    out["elo_diff"] = "h_elo + 55 - a_elo"
    market = ("market_1", "market_x", "market_2", "open_market_1", "open_market_x", "open_market_2", "market_move_1", "market_move_x", "market_move_2", "market_entropy", "close_open_fav_gap")
    out |= {c: f"mk.{c}" for c in market}
    return out


_TEXTS = ("date", "home", "away", "division", "division_code", "season", "source_file", "FTHG", "FTAG", "result")


def _selected() -> str:
    sql = _columns()
    return ", ".join(f'{sql[c]} as "{c}"' if c in _TEXTS else f'round({sql[c]}, 6) + 0.0 as "{c}"' for c in FEATURE_TABLE_COLUMNS)


def _rounded(name: str) -> Column:
    """Six digits, halves away from zero, in plain arithmetic as the oracle has it; F.round writes and reads a text for every value."""
    value = F.col(name).cast("double")
    plain = F.signum(value) * (F.floor(F.abs(value) * 1e6 + 0.5) / 1e6)
    return (F.when(F.abs(value) < 1e9, plain).otherwise(F.round(value, 6)) + F.lit(0.0)).alias(name)


def _compared(df: DataFrame, *more: str) -> DataFrame:
    return in_small_methods(df.select(*more, *[F.col(c) if c in _TEXTS else _rounded(c) for c in FEATURE_TABLE_COLUMNS]), "date")


_MARKET = _exact(REGISTRY["implied_market"].sql)
_ELO = _exact(REGISTRY["elo_ratings"].sql)
_SIDE = "{p}.pts as {p}_pts, " + ", ".join(f"{{p}}.{s} as {{p}}_{s}" for s in form.FORM_STATS if s != "pts") + ", {p}.last_date as {p}_last_date, {p}.side_pts as {p}_side_pts"


@query("W8 P46 P22 J14 W1 W2 W3 W4 W5 W6 W9", M + FORM + f""",
dd as (
  select division, season, team, match_date, count(*) as pj, sum(pts) as pts, sum(gf) as gf, sum(ga) as ga from t group by division, season, team, match_date
),
st as (
  select division, season, team, match_date, sum(pj) over w as tpj, sum(pts) over w as tpts, sum(gf) over w as tgf, sum(ga) over w as tga
  from dd window w as (partition by division, season, team order by match_date rows between unbounded preceding and 1 preceding)
),
state as (
  select st.*, v.side, {_STATS}, f.last_date, v.side_pts from st join f on f.team = st.team and f.match_date = st.match_date
  join v on v.team = st.team and v.match_date = st.match_date
),
elo as ({_ELO}),
pos as ({REGISTRY["table_positions"].sql}),
both_sides as (
  select m.*, case when m.division = 'Primera' then 0 else 1 end as division_code, 'orders' as source_file,
    {_SIDE.format(p="h")}, h.tpj as h_tpj, h.tpts as h_tpts, h.tgf as h_tgf, h.tga as h_tga, {_SIDE.format(p="a")}, a.tpj as a_tpj, a.tpts as a_tpts, a.tgf as a_tgf, a.tga as a_tga,
    elo.home_elo as h_elo, elo.away_elo as a_elo, pos.home_pos as h_pos, pos.away_pos as a_pos
  from m join state h on h.side = 'H' and h.team = m.home and h.match_date = m.match_date and h.division = m.division and h.season = m.season
  join state a on a.side = 'A' and a.team = m.away and a.match_date = m.match_date and a.division = m.division and a.season = m.season
  join elo on elo.match_id = m.match_id join pos on pos.match_id = m.match_id
){_FROM_STATE},
mk as ({_MARKET})
select l.match_id, {_selected()} from l left join po on po.match_id = l.match_id join mk on mk.match_id = l.match_id""")
def prematch_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(ft.prematch_features(views.matches(spark, sf), pool="division"), "match_id")


def _asof_sql(upcoming: str) -> str:
    """The oracle of forecasts: every state is looked up before the row's own cutoff, by joins over dates."""
    return M + TEAM + f""",
up as ({upcoming}),
ask as (select distinct team, cutoff from (select home as team, cutoff from up union all select away, cutoff from up) z),
n as (
  select *, row_number() over (partition by team order by match_date, division, home, away, match_id, side) as rn,
    row_number() over (partition by team, side order by match_date, division, home, away, match_id) as srn from t
),
c as (
  select ask.team, ask.cutoff, max(rn) as cnt, max(srn) filter (side = 'H') as hcnt, max(srn) filter (side = 'A') as acnt, arg_max(division, rn) as last_division,
    max(match_date) as last_date
  from ask left join n on n.team = ask.team and n.match_date < ask.cutoff group by ask.team, ask.cutoff
),
f as (
  select c.team, c.cutoff, {", ".join(f"case when count(u.team) > 0 and count(u.{s}) = count(u.team) then avg(u.{s}) end as {s}" for s in form.FORM_STATS)}
  from c left join n u on u.team = c.team and u.rn between c.cnt - 4 and c.cnt group by c.team, c.cutoff
),
sp as (
  select c.team, c.cutoff, avg(u.pts) filter (u.side = 'H' and u.srn between hcnt - 4 and hcnt) as h, avg(u.pts) filter (u.side = 'A' and u.srn between acnt - 4 and acnt) as a
  from c left join n u on u.team = c.team and u.match_date < c.cutoff group by c.team, c.cutoff
),
el as ({_ELO}),
er as (
  select c.team, c.cutoff, arg_max(case when n.side = 'H' then el.home_elo_after else el.away_elo_after end, n.rn) as elo
  from c join n on n.team = c.team and n.match_date < c.cutoff join el on el.match_id = n.match_id group by c.team, c.cutoff
),
known as (
  select up.* exclude (division), coalesce(h.last_division, a.last_division, 'Primera') as division,
    concat(cast(year(match_date) - case when month(match_date) >= 7 then 0 else 1 end as varchar(4)), '-', cast(year(match_date) + case when month(match_date) >= 7 then 1 else 0 end as varchar(4))) as season
  from (select * exclude (season) from up) up join c h on h.team = up.home and h.cutoff = up.cutoff join c a on a.team = up.away and a.cutoff = up.cutoff
),
grp as (select distinct cutoff, division, season from known),
old as (
  select g.cutoff, g.division, g.season, t.team, count(*) as pj, sum(pts) as pts, sum(gf) as gf, sum(ga) as ga
  from grp g join t on t.division = g.division and t.season = g.season and t.match_date < g.cutoff group by g.cutoff, g.division, g.season, t.team
),
came as (
  select cutoff, division, season, team, min(num) as at0 from (select cutoff, division, season, home as team, num from known union all select cutoff, division, season, away, num from known) z
  group by cutoff, division, season, team
),
place as (
  select k.match_id, s.team, row_number() over (partition by k.match_id order by s.pts desc, s.gd desc, s.gf desc, s.team) as pos
  from known k join (
    select cutoff, division, season, team, pts, gf - ga as gd, gf, cast(null as bigint) as at0 from old
    union all
    select cutoff, division, season, team, 0, 0, 0, at0 from came anti join old using (cutoff, division, season, team)
  ) s on s.cutoff = k.cutoff and s.division = k.division and s.season = k.season and (s.at0 is null or s.at0 <= k.num)
),
pos as (
  select k.match_id, max(case when p.team = k.home then pos end) as h_pos, max(case when p.team = k.away then pos end) as a_pos from known k join place p using (match_id) group by k.match_id
),
both_sides as (
  select k.*, case when k.division = 'Primera' then 0 when k.division = 'Segunda' then 1 else -1 end as division_code, 'upcoming' as source_file,
    cast(null as int) as "FTHG", cast(null as int) as "FTAG", cast(null as varchar) as result,
    {", ".join(f"hf.{s} as h_{s}, af.{s} as a_{s}" for s in form.FORM_STATS)}, hc.last_date as h_last_date, ac.last_date as a_last_date, hs.h as h_side_pts, sa.a as a_side_pts,
    ho.pj as h_tpj, ho.pts as h_tpts, ho.gf as h_tgf, ho.ga as h_tga, ao.pj as a_tpj, ao.pts as a_tpts, ao.gf as a_tgf, ao.ga as a_tga,
    coalesce(he.elo, 1500) as h_elo, coalesce(ae.elo, 1500) as a_elo, pos.h_pos, pos.a_pos
  from known k join f hf on hf.team = k.home and hf.cutoff = k.cutoff join f af on af.team = k.away and af.cutoff = k.cutoff
  join c hc on hc.team = k.home and hc.cutoff = k.cutoff join c ac on ac.team = k.away and ac.cutoff = k.cutoff
  join sp hs on hs.team = k.home and hs.cutoff = k.cutoff join sp sa on sa.team = k.away and sa.cutoff = k.cutoff
  left join old ho on ho.team = k.home and ho.cutoff = k.cutoff and ho.division = k.division and ho.season = k.season
  left join old ao on ao.team = k.away and ao.cutoff = k.cutoff and ao.division = k.division and ao.season = k.season
  left join er he on he.team = k.home and he.cutoff = k.cutoff left join er ae on ae.team = k.away and ae.cutoff = k.cutoff
  join pos on pos.match_id = k.match_id
){_FROM_STATE},
mk as ({_MARKET})
select l.match_id, l.num, {_selected()} from l left join po on po.match_id = l.match_id join mk on mk.match_id = l.match_id"""


_TO_COME = "match_id, match_id as num, home, away, match_date, '' as division, '' as season, odd_1, odd_x, odd_2, open_odd_1, open_odd_x, open_odd_2"


def _to_come(matches: DataFrame) -> DataFrame:
    """Matches as a fixture list has them: results, division and season are withheld."""
    return matches.select(
        "match_id", F.col("match_id").alias("num"), "home", "away", "date", F.lit("").alias("division"),
        F.lit("").alias("season"), "odd_1", "odd_x", "odd_2", "open_odd_1", "open_odd_x", "open_odd_2",
    )


@query("J15 P36 P35 W10 W16 W5", _asof_sql(f"select {_TO_COME}, date '{CUTOFF}' as cutoff from m where match_date >= date '{CUTOFF}'"))
def upcoming_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    history = views.matches(spark, sf)
    upcoming = _to_come(history.filter(F.col("date") >= F.lit(CUTOFF).cast("date")))
    return _compared(ft.upcoming_features(upcoming, history, CUTOFF, pool="division"), "match_id", "num")


@query("J15 P36 P37 W10 W16 W5 W6", _asof_sql(f"select {_TO_COME}, cast(date_trunc('month', match_date) as date) as cutoff from m"))
def matchday_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every month is a matchday: all of them at once, each from the history before its first day."""
    history = views.matches(spark, sf)
    upcoming = _to_come(history).withColumn("cutoff", F.trunc("date", "month"))
    return _compared(ft.matchday_features(upcoming, history, ["cutoff"], pool="division"), "match_id", "num")
