"""Match tables derived from the driver's star schema, in Spark and as the same SQL for the oracle.

Every order becomes a match: goals and shots come from its lines, teams from its customer, odds and
source probabilities from its keys. Whole tables are used; the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import ship_package

# One text, two engines: only constructs both dialects read the same way.
MATCHES_SQL = """
select match_id, match_date, division, home, away, fthg, ftag, season, result,
  cast(case when match_id % 29 = 0 then null else (hq % 17) end as double) as hs,
  cast((aq % 13) as double) as "as",
  cast(case when match_id % 31 = 0 then null else (hq % 7) end as double) as hst,
  cast((aq % 6) as double) as ast,
  cast(case when match_id % 23 = 0 then null else (hq % 30) / 10.0 end as double) as home_xg,
  cast((aq % 25) / 10.0 as double) as away_xg,
  cast(case when match_id % 37 = 0 then null when match_id % 41 = 0 then 0 else 1.2 + (match_id * 7 % 50) / 10.0 end as double) as odd_1,
  cast(2.5 + (match_id * 11 % 30) / 10.0 as double) as odd_x,
  cast(case when match_id % 43 = 0 then null else 1.3 + (match_id * 13 % 60) / 10.0 end as double) as odd_2,
  cast(1.2 + (match_id * 5 % 50) / 10.0 as double) as open_odd_1,
  cast(case when match_id % 47 = 0 then null else 2.4 + (match_id * 3 % 30) / 10.0 end as double) as open_odd_x,
  cast(1.3 + (match_id * 17 % 60) / 10.0 as double) as open_odd_2,
  cust, price_cents
from (
  select o.o_orderkey as match_id, cast(o.o_orderdate as date) as match_date,
    case when o.o_orderkey % 2 = 0 then 'Primera' else 'Segunda' end as division,
    concat(case when o.o_orderkey % 2 = 0 then 'P' else 'S' end, lpad(cast(o.o_custkey % 20 as varchar(10)), 2, '0')) as home,
    concat(case when o.o_orderkey % 2 = 0 then 'P' else 'S' end,
           lpad(cast((o.o_custkey % 20 + 1 + o.o_orderkey % 19) % 20 as varchar(10)), 2, '0')) as away,
    cast(coalesce(li.hq, 0) % 5 as int) as fthg, cast(coalesce(li.aq, 0) % 4 as int) as ftag,
    coalesce(li.hq, 0) as hq, coalesce(li.aq, 0) as aq,
    case when month(o.o_orderdate) >= 7
      then concat(cast(year(o.o_orderdate) as varchar(4)), '-', cast(year(o.o_orderdate) + 1 as varchar(4)))
      else concat(cast(year(o.o_orderdate) - 1 as varchar(4)), '-', cast(year(o.o_orderdate) as varchar(4))) end as season,
    case when coalesce(li.hq, 0) % 5 > coalesce(li.aq, 0) % 4 then '1'
         when coalesce(li.hq, 0) % 5 < coalesce(li.aq, 0) % 4 then '2' else 'X' end as result,
    o.o_custkey as cust, cast(round(o.o_totalprice * 100) as bigint) as price_cents
  from orders o left join (
    select l_orderkey,
      cast(sum(case when l_linenumber % 2 = 1 then cast(l_quantity as bigint) else 0 end) as bigint) as hq,
      cast(sum(case when l_linenumber % 2 = 0 then cast(l_quantity as bigint) else 0 end) as bigint) as aq
    from lineitem group by l_orderkey) li on li.l_orderkey = o.o_orderkey) base
"""

# Countries of a hundred customers each: their number grows with the tables, their leagues share teams, others do not.
COUNTRIES_SQL = """
select m.*, concat('C', cast((cust - cust % 100) / 100 as int)) as country,
  concat('C', cast((cust - cust % 100) / 100 as int), ' ', substr(division, 1, 1)) as league,
  concat('C', cast((cust - cust % 100) / 100 as int), ' ', substr(home, 2)) as home_team,
  concat('C', cast((cust - cust % 100) / 100 as int), ' ', substr(away, 2)) as away_team
from ({matches}) m
""".replace("{matches}", MATCHES_SQL)

# Source probabilities of a match: integer weights with many ties, normalised.
SOURCES_SQL = """
select m.*,
  w1 / (w1 + wx + w2) as logit_prob_1, wx / (w1 + wx + w2) as logit_prob_x, w2 / (w1 + wx + w2) as logit_prob_2,
  v1 / (v1 + vx + v2) as hgb_prob_1, vx / (v1 + vx + v2) as hgb_prob_x, v2 / (v1 + vx + v2) as hgb_prob_2,
  case when match_id % 53 = 0 then null else u1 / (u1 + ux + u2) end as market_1,
  case when match_id % 53 = 0 then null else ux / (u1 + ux + u2) end as market_x,
  case when match_id % 53 = 0 then null else u2 / (u1 + ux + u2) end as market_2,
  case when match_id % 59 = 0 then null else t1 / (t1 + tx + t2) end as poisson_1,
  case when match_id % 59 = 0 then null else tx / (t1 + tx + t2) end as poisson_x,
  case when match_id % 59 = 0 then null else t2 / (t1 + tx + t2) end as poisson_2
from (select m.*,
    cast(cust % 7 + 1 as double) as w1, cast(match_id % 5 + 1 as double) as wx, cast((cust + match_id) % 6 + 1 as double) as w2,
    cast(price_cents % 8 + 1 as double) as v1, cast(match_id % 4 + 1 as double) as vx, cast(cust % 6 + 1 as double) as v2,
    cast(fthg + match_id % 3 + 2 as double) as u1, cast(cust % 3 + 1 as double) as ux, cast(ftag + price_cents % 3 + 1 as double) as u2,
    cast(price_cents % 5 + 1 as double) as t1, cast(cust % 4 + 1 as double) as tx, cast((price_cents + cust) % 5 + 1 as double) as t2
  from ({matches}) m) m
""".replace("{matches}", MATCHES_SQL)

# Raw history rows: everything a string, with the gaps and errors real files have.
RAW_SQL = """
select match_id as _line,
  concat(case when division = 'Primera' then 'SP1_' else 'SP2_' end, substr(season, 3, 2), substr(season, 8, 2), '.csv') as _source_file,
  division as _division, season as _season,
  case when is_empty then '' when match_id % 101 = 0 then 'no-es-fecha'
       when match_id % 4 = 0 then concat(dd, '/', mm, '/', yyyy)
       when match_id % 4 = 1 then concat(dd, '/', mm, '/', substr(yyyy, 3, 2))
       when match_id % 4 = 2 then concat(yyyy, '-', mm, '-', dd)
       else concat(cast(cast(dd as int) as varchar(2)), '-', cast(cast(mm as int) as varchar(2)), '-', yyyy) end as "Date",
  case when is_empty then '' when match_id % 97 = 0 then ' Leonesa ' else concat(' ', home) end as "HomeTeam",
  case when is_empty then '' else away end as "AwayTeam",
  case when is_empty then '' else cast(fthg as varchar(5)) end as "FTHG",
  case when is_empty then '' when match_id % 89 = 0 then '' else cast(ftag as varchar(5)) end as "FTAG",
  case when is_empty then '' when match_id % 83 = 0 then 'A' when match_id % 79 = 0 then '?'
       when result = '1' then 'H' when result = 'X' then 'd ' else 'A' end as "FTR",
  case when old then null when is_empty or is_admin then '' when match_id % 29 = 0 then '' else cast(cast(hs as int) as varchar(5)) end as "HS",
  case when old then null when is_empty or is_admin then '' else cast(cast("as" as int) as varchar(5)) end as "AS",
  case when old then null when is_empty or is_admin then '' else cast(cast(ast as int) as varchar(5)) end as "HST",
  case when old then null when is_empty or is_admin then '' else '4' end as "AST",
  case when is_empty or is_admin then '' else cast(match_id % 9 as varchar(5)) end as "HC",
  case when is_empty or is_admin or match_id % 71 = 0 then ''
       else concat(cast(1 + match_id % 6 as varchar(5)), case when match_id % 5 = 0 then ',' else '.' end, cast(10 + match_id % 80 as varchar(5))) end as "B365H",
  case when is_empty or is_admin then '' when match_id % 67 = 0 then '1.01' else concat(cast(2 + match_id % 3 as varchar(5)), '.5') end as "B365D",
  case when is_empty or is_admin then '' else concat(cast(2 + match_id % 5 as varchar(5)), '.25') end as "B365A",
  case when old then null when is_empty or is_admin or match_id % 3 = 0 then '' else concat(cast(1 + match_id % 6 as varchar(5)), '.', cast(10 + match_id % 80 as varchar(5))) end as "B365CH",
  case when old then null when is_empty or is_admin then '' else concat(cast(2 + match_id % 3 as varchar(5)), '.5') end as "B365CD",
  case when old then null when is_empty or is_admin then '' when match_id % 61 = 0 then '9' else concat(cast(2 + match_id % 5 as varchar(5)), '.25') end as "B365CA",
  old
from (select m.*, match_id % 113 = 0 as is_empty, match_id % 109 = 0 as is_admin, season < '1997' as old,
    lpad(cast(day(match_date) as varchar(2)), 2, '0') as dd, lpad(cast(month(match_date) as varchar(2)), 2, '0') as mm,
    cast(year(match_date) as varchar(4)) as yyyy from ({matches}) m) r
""".replace("{matches}", MATCHES_SQL)

_OLD_COLUMNS = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HC", "B365H", "B365D", "B365A"]
_NEW_COLUMNS = [*_OLD_COLUMNS, "HS", "AS", "HST", "AST", "B365CH", "B365CD", "B365CA"]

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name in ("orders", "lineitem"):
        text = text.replace(f"from {name} ", f"from {{{name}}} ")
    return spark.sql(
        text.replace('"', "`"),
        orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"),
    )


def _match_names(df: DataFrame) -> DataFrame:
    renamed = {
        "match_date": "date", "fthg": "FTHG", "ftag": "FTAG", "hs": "HS", "as": "AS", "hst": "HST", "ast": "AST",
    }
    return df.withColumnsRenamed(renamed)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed match table."""
    df = _match_names(_spark_sql(spark, sf_dir, MATCHES_SQL))
    return df.withColumns(
        {
            "division_code": F.when(F.col("division") == "Primera", 0).otherwise(1),
            "source_file": F.lit("orders"),
        }
    )


def country_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of many countries with two leagues each."""
    df = _match_names(_spark_sql(spark, sf_dir, COUNTRIES_SQL)).drop("division", "home", "away")
    return df.withColumnsRenamed({"league": "division", "home_team": "home", "away_team": "away"})


def matches_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with four sources of outcome probabilities."""
    return _match_names(_spark_sql(spark, sf_dir, SOURCES_SQL))


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string raw rows in which older seasons lack shot and closing columns."""
    df = _spark_sql(spark, sf_dir, RAW_SQL)
    # A function over an array is no part of fused code: without it these projections make one method too long for the JVM to compile.
    header = F.filter(F.array(*[F.lit(c) for c in _NEW_COLUMNS]), lambda c: ~F.col("old") | c.isin(*_OLD_COLUMNS))
    return df.withColumn("_columns", header).drop("old")
