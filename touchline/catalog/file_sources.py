"""Queries that read files: the derived rows are written in the format of a source, and its reader reads them back.

The files hold every derived row, so their number and size grow with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog import pools, raw_data, views
from touchline.catalog.registry import query, r6
from touchline.operators import cleaning
from touchline.session import shared_folder, stage
from touchline.sources import readers, writers


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def history_files(spark: SparkSession, sf: str) -> str:
    """A folder of CSV files named like published ones: PRIMERA/SP1_<part>_<season>.csv, two kinds of headers."""
    # The rows are derived once and not once for each kind of header.
    raw = stage(views.raw_history(spark, sf).withColumn("old", F.size("_columns") == len(views._OLD_COLUMNS)).drop("_columns"))
    base = new_folder(spark)
    old = F.col("old")
    kinds = ((views._OLD_COLUMNS, old), (views._NEW_COLUMNS[::-1], ~old))  # the second header runs the other way round
    for i, (columns, which) in enumerate(kinds):
        (
            raw.filter(which).select(*columns, F.upper("_division").alias("folder"), F.substring_index("_source_file", ".", 1).alias("name"))
            .write.partitionBy("folder", "name").option("header", "true").option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false").csv(f"{base}/written-{i}")
        )
    return name_files(spark, base)


def name_files(spark: SparkSession, base: str) -> str:
    """Spark names its files itself; they are renamed, not copied, to the names the source has."""
    files, at = writers._located(spark, base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for i, f in enumerate(files.globStatus(path(f"{base}/written-*/folder=*/name=*/part-*.csv"))):
        where = f.getPath()
        league, _, season = where.getParent().getName().removeprefix("name=").partition("_")
        folder = path(f"{base}/history/" + where.getParent().getParent().getName().removeprefix("folder="))
        files.mkdirs(folder)
        if not files.rename(where, path(folder, f"{league}_{i:05d}_{season}.csv")):
            raise OSError(f"not renamed: {where}")
    return f"{base}/history"


# A file name gives the season two digits a year, and the reader takes them as years after 2000. Empty cells read as NULL.
_SEASON = "concat('20', substr(_season, 3, 2), '-20', substr(_season, 8, 2))"
_CELLS = {c: f"{c.lower()}_cell" for c in views._NEW_COLUMNS}


@query("SRC2 SRC3 SRC4 SRC5 U1", f"""
select _division as division, {_SEASON} as season, {', '.join(f"""nullif("{c}", '') as {a}""" for c, a in _CELLS.items())},
  cast(case when old then {len(views._OLD_COLUMNS)} else {len(views._NEW_COLUMNS)} end as int) as header_columns from ({views.RAW_SQL}) r""")
def history_from_files(spark: SparkSession, sf: str) -> DataFrame:
    raw = readers.read_raw_history(spark, history_files(spark, sf))
    return raw.select(
        F.col("_division").alias("division"), F.col("_season").alias("season"), *[F.col(c).alias(a) for c, a in _CELLS.items()],
        F.size("_columns").alias("header_columns"),
    )


@query("SRC1 SRC3 SRC4 SRC5 SRC6 P1 P2 P3 P5 P6 P7 U1", raw_data.FACTS + f"""
select d as date, ht as home, at_ as away, cast(hg as int) as fthg, cast(ag as int) as ftag, res as result, round(e1, 6) as odd_1, round(ex, 6) as odd_x,
  round(e2, 6) as odd_2, round(o1, 6) as open_odd_1, round(ox, 6) as open_odd_x, round(o2, 6) as open_odd_2, _division as division, {_SEASON} as season
from x where d is not null and hg is not null and ag is not null and res is not null and ovr is not null and has_open""")
def typed_history_from_files(spark: SparkSession, sf: str) -> DataFrame:
    typed = cleaning.require_known_divisions(cleaning.typed_matches(readers.read_raw_history(spark, history_files(spark, sf))))
    return typed.select(
        "date", "home", "away", F.col("FTHG").alias("fthg"), F.col("FTAG").alias("ftag"), "result",
        *[r6(c) for c in ("odd_1", "odd_x", "odd_2", "open_odd_1", "open_odd_x", "open_odd_2")], "division", "season",
    )


def published(spark: SparkSession, sf: str) -> dict[str, str]:
    """The four outputs of a sanitising run over the files."""
    rows = cleaning.sanitise(readers.read_raw_history(spark, history_files(spark, sf)))
    return writers.write_sanitised(rows, new_folder(spark))


@query("SNK1 SNK2 SRC6 P20", raw_data.FACTS + f"""
select case when reason is null then 'historico_saneado' else 'excluidos' end as output, _division as division, {_SEASON} as season,
  coalesce(reason, '') as motivo_exclusion, case when ht = 'Leonesa' then 'Cultural Leonesa' else trim("HomeTeam") end as home_team, at_ as away_team,
  trim("Date") as date_cell, coalesce(case when reason is null then cast(has_real as varchar) end, '') as tiene_cierre_real,
  case when reason is null then round(ovr, 6) end as overround,
  concat_ws('|', case when ht = 'Leonesa' then 'ALIAS_APPLIED:Leonesa->Cultural Leonesa' end, case when reason is not null then concat('EXCLUDED:', reason) end,
    case when reason is null and not has_real then 'MARKET_MOVE_AS_NAN_NO_REAL_CLOSE' end,
    case when reason is null and (ovr < 1.0 or ovr > 1.4) then 'ODDS_OVERROUND_OUT_OF_RANGE' end,
    case when reason is null and old then 'SHOTS_SCHEMA_MISSING' when reason is null and not shots_ok then 'SHOTS_VALUES_INCOMPLETE' end) as transformaciones
from x""")
def published_history(spark: SparkSession, sf: str) -> DataFrame:
    out = published(spark, sf)
    parts = [
        readers.read_clean_history(spark, out[name]).select(
            F.lit(name).alias("output"), "division", "season", F.coalesce("motivo_exclusion", F.lit("")).alias("motivo_exclusion"),
            *[F.coalesce(c, F.lit("")).alias(a) for c, a in (("HomeTeam", "home_team"), ("AwayTeam", "away_team"), ("Date", "date_cell"))],
            F.coalesce("tiene_cierre_real", F.lit("")).alias("tiene_cierre_real"), F.round(F.col("overround").cast("double"), 6).alias("overround"),
            F.coalesce("transformaciones", F.lit("")).alias("transformaciones"),
        )
        for name in writers.SANITISE_OUTPUTS[:2]
    ]
    return parts[0].unionByName(parts[1])


@query("SNK4 A4", raw_data.FACTS + """
select count(*) as input_rows, count(*) filter (where reason is null) as output_rows, count(reason) as excluded_rows,
  count(*) filter (where reason = 'EMPTY_ROW') as empty_rows, count(*) filter (where reason = 'ADMINISTRATIVE_CANDIDATE') as administrative_rows,
  count(*) filter (where reason = 'MISSING_REQUIRED_ODDS') as rows_without_odds, cast(1 as bigint) as schema_version, true as read_only_originals from x""")
def published_manifest(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"EMPTY_ROW": "empty_rows", "ADMINISTRATIVE_CANDIDATE": "administrative_rows", "MISSING_REQUIRED_ODDS": "rows_without_odds"}
    schema = ("schema_version long, read_only_originals boolean, input_rows long, output_rows long, excluded_rows long, "
              "exclusion_reasons map<string,long>")
    read = spark.read.schema(schema).json(published(spark, sf)["manifiesto"])
    counts = [F.coalesce(F.col("exclusion_reasons")[code], F.lit(0).cast("long")).alias(name) for code, name in kinds.items()]
    return read.select("input_rows", "output_rows", "excluded_rows", *counts, "schema_version", "read_only_originals")


@query("SRC10", f"""
select date, home, away, home_xg, away_xg, home_xg_deep, away_xg_deep, home_ppda, away_ppda from ({raw_data.XG_SQL}) z where match_id % 10 <> 3""")
def xg_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Semicolons between cells, days before months, a blank xG in each tenth row: such rows are dropped."""
    shifted = views._spark_sql(spark, sf, raw_data.XG_SQL.replace(
        "cast(match_date + cast(match_id % 5 as int) as date)", "date_add(match_date, cast(match_id % 5 as int))"))
    path = new_folder(spark)
    shifted.select(
        F.date_format("date", "dd/MM/yyyy").alias("date"), F.col("home").alias("team_h"), F.col("away").alias("team_a"),
        F.when(F.col("match_id") % 10 != 3, F.col("home_xg")).alias("h_xg"), F.col("away_xg").alias("a_xg"),
        F.col("home_xg_deep").alias("h_deep"), F.col("away_xg_deep").alias("a_deep"),
        F.col("home_ppda").alias("h_ppda"), F.col("away_ppda").alias("a_ppda"),
    ).write.option("header", "true").option("sep", ";").csv(path)
    return readers.read_xg(spark, path)


@query("SRC7", pools.PCT + """
select jornada, num, local, visitante, cast(match_date as varchar) as fecha, a1 as apu_1, ax as apu_x, a2 as apu_2, l1 as lae_1, lx as lae_x, l2 as lae_2,
  q1 as q15_1, qx as q15_x, q2 as q15_2 from pc""")
def matchdays_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """A document of at most fifteen matches per matchday, a line each."""
    path = new_folder(spark)
    fields = ["num", "local", "visitante", "q15", "lae", "apu", "fecha"]
    pools.matchdays(spark, sf).groupBy("jornada").agg(F.collect_list(F.struct(*fields)).alias("partidos")).write.json(path)
    rows = readers.read_matchdays(spark, path, lines=True)
    signs = [F.col(s)[sign].alias(f"{s}_{sign.lower()}") for s in ("apu", "lae", "q15") for sign in ("1", "X", "2")]
    return rows.select("jornada", "num", "local", "visitante", "fecha", *signs)


@query("SRC8", raw_data._CONTEXT + "select '2026/27' as season, team, target as target_competition, status from ro")
def roster_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by leading letters of the teams, both competitions in each."""
    path = new_folder(spark)
    listed = [
        F.collect_list(F.when(F.col("target_competition") == name, F.struct("team", "status"))).alias(column)
        for column, name in (("laliga_ea_sports", "La Liga"), ("laliga_hypermotion", "Segunda Division"))
    ]
    documents = raw_data._roster(spark, sf).groupBy(F.substring("team", 1, 2).alias("letters")).agg(*listed)
    documents.select(F.lit("2026/27").alias("season"), "laliga_ea_sports", "laliga_hypermotion").write.json(path)
    return readers.read_roster(spark, path, lines=True)
