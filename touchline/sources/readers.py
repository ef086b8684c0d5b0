"""Readers of every input file kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.text import parse_date, parse_number, repair_mojibake
from touchline.operators.names import resolve_names
from touchline.schemas import MATCHDAY_SCHEMA, NOTES_SCHEMA, PRIORS_SCHEMA, ROSTER_SCHEMA
from touchline.session import stage


def season_from_name(name: Column) -> Column:
    """``SP1_1819.csv`` is 2018-2019; other names give their stem."""
    start = F.regexp_extract(name, r"_(\d{2})(\d{2})\.csv$", 1)
    end = F.regexp_extract(name, r"_(\d{2})(\d{2})\.csv$", 2)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(start != "", F.concat(F.lit("20"), start, F.lit("-20"), end)).otherwise(stem)


def division_from_path(path: Column) -> Column:
    """Division by folder or file prefix, otherwise the folder name in title case."""
    parts = F.split(path, "/")
    folder = F.upper(F.url_decode(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))))
    name = F.upper(F.element_at(parts, -1))
    fallback = F.when(folder == "", "Desconocida").otherwise(F.initcap(F.lower(folder)))
    return (
        F.when((folder == "PRIMERA") | name.startswith("SP1_"), "Primera")
        .when((folder == "SEGUNDA") | name.startswith("SP2_"), "Segunda")
        .otherwise(fallback)
    )


#: One cell of a header line that starts with a comma: quoted, commas included, or up to the next comma.
_HEADER_CELL = r',("(?:[^"]|"")*"|[^,]*)'


def header_names(line: Column) -> Column:
    """Column names of a header line: quotes and byte order mark off, repeated and empty names numbered."""
    bare = F.regexp_replace(F.rtrim(line), "^\ufeff", "")
    cells = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), bare), F.lit(_HEADER_CELL), F.lit(1)),
        lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')),
    )

    def numbered(name: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(cells, F.lit(1), i + 1), lambda c: c == name))
        label = F.when(name == "", F.lit("unnamed")).otherwise(name)
        return F.when((seen == 1) & (name != ""), name).otherwise(F.concat_ws("_", label, seen))

    return F.transform(cells, numbered)


def file_headers(spark: SparkSession, base: str) -> DataFrame:
    """(path, names): the header of every CSV file below ``base``, one short row per file. Blank lines before it do not count."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(base)
        .filter((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        .groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("value").alias("header"))
        .select("path", header_names(F.col("header")).alias("names"))
    )


def read_raw_history(spark: SparkSession, base: str) -> DataFrame:
    """All history rows as strings with file metadata: a single CSV scan of the cells by position, whatever the headers.

    Headers stay rows, one per file, and are joined to the cells by path; what reaches the driver are the distinct column
    names and the width of the widest file. A cell finds its column through the position its own file's header gives; a column
    the file lacks is NULL. Cells beyond the file's header are left out.
    """
    headers = stage(file_headers(spark, base))
    named = headers.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    order = [(r["at"], r["name"]) for r in named.collect()]
    if not order:
        raise FileNotFoundError(f"no CSV files under {base}")
    names = [name for _, name in sorted(order)]
    width = headers.agg(F.max(F.size("names"))).first()[0]
    positions = F.array(*[F.array_position("names", F.lit(n)).cast("int") for n in names])
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    cells = (
        spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(base)
        .select(
            F.array(*[F.col(f"_c{i}") for i in range(width)]).alias("_cells"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("_source_file"),
        )
    )
    rows = cells.join(headers.select("path", F.col("names").alias("_columns"), positions.alias("_at")), "path")
    by_name = F.struct(*[F.get("_cells", F.get("_at", F.lit(i)) - 1).alias(n) for i, n in enumerate(names)])
    # The generator makes columns of their own: inlined into every later expression, the lookups would multiply the plan.
    return rows.select(F.inline(F.array(by_name)), "_source_file", "path", "_columns").select(
        *[F.col(f"`{n}`") for n in names], "_source_file", season_from_name(F.col("_source_file")).alias("_season"),
        division_from_path(F.col("path")).alias("_division"), "_columns",
    )


def read_clean_history(spark: SparkSession, path: str) -> DataFrame:
    """The sanitised history as raw rows again: metadata columns feed the internal ones."""
    raw = spark.read.option("header", "true").csv(path)
    meta = ("source_file", "season", "division")
    names = [c for c in raw.columns if c not in meta]
    return raw.withColumns(
        {"_source_file": F.col("source_file"), "_season": F.col("season"), "_division": F.trim("division"),
         "_columns": F.array(*[F.lit(c) for c in names])}
    )


def _documents(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    """JSON documents, one per file or, with ``lines``, one per line: large sets need not be a file each."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def read_matchdays(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Matchday JSON documents to one row per match."""
    days = _documents(spark, path, MATCHDAY_SCHEMA, lines)
    return days.select("jornada", "source_url", "scraped_at", "cierre", F.inline("partidos"))


def read_roster(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(season, team, target_competition, status) of both competitions."""
    raw = _documents(spark, path, ROSTER_SCHEMA, lines)
    parts = [
        raw.select("season", F.inline(column)).withColumn("target_competition", F.lit(name))
        for column, name in (("laliga_ea_sports", "La Liga"), ("laliga_hypermotion", "Segunda Division"))
    ]
    return parts[0].unionByName(parts[1])


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """(season_target, team, stats) from the priors file."""
    raw = spark.read.schema(PRIORS_SCHEMA).option("multiLine", "true").json(path)
    return raw.select("season_target", F.explode("teams").alias("team", "stats"))


def read_prior_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Teams declared as partial and teams of the missing-data strategy."""
    raw = spark.read.schema(PRIORS_SCHEMA).option("multiLine", "true").json(path)
    return (
        raw.select(F.explode("missing_or_partial").alias("team")),
        raw.select(F.explode("missing_data_strategy.teams").alias("team")),
    )


def low_sample_warning(listed: DataFrame) -> DataFrame:
    """One warning naming the low-sample teams, no row when there are none."""
    joined = F.array_join(F.array_sort(F.collect_set("team")), ", ")
    return listed.agg(F.count(F.lit(1)).alias("n"), joined.alias("teams")).filter("n > 0").select(
        F.concat(F.lit("Equipos con muestra baja en priors 2026/27: "), F.col("teams")).alias("warning")
    )


def read_xg(spark: SparkSession, path: str) -> DataFrame | None:
    """xG rows with canonical names and typed values; None when the optional file is absent."""
    try:
        raw = spark.read.option("header", "true").option("sep", ";").csv(path)
    except AnalysisException:
        return None
    return typed_xg(raw.toDF(*[c.strip() for c in raw.columns]))


def typed_xg(raw: DataFrame) -> DataFrame:
    number = {
        "home_xg": "h_xg", "away_xg": "a_xg", "home_xg_deep": "h_deep", "away_xg_deep": "a_deep",
        "home_ppda": "h_ppda", "away_ppda": "a_ppda",
    }
    typed = raw.select(
        parse_date(F.col("date")).alias("date"), F.col("team_h").alias("home"), F.col("team_a").alias("away"),
        *[parse_number(F.col(source)).alias(name) for name, source in number.items()],
    )
    return resolve_names(typed, ["home", "away"]).dropna(subset=["date", "home", "away", "home_xg", "away_xg"])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Results feed as strings; the CSV reader drops a byte order mark."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files, for encoding facts and fingerprints."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_notes(spark: SparkSession, jornada: int, candidates: Sequence[str]) -> DataFrame:
    """Analyst notes of the first existing candidate file."""
    for path in candidates:
        try:
            raw = spark.read.schema(NOTES_SCHEMA).option("multiLine", "true").json(path)
        except AnalysisException:
            continue
        return raw.select(F.inline("maestra")).select(
            F.lit(jornada).alias("jornada"), F.col("p").alias("num"),
            repair_mojibake(F.col("s")).alias("signo"), repair_mojibake(F.col("r")).alias("razon"),
        )
    return spark.createDataFrame([], "jornada int, num int, signo string, razon string")
