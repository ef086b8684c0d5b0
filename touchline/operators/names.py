"""Team names: alias tables, resolution and alias candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.text import fold_key, fold_name, fold_words, is_reserve_name

# Name in the historical files and its common spellings.
HISTORY_NAMES: dict[str, tuple[str, ...]] = {
    "Ath Bilbao": ("Athletic Club", "Athletic Bilbao", "Athletic de Bilbao"),
    "Ath Bilbao B": ("Bilbao Athletic", "Athletic Club B", "Athletic B"),
    "Ath Madrid": ("Atletico de Madrid", "Atletico Madrid", "Atletico"),
    "Barcelona": ("FC Barcelona", "Barca"),
    "Barcelona B": ("FC Barcelona B", "Barça B"),
    "Betis": ("Real Betis", "Real Betis Balompie"),
    "Alaves": ("Deportivo Alaves", "CD Alaves"),
    "Albacete": ("Albacete BP", "Albacete Balompie"),
    "Alcorcon": ("AD Alcorcon",),
    "Alcoyano": ("CD Alcoyano",),
    "Almeria": ("UD Almeria",),
    "Amorebieta": ("SD Amorebieta",),
    "Andorra": ("FC Andorra", "CF Andorra"),
    "Burgos": ("Burgos CF",),
    "Cadiz": ("Cadiz CF",),
    "Cartagena": ("FC Cartagena", "Cartagena FC"),
    "Castellon": ("CD Castellon",),
    "Celta": ("RC Celta", "Celta de Vigo", "Celta Vigo", "RC Celta de Vigo", "Real Club Celta"),
    "Ceuta": ("AD Ceuta FC", "AD Ceuta"),
    "Cordoba": ("Cordoba CF",),
    "Cultural Leonesa": ("Cultural y Deportiva Leonesa", "Leonesa"),
    "Eibar": ("SD Eibar",),
    "Elche": ("Elche CF",),
    "Eldense": ("CD Eldense",),
    "Espanol": ("RCD Espanyol", "Espanyol", "RCD Espanyol de Barcelona", "RCD Español"),
    "Extremadura UD": ("Extremadura",),
    "Ferrol": ("Racing Ferrol", "Racing de Ferrol", "Racing Club de Ferrol", "Racing Club Ferrol"),
    "Fuenlabrada": ("CF Fuenlabrada",),
    "Getafe": ("Getafe CF",),
    "Gimnastic": ("Gimnastic de Tarragona", "Nastic", "Nastic de Tarragona"),
    "Girona": ("Girona FC",),
    "Granada": ("Granada CF",),
    "Guadalajara": ("CD Guadalajara",),
    "Hercules": ("Hercules CF",),
    "Huesca": ("SD Huesca",),
    "Ibiza": ("UD Ibiza",),
    "Jaen": ("Real Jaen", "Real Jaen CF"),
    "La Coruna": ("Deportivo La Coruna", "Deportivo de La Coruna", "RC Deportivo",
                  "RC Deportivo de La Coruna", "RC Deportivo La Coruna", "Deportivo", "Depor"),
    "Las Palmas": ("UD Las Palmas",),
    "Leganes": ("CD Leganes",),
    "Levante": ("Levante UD",),
    "Llagostera": ("UE Llagostera",),
    "Logrones": ("UD Logrones",),
    "Lorca": ("Lorca FC",),
    "Lugo": ("CD Lugo",),
    "Malaga": ("Malaga CF",),
    "Mallorca": ("RCD Mallorca", "Real Mallorca"),
    "Mirandes": ("CD Mirandes",),
    "Murcia": ("Real Murcia",),
    "Numancia": ("CD Numancia",),
    "Osasuna": ("CA Osasuna", "Club Atletico Osasuna", "Atlético Osasuna"),
    "Oviedo": ("Real Oviedo",),
    "Ponferradina": ("SD Ponferradina",),
    "Rayo Majadahonda": ("CF Rayo Majadahonda",),
    "Real Madrid": ("Real Madrid CF",),
    "Real Madrid B": ("Castilla", "Real Madrid Castilla", "Real Madrid Castilla CF"),
    "Recreativo": ("Recreativo de Huelva", "RC Recreativo de Huelva", "Recre"),
    "Reus Deportiu": ("CF Reus Deportiu", "CF Reus", "Reus"),
    "Sabadell": ("CE Sabadell", "CE Sabadell FC"),
    "Salamanca": ("UD Salamanca",),
    "Santander": ("Racing Santander", "Racing de Santander", "RC Racing", "R. Racing Club",
                  "RC Racing de Santander", "Real Racing Club", "Racing Club"),
    "Sevilla": ("Sevilla FC",),
    "Sevilla B": ("Sevilla Atletico", "Sevilla At"),
    "Sociedad": ("Real Sociedad", "Real Sociedad de Futbol"),
    "Sociedad B": ("Real Sociedad B", "R. Sociedad B", "Sanse"),
    "Sp Gijon": ("Sporting Gijon", "Sporting de Gijon", "Real Sporting", "Real Sporting de Gijon", "Sporting"),
    "Tenerife": ("CD Tenerife",),
    "UCAM Murcia": ("UCAM",),
    "Valencia": ("Valencia CF",),
    "Valladolid": ("Real Valladolid", "Real Valladolid CF"),
    "Vallecano": ("Rayo Vallecano", "Rayo"),
    "Villarreal": ("Villarreal CF",),
    "Villarreal B": ("Villarreal CF B",),
    "Xerez": ("Xerez CD",),
    "Zaragoza": ("Real Zaragoza", "Zaragoza CF"),
}

# Official name of a 2026/27 team and its names in the results feed.
ROSTER_NAMES: dict[str, tuple[str, ...]] = {
    "Athletic Club": ("Athletic Club",),
    "Atletico de Madrid": ("Atlético Madrid", "Atletico Madrid"),
    "CA Osasuna": ("Osasuna",),
    "Deportivo Alaves": ("Alavés", "Alaves"),
    "Elche CF": ("Elche",),
    "FC Barcelona": ("Barcelona",),
    "Getafe CF": ("Getafe",),
    "Levante UD": ("Levante",),
    "Malaga CF": ("Malaga", "Málaga"),
    "R. Racing Club": ("Racing Santander",),
    "Rayo Vallecano": ("Rayo Vallecano",),
    "RC Celta": ("Celta de Vigo",),
    "RC Deportivo": ("Deportivo La Coruña", "Deportivo La Coruna"),
    "RCD Espanyol de Barcelona": ("Espanyol",),
    "Real Betis": ("Real Betis",),
    "Real Madrid": ("Real Madrid",),
    "Real Sociedad": ("Real Sociedad",),
    "Sevilla FC": ("Sevilla FC",),
    "Valencia CF": ("Valencia",),
    "Villarreal CF": ("Villarreal",),
    "AD Ceuta FC": ("AD Ceuta FC",),
    "Albacete BP": ("Albacete",),
    "Burgos CF": ("Burgos",),
    "Cadiz CF": ("Cadiz", "Cádiz"),
    "CD Castellon": ("Castellón", "Castellon"),
    "CD Eldense": ("Eldense",),
    "CD Leganes": ("Leganes", "Leganés"),
    "CD Tenerife": ("Tenerife",),
    "CE Sabadell": ("Sabadell",),
    "Cordoba CF": ("Cordoba", "Córdoba"),
    "FC Andorra": ("FC Andorra",),
    "Girona FC": ("Girona",),
    "Granada CF": ("Granada CF",),
    "R. Sociedad B": ("Real Sociedad B",),
    "RC Celta Fortuna": ("Celta Fortuna",),
    "RCD Mallorca": ("Mallorca",),
    "Real Oviedo": ("Oviedo",),
    "Real Sporting": ("Sporting Gijón", "Sporting Gijon"),
    "Real Valladolid CF": ("Valladolid",),
    "SD Eibar": ("Eibar",),
    "UD Almeria": ("Almería", "Almeria"),
    "UD Las Palmas": ("Las Palmas",),
}

# Historical name to the name of the results feed.
FEED_NAMES: dict[str, str] = {
    "Alaves": "Alaves", "Almeria": "Almeria", "Andorra": "FC Andorra", "Ath Bilbao": "Athletic Club",
    "Ath Madrid": "Atletico Madrid", "Betis": "Real Betis", "Castellon": "Castellon",
    "Celta": "Celta de Vigo", "Ceuta": "AD Ceuta FC", "Espanol": "Espanyol", "Granada": "Granada CF",
    "La Coruna": "Deportivo La Coruna", "Santander": "Racing Santander", "Sevilla": "Sevilla FC",
    "Sociedad": "Real Sociedad", "Sociedad B": "Real Sociedad B", "Sp Gijon": "Sporting Gijon",
    "Vallecano": "Rayo Vallecano",
}

# Words a club name may add or drop.
CLUB_WORDS = (
    "athletic", "atletico", "club", "cultural", "deportivo", "fc", "cf", "cd", "rc", "rcd", "real", "ud",
)
SIMILARITY = 0.88
BROADCAST_LIMIT = 20_000


def alias_table(
    spark: SparkSession, names: Mapping[str, Sequence[str]] = HISTORY_NAMES, own_name: bool = True
) -> DataFrame:
    """(key, canonical) from an alias mapping held as job settings."""
    pairs = [
        (canonical, alias)
        for canonical, aliases in names.items()
        for alias in ([canonical] if own_name else []) + list(aliases)
    ]
    table = spark.createDataFrame(pairs, "canonical string, alias string")
    return checked_aliases(table.select(fold_name(F.col("alias")).alias("key"), "canonical"))


def alias_collisions(pairs: DataFrame) -> DataFrame:
    """Keys that name two teams."""
    return (
        pairs.filter(F.col("key") != "").groupBy("key")
        .agg(F.count_distinct("canonical").alias("teams"), F.min("canonical").alias("first"),
             F.max("canonical").alias("last"))
        .filter(F.col("teams") > 1)
    )


def checked_aliases(pairs: DataFrame) -> DataFrame:
    """One row per key; a key that names two teams fails the job."""
    grouped = pairs.filter(F.col("key") != "").groupBy("key").agg(
        F.min("canonical").alias("canonical"), F.max("canonical").alias("_other")
    )
    clash = F.concat(F.lit("alias of two teams: "), F.col("key"))
    checked = F.when(F.col("canonical") == F.col("_other"), F.col("canonical")).otherwise(F.raise_error(clash))
    return grouped.select("key", checked.alias("canonical"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_LIMIT else table


def resolve_names(
    df: DataFrame, columns: Sequence[str], names: Mapping[str, Sequence[str]] | None = None,
    keep_unknown: bool = True,
) -> DataFrame:
    """Replace each column by its canonical name; unknown names pass trimmed, or become NULL."""
    names = HISTORY_NAMES if names is None else names
    table = alias_table(df.sparkSession, names)
    size = sum(len(v) + 1 for v in names.values())
    return resolve_with(df, columns, _small(table, size), keep_unknown)


def resolve_with(
    df: DataFrame, columns: Sequence[str], table: DataFrame, keep_unknown: bool = True
) -> DataFrame:
    """As ``resolve_names`` with an alias table (key, canonical)."""
    out = df
    for column in columns:
        keyed = table.select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
        out = out.withColumn("_key", fold_name(F.trim(F.col(column)))).join(keyed, "_key", "left")
        fallback = F.trim(F.col(column)) if keep_unknown else F.lit(None).cast("string")
        out = out.withColumn(column, F.coalesce(F.col("_canonical"), fallback)).drop("_key", "_canonical")
    return out.select(*df.columns)


def map_exact(column: Column, mapping: Mapping[str, str]) -> Column:
    """Literal lookup for a handful of fixed names; other values pass."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(table[column], column)


def feed_key(name: Column) -> Column:
    """Comparison key of a historical name in the results feed."""
    return fold_key(map_exact(F.trim(name), FEED_NAMES))


# ---------------------------------------------------------------------------
# Alias candidates
# ---------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


#: Edits up to which a pair has to share two segments of its names; beyond, one longer segment.
TWO_SEGMENTS = 4


def _allowed(both: Column) -> Column:
    """Most characters two names of ``both`` characters together may leave unmatched at the wanted ratio.

    A ratio of 2 M / T leaves T - 2 M characters, a number of the parity of T.
    """
    most = F.floor((1 - SIMILARITY) * both + 1e-9)
    return (most - (both - most) % 2).cast("int")


def _shown() -> Column:
    """``i, j``: every choice of two of the ``k`` segments, or of one, named twice.

    With at most d edits, d + 2 segments leave two untouched and d + 1 leave one.
    """
    one = F.sequence(F.lit(0), F.col("k") - 1)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 2), lambda i: F.transform(F.sequence(i + 1, F.col("k") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    single = F.transform(one, lambda i: F.struct(i.alias("i"), i.alias("j")))
    return F.inline(F.when(F.col("d") <= TWO_SEGMENTS, two).otherwise(single))


def _start(i: Column, n: Column, k: Column) -> Column:
    return F.floor(i * n / k).cast("int")


def _banded(names: DataFrame, shorter: bool) -> DataFrame:
    """Each name with every partner length of the other side: ``team, folded, n (shorter), m (longer), d, k``."""
    own, wide = F.length("folded"), (2 - SIMILARITY) / SIMILARITY
    if shorter:
        lengths = names.select("team", "folded", own.alias("n")).withColumn("m", F.explode(F.sequence(F.col("n"), F.floor(F.col("n") * wide + 1e-9).cast("int"))))
    else:
        lengths = names.select("team", "folded", own.alias("m")).withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") / wide - 1e-9).cast("int"), F.col("m"))))
    out = lengths.withColumn("d", _allowed(F.col("n") + F.col("m"))).filter(F.col("d") >= F.col("m") - F.col("n"))
    return out.withColumn("k", F.col("d") + F.when(F.col("d") <= TWO_SEGMENTS, 2).otherwise(1))


def name_signatures(names: DataFrame) -> DataFrame:
    """``team, folded, signature``: the shorter side of a pair, cut into segments for every length of a longer partner."""
    i, j, n, k = F.col("i"), F.col("j"), F.col("n"), F.col("k")
    cut = _banded(names, True).select("team", "folded", "n", "m", "k", _shown())
    part = lambda x: F.substring("folded", _start(x, n, k) + 1, _start(x + 1, n, k) - _start(x, n, k))
    return cut.select("team", "folded", F.struct("n", "m", "i", "j", part(i).alias("a"), part(j).alias("b")).alias("signature"))


def name_probes(names: DataFrame) -> DataFrame:
    """``team, folded, signature``: the longer side, read wherever edits may have shifted the segments of a shorter partner."""
    i, j, n, k, d, gap = F.col("i"), F.col("j"), F.col("n"), F.col("k"), F.col("d"), F.col("m") - F.col("n")
    cut = _banded(names, False).select("team", "folded", "n", "m", "d", "k", _shown())
    low, high = -F.floor((d - gap) / 2).cast("int"), F.floor((d + gap) / 2).cast("int")
    shifted = cut.withColumn("u", F.explode(F.sequence(low, high)))
    shifted = shifted.withColumn("v", F.explode(F.when(i == j, F.array("u")).otherwise(F.sequence(low, high))))
    # The edits before, between and after the two segments make up their shifts and the gap in length.
    shifted = shifted.filter(F.abs("u") + F.abs(F.col("v") - F.col("u")) + F.abs(gap - F.col("v")) <= d)
    at, size = lambda x, by: _start(x, n, k) + by, lambda x: _start(x + 1, n, k) - _start(x, n, k)
    inside = lambda x, by: (at(x, by) >= 0) & (at(x, by) + size(x) <= F.col("m"))
    shifted = shifted.filter(inside(i, F.col("u")) & inside(j, F.col("v")))
    part = lambda x, by: F.substring("folded", at(x, by) + 1, size(x))
    signature = F.struct("n", "m", "i", "j", part(i, F.col("u")).alias("a"), part(j, F.col("v")).alias("b")).alias("signature")
    return shifted.select("team", "folded", signature).distinct()


def name_candidates(names: DataFrame) -> DataFrame:
    """``l_team, r_team, l_folded, r_folded``: pairs of names that share a signature, a small part of all pairs.

    No pair with the wanted ratio is missed: its matching blocks leave at most ``_allowed`` characters, so one of the signatures
    is untouched. Names are met by equality of signatures.
    """
    short = name_signatures(names).select(F.col("team").alias("s_team"), F.col("folded").alias("s_folded"), "signature")
    long = name_probes(names).select(F.col("team").alias("t_team"), F.col("folded").alias("t_folded"), "signature")
    met = short.join(long, "signature").filter(F.col("s_team") != F.col("t_team"))
    ordered = F.col("s_team") < F.col("t_team")
    pick = lambda a, b, alias: F.when(ordered, F.col(a)).otherwise(F.col(b)).alias(alias)
    return met.select(
        pick("s_team", "t_team", "l_team"), pick("t_team", "s_team", "r_team"), pick("s_folded", "t_folded", "l_folded"), pick("t_folded", "s_folded", "r_folded"),
    ).distinct()


def club_word_pairs(names: DataFrame) -> DataFrame:
    """``l_team, r_team, l_folded, r_folded``: names that differ only by club words which one of them has in addition."""
    words = F.array_distinct(F.split("folded", " "))
    club = F.array(*[F.lit(w) for w in CLUB_WORDS])
    base = names.withColumn("words", words).withColumn("core", F.array_join(F.array_sort(F.array_except("words", club)), " "))
    left, right = (base.select(*[F.col(c).alias(f"{side}_{c}") for c in ("team", "folded", "words", "core")]) for side in "lr")
    l_in_r = (F.size(F.array_except("l_words", "r_words")) == 0) & (F.size("l_words") < F.size("r_words"))
    r_in_l = (F.size(F.array_except("r_words", "l_words")) == 0) & (F.size("r_words") < F.size("l_words"))
    met = left.join(right, F.col("l_core") == F.col("r_core")).filter((F.col("l_team") < F.col("r_team")) & (l_in_r | r_in_l))
    return met.select("l_team", "r_team", "l_folded", "r_folded")


def _scored(by_words: DataFrame, by_text: DataFrame) -> DataFrame:
    pairs = by_words.withColumn("by_words", F.lit(True)).unionByName(by_text.withColumn("by_words", F.lit(False)))
    pairs = pairs.groupBy("l_team", "r_team", "l_folded", "r_folded").agg(F.max("by_words").alias("by_words"))
    # Edits bound the matching blocks from above, inside the JVM; only what passes is matched block by block.
    edits = F.levenshtein("l_folded", "r_folded") <= _allowed(F.length("l_folded") + F.length("r_folded"))
    scored = pairs.filter(F.col("by_words") | edits).withColumn("ratio", _ratio("l_folded", "r_folded"))
    method = F.when(F.col("by_words"), "tokens_with_club_qualifier").when(F.col("ratio") >= SIMILARITY, "high_string_similarity")
    return scored.withColumn("method", method).filter(F.col("method").isNotNull()).select(
        F.col("l_team").alias("left"), F.col("r_team").alias("right"), F.round("ratio", 4).alias("similarity"), "method",
    )


def similar_name_pairs(names: DataFrame) -> DataFrame:
    """All pairs of folded names that are similar, without comparing every pair.

    ``names`` holds ``team`` and ``folded``, distinct teams without nulls. Names that differ only by club words share their other
    words; names with a high matching ratio share a signature of segments. Both are joins by equality, and lossless.
    """
    return _scored(club_word_pairs(names), name_candidates(names))


def alias_candidates(team_seasons: DataFrame, keep_overlapping: bool = True) -> DataFrame:
    """Similar names with the seasons of both; ``team_seasons`` holds (team, season).

    Names that share a season belong to two teams. They are only marked as ``overlaps`` if ``keep_overlapping``, else they leave
    before any similarity is worked out.
    """
    per_team = team_seasons.filter(F.col("team").isNotNull()).groupBy("team").agg(F.array_sort(F.collect_set("season")).alias("seasons"))
    names = per_team.filter(~is_reserve_name(F.col("team"))).select("team", fold_words(F.col("team")).alias("folded"))
    left = per_team.select(F.col("team").alias("l_team"), F.col("seasons").alias("left_seasons"))
    right = per_team.select(F.col("team").alias("r_team"), F.col("seasons").alias("right_seasons"))
    overlap = F.arrays_overlap("left_seasons", "right_seasons")

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs if keep_overlapping else pairs.join(left, "l_team").join(right, "r_team").filter(~overlap).select(*pairs.columns)

    scored = _scored(apart(club_word_pairs(names)), apart(name_candidates(names)))
    met = scored.join(left.withColumnRenamed("l_team", "left"), "left").join(right.withColumnRenamed("r_team", "right"), "right")
    return met.withColumn("overlaps", overlap)


def reserve_pairs(team_seasons: DataFrame) -> DataFrame:
    """Number of pairs with at least one reserve team, by counting instead of pairing."""
    counts = team_seasons.select("team").distinct().agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_reserve_name(F.col("team"))).alias("r")
    )
    n, kept = F.col("n"), F.col("n") - F.col("r")
    return counts.select(((n * (n - 1) - kept * (kept - 1)) / 2).cast("bigint").alias("reserve_pairs"))
