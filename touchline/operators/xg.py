"""Expected-goals enrichment of the match table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import settings
from touchline.operators.missing import require_unique

KEY = ("date", "home", "away")
XG = settings.XG_COLUMNS


def exact_merge(matches: DataFrame, xg: DataFrame, check_unique: bool = True) -> DataFrame:
    """Left join on (date, home, away) with ``xg_matched`` when all six values are present."""
    source = xg.select(*KEY, *XG)
    if check_unique:
        source = require_unique(source, KEY, "xG row")
    matched = F.lit(True)
    for name in XG:
        matched = matched & F.col(name).isNotNull()
    return matches.join(source, list(KEY), "left").withColumn("xg_matched", matched)


def nearby_candidates(xg: DataFrame, days: int = settings.XG_WINDOW_DAYS) -> DataFrame:
    """xG values per (home, away, day) for every day with exactly one xG row within the window.

    Each xG row is offered to the days around it, so the interval join becomes an equality join and
    each key is reduced to one row before it meets the matches.
    """
    offered = xg.withColumn("day", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))))
    counted = offered.groupBy("home", "away", "day").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in XG]
    )
    return counted.filter(F.col("_n") == 1).drop("_n").withColumnRenamed("day", "date")


def merge_xg(matches: DataFrame, xg: DataFrame | None, check_unique: bool = True) -> DataFrame:
    """Exact merge, then the single candidate within three days for unmatched rows."""
    if xg is None:
        return matches.withColumns({c: F.lit(None).cast("double") for c in XG} | {"xg_matched": F.lit(False)})
    merged = exact_merge(matches, xg, check_unique)
    nearby = nearby_candidates(xg).select(*KEY, *[F.col(c).alias(f"_near_{c}") for c in XG], F.lit(True).alias("_near"))
    out = merged.join(nearby, list(KEY), "left")
    use = ~F.col("xg_matched") & F.coalesce(F.col("_near"), F.lit(False))
    out = out.withColumns({c: F.when(use, F.col(f"_near_{c}")).otherwise(F.col(c)) for c in XG})
    return out.withColumn("xg_matched", F.col("xg_matched") | use).drop("_near", *[f"_near_{c}" for c in XG])


def xg_coverage(xg: DataFrame) -> DataFrame:
    return xg.agg(
        (F.count(F.lit(1)) > 0).alias("available"), F.count(F.lit(1)).alias("matches"),
        F.min("date").alias("date_from"), F.max("date").alias("date_to"),
        F.concat_ws("|", F.transform(F.array_sort(F.collect_set(F.year("date"))), lambda y: y.cast("string"))).alias(
            "seasons"
        ),
    )
