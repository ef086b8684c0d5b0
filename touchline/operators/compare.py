"""Comparison of two prediction sets over the same matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import blend, metrics
from touchline.operators.missing import require_unique

KEYS = ("date", "division", "home", "away", "result")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row: rows only in a, only in b, and whether the key multisets are equal."""
    counted = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(1)).unionByName(
        b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(-1))
    )
    gap = counted.groupBy(*keys).agg(F.sum(F.col("n") * F.col("side")).alias("gap"))
    out = gap.agg(
        F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.greatest(-F.col("gap"), F.lit(0))), F.lit(0)).alias("only_b"),
    )
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One-to-one inner join with suffixes _a and _b; repeated keys fail."""
    def suffixed(df: DataFrame, end: str) -> DataFrame:
        checked = require_unique(df, list(keys), "prediction")
        return checked.select(*keys, *[F.col(c).alias(f"{c}{end}") for c in df.columns if c not in keys])

    return suffixed(a, "_a").join(suffixed(b, "_b"), list(keys))


def probability_metrics(df: DataFrame, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy of the pick, market accuracy, log loss and Brier score, overall or per group."""
    p = [F.col(f"{prefix}_prob_{s}") for s in ("1", "x", "2")]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("partidos"),
        F.avg((F.col(f"{prefix}_pred") == F.col("result")).cast("int")).alias("accuracy_simple"),
        F.avg("favorite_market_hit").alias("accuracy_market_favorite"),
        F.avg(metrics.log_loss(*p, F.col("result"))).alias("log_loss"),
        F.avg(metrics.brier(*p, F.col("result"))).alias("brier_score"),
    )


def compare_predictions(a: DataFrame, b: DataFrame, prefix: str) -> DataFrame:
    """Paired contrast of two prediction sets: changed picks, discordance and McNemar p-value."""
    both = align(a, b)
    return metrics.paired_contrast(
        both.select("result", F.col(f"{prefix}_pred_a").alias("pick_a"), F.col(f"{prefix}_pred_b").alias("pick_b"))
    )


def compare_doubles(a: DataFrame, b: DataFrame, prefix: str, config: Mapping, seed: int = 42) -> DataFrame:
    """Mean difference of block hits with its bootstrap interval, under one fixed configuration."""
    left = blend.simulate_doubles(a, prefix, config).withColumnRenamed("hits_3_dobles", "hits_a")
    right = blend.simulate_doubles(b, prefix, config).withColumnRenamed("hits_3_dobles", "hits_b")
    gaps = left.join(right, "block").select((F.col("hits_a") - F.col("hits_b")).alias("gap"))
    mean = gaps.agg(F.avg("gap").alias("mean_difference"), F.lit(1).alias("_one"))
    interval = metrics.bootstrap_interval(gaps, "gap", seed=seed).withColumn("_one", F.lit(1))
    return mean.join(interval, "_one").drop("_one")
