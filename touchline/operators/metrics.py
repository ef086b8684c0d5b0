"""Evaluation of outcome probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import settings
from touchline.functions.probability import argmax_sign
from touchline.operators.ordinal import with_running_sum

LOG_FLOOR = 2.220446049250313e-16


def probability_of_result(p1: Column, px: Column, p2: Column, result: Column) -> Column:
    return F.when(result == "1", p1).when(result == "X", px).when(result == "2", p2)


def log_loss(p1: Column, px: Column, p2: Column, result: Column) -> Column:
    return -F.log(F.greatest(probability_of_result(p1, px, p2, result), F.lit(LOG_FLOOR)))


def brier(p1: Column, px: Column, p2: Column, result: Column) -> Column:
    parts = [
        F.pow(p - (result == s).cast("double"), F.lit(2.0)) for s, p in zip(settings.SIGNS, (p1, px, p2))
    ]
    return parts[0] + parts[1] + parts[2]


def confidence_bin(confidence: Column, bins: int = 10) -> Column:
    """Equal bins closed on the right, the first one on both sides."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(confidence * bins))).cast("int")


def outcome_metrics(
    rows: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = ("p1", "px", "p2"), bins: int = 10
) -> DataFrame:
    """Rows, accuracy, log loss, Brier score and calibration error per group.

    One pass: sums per (group, confidence bin) combine on the map side, the rest is tiny.
    """
    p1, px, p2 = (F.col(c) for c in columns)
    result = F.col("result")
    confidence = F.greatest(p1, px, p2)
    sums = rows.select(
        *by, confidence_bin(confidence, bins).alias("_bin"), confidence.alias("_conf"),
        (argmax_sign(p1, px, p2) == result).cast("int").alias("_hit"),
        log_loss(p1, px, p2, result).alias("_ll"), brier(p1, px, p2, result).alias("_br"),
    ).groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_hits"), F.sum("_conf").alias("_conf"),
        F.sum("_ll").alias("_ll"), F.sum("_br").alias("_br"),
    )
    n = F.sum("_n")
    return sums.groupBy(*by).agg(
        n.alias("matches"), (F.sum("_hits") / n).alias("accuracy"), (F.sum("_ll") / n).alias("log_loss"),
        (F.sum("_br") / n).alias("brier"),
        (F.sum(F.abs(F.col("_hits") - F.col("_conf"))) / n).alias("ece"),
    )


def calibration_report(rows: DataFrame, raw: Sequence[str], calibrated: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics before and after calibration, stacked by ``stage``."""
    stages = [
        F.struct(F.lit(name).alias("stage"), *[F.col(c).alias(a) for c, a in zip(cols, ("p1", "px", "p2"))])
        for name, cols in (("raw", raw), ("calibrated", calibrated))
    ]
    long = rows.select(*by, "result", F.inline(F.array(*stages)))
    return outcome_metrics(long, [*by, "stage"])


def stack_candidates(rows: DataFrame, candidates: dict[str, Sequence[Column]], keep: Sequence[str]) -> DataFrame:
    """Several probability sets of the same matches in long form (candidate, p1, px, p2)."""
    structs = [
        F.struct(F.lit(name).alias("candidate"), *[c.alias(a) for c, a in zip(parts, ("p1", "px", "p2"))])
        for name, parts in candidates.items()
    ]
    return rows.select(*keep, F.inline(F.array(*structs)))


def delta_to(metrics: DataFrame, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy difference of each candidate to the reference candidate of the same group."""
    base = metrics.filter(F.col("candidate") == reference).select(*by, F.col("accuracy").alias("_base"))
    if by:
        joined = metrics.join(base, list(by))
    else:
        joined = metrics.withColumn("_one", F.lit(1)).join(base.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.withColumn("delta_accuracy", F.col("accuracy") - F.col("_base")).drop("_base")


def wins_over(metrics: DataFrame, reference: str, by: Sequence[str]) -> DataFrame:
    """In how many groups (seasons) each candidate is more accurate than the reference."""
    compared = delta_to(metrics, reference, by).filter(F.col("candidate") != reference)
    return compared.groupBy("candidate").agg(
        F.count_if(F.col("delta_accuracy") > 0).alias("wins"), F.count(F.lit(1)).alias("groups"),
        F.avg("accuracy").alias("accuracy"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"),
        F.avg("ece").alias("ece"),
    )


# ---------------------------------------------------------------------------
# Binary classifier
# ---------------------------------------------------------------------------

def binary_metrics(rows: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label",
                   threshold: float = 0.30) -> DataFrame:
    """AUC (ties count half), log loss, precision and recall of ``score > threshold``.

    Equal scores are combined before the ranking, so the ordered step sees distinct scores only;
    the cumulative count runs bucket by bucket (see ``touchline.operators.ordinal``).
    """
    p = F.greatest(F.least(F.col(score), F.lit(1 - LOG_FLOOR)), F.lit(LOG_FLOOR))
    y, said = F.col(label) == 1, F.col(score) > threshold
    basic = rows.groupBy(*by).agg(
        F.avg(-F.when(y, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
        F.coalesce(F.count_if(y & said) / F.nullif(F.count_if(said), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.count_if(y & said) / F.nullif(F.count_if(y), F.lit(0)), F.lit(0.0)).alias("recall"),
        F.avg(score).alias("mean_score"), F.avg(F.col(label)).alias("base_rate"),
        F.count(F.lit(1)).alias("rows"),
    )
    distinct = rows.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg")
    )
    group = list(by) or ["_all"]
    if not by:
        distinct = distinct.withColumn("_all", F.lit(1))
    bucketed = distinct.withColumn("_bucket", F.floor(F.col("_s") * 1000)).withColumn("_neg", F.col("_neg").cast("double"))
    ranked = with_running_sum(bucketed, "_neg", "_below", group, ["_bucket"], ["_s"])
    auc = ranked.groupBy(*group).agg(
        (F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
         / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0.0))).alias("auc")
    )
    if by:
        return basic.join(auc, list(by))
    return basic.withColumn("_all", F.lit(1)).join(auc, "_all").drop("_all")


# ---------------------------------------------------------------------------
# Paired comparison
# ---------------------------------------------------------------------------

#: Below this many successes the probability of a count is a short product, above it Stirling's series holds to the last digit.
SHORT = 32


def _stirling(m: Column) -> Column:
    """log m! beyond Stirling's formula, for m of at least SHORT."""
    q = 1.0 / (m * m)
    return (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680))) / m


def _log_coin(n: Column, k: Column) -> Column:
    """Log probability of k heads in n tosses, k at most n/2. Written as a deviance, so that no large terms cancel."""
    short = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), F.lit(0.0), lambda acc, i: acc + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1) / i)))
    d = (n - 2 * k) / n
    deviance = n / 2 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    scale = F.log(n / (2 * math.pi * k * (n - k))) / 2
    return F.when(k < SHORT, short - n * math.log(2)).otherwise(_stirling(n) - _stirling(k) - _stirling(n - k) - deviance + scale)


def mcnemar(only_first: Column, only_second: Column) -> Column:
    """Exact two-sided p-value of discordant counts: the probability of the smaller count times the sum of ratios below it.

    Terms beyond five roots of n are less than 1e-21 of the first, so the work grows with the root of the counts.
    """
    n = (only_first + only_second).cast("double")
    k = F.least(only_first, only_second).cast("double")

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["total"] + acc["term"]).alias("total"), (acc["term"] * (k - i) / (n - k + 1 + i)).alias("term"))

    terms = F.least(k, F.ceil(5 * F.sqrt(n)) + 40).cast("bigint")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), terms), start, step)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(_log_coin(n, k)) * tail))


def paired_contrast(pairs: DataFrame) -> DataFrame:
    """Discordance of two sets of picks: ``pairs`` hold result, pick_a and pick_b."""
    a, b = F.col("pick_a") == F.col("result"), F.col("pick_b") == F.col("result")
    counts = pairs.agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("pick_a") != F.col("pick_b")).alias("different_picks"),
        F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"),
        F.avg(a.cast("int") - b.cast("int")).alias("accuracy_difference"),
    )
    return counts.withColumn("mcnemar_p", mcnemar(F.col("only_a"), F.col("only_b")))


def bootstrap_interval(differences: DataFrame, value: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean difference by Poisson bootstrap.

    Rows are first reduced to counts per distinct difference. A sum of unit Poisson weights is a
    Poisson weight of the count, so a replicate costs one draw per distinct value instead of per row. A task
    draws for its own values and emits one partial sum per replicate; draws depend on the value only, not on the
    partitioning. Nulls are left out.
    """
    counts = differences.select(F.col(value).cast("double").alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("n"))

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = np.zeros(replicates), np.zeros(replicates)
        for pdf in frames:
            for v, bits, n in zip(pdf["v"], pdf["v"].to_numpy(np.float64).view(np.uint64), pdf["n"], strict=True):
                w = np.random.default_rng([seed, int(bits)]).poisson(n, replicates)
                weight += w
                total += v * w
        yield pd.DataFrame({"replicate": np.arange(replicates), "weight": weight, "total": total})

    drawn_sums = counts.mapInPandas(drawn, "replicate int, weight double, total double")
    sums = drawn_sums.groupBy("replicate").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    means = sums.select(F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).otherwise(0.0).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------

def score_hits(rows: DataFrame, by: Sequence[str] = (), top: str = "top", max_goals: int = settings.MAX_GOALS) -> DataFrame:
    """Share of exact scores and of scores among the top list; goals are capped at the grid."""
    actual = F.concat_ws(
        "-", F.least("FTHG", F.lit(max_goals)).cast("string"), F.least("FTAG", F.lit(max_goals)).cast("string")
    )
    position = F.array_position(F.transform(top, lambda t: t["score"]), actual)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.avg((position == 1).cast("int")).alias("exact"),
        F.avg((position > 0).cast("int")).alias("in_top"),
    )


def score_log_loss(goals_home: Column, goals_away: Column, lambda_home: Column, lambda_away: Column) -> Column:
    """Log loss of the exact score under independent Poisson goals, floor 1e-10."""

    def pmf(goals: Column, mean: Column) -> Column:
        return F.exp(-mean) * F.pow(mean, goals.cast("double")) / F.factorial(goals)

    return -F.log(F.least(F.greatest(pmf(goals_home, lambda_home) * pmf(goals_away, lambda_away), F.lit(1e-10)), F.lit(1.0)))


# ---------------------------------------------------------------------------
# Seasons and bins
# ---------------------------------------------------------------------------

def stability(seasons: DataFrame) -> DataFrame:
    """Mean, deviation, trend and gap to the market over seasons (season, accuracy, market)."""
    numbered = seasons.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("season")) - 1)
    return numbered.agg(
        F.count(F.lit(1)).alias("temporadas"), F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        (F.stddev_pop("accuracy") / F.nullif(F.avg("accuracy"), F.lit(0.0))).alias("cv_accuracy"),
        F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"),
        F.regr_slope("accuracy", "_i").alias("trend"),
        F.avg("market").alias("mean_market"), F.stddev_pop("market").alias("std_market"),
        F.avg(F.col("accuracy") - F.col("market")).alias("mean_gap_vs_market"),
        F.max_by("season", F.struct("accuracy", "season")).alias("best_season"),
        F.min_by("season", F.struct("accuracy", "season")).alias("worst_season"),
    )


# Cut points of the divergence bins, closed on the right.
DIVERGENCE_CUTS = (-1.0, -0.1, -0.05, 0.05, 0.1, 1.0)


def divergence_bin(gap: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(DIVERGENCE_CUTS, DIVERGENCE_CUTS[1:])):
        out = F.when((gap > low) & (gap <= high), i).otherwise(out)
    return out


def divergence_profile(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hit rate and mean probabilities by how far the model is above the market, over all signs.

    ``rows`` hold result, model_1/x/2 and market_1/x/2.
    """
    signs = F.array(*[
        F.struct(
            F.col(f"model_{c}").alias("model"), F.col(f"market_{c}").alias("market"),
            (F.col("result") == s).cast("int").alias("hit"),
        )
        for s, c in zip(settings.SIGNS, ("1", "x", "2"))
    ])
    long = rows.select(*by, F.inline(signs)).withColumn("diff_bin", divergence_bin(F.col("model") - F.col("market")))
    out = long.filter(F.col("diff_bin").isNotNull()).groupBy(*by, "diff_bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("hit").alias("actual_rate"),
        F.avg("market").alias("avg_market"), F.avg("model").alias("avg_model"),
    )
    return out.withColumn("value", F.col("actual_rate") - F.col("avg_market"))

