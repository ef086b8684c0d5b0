"""Row positions, splits and ticket blocks without an unpartitioned window.

Every position is the sum of an offset per bucket (a small aggregate, bounded by the calendar when
the bucket is a day) and the position inside the bucket. No task ever sorts a whole run or season.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions.text import season_index
from touchline.schemas import MATCH_ORDER


def with_ordinal(
    df: DataFrame,
    order: Sequence[str] = MATCH_ORDER,
    group: Sequence[str] = (),
    bucket: Sequence[str] = ("date",),
    name: str = "ordinal",
    size: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in ``order`` within ``group``.

    ``bucket`` must be a prefix of ``order``. ``size`` names an optional column for the group size.
    """
    group, bucket, order = list(group), list(bucket), list(order)
    if order[: len(bucket)] != bucket:
        raise ValueError("bucket columns must lead the order")
    # NULL keys sort first and must meet themselves again in the join below.
    keys = group + bucket
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*bucket)
    counts = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    kept = ["_before"]
    if size:
        counts = counts.withColumn(size, F.sum("_n").over(Window.partitionBy(*(group or [F.lit(0)]))))
        kept.append(size)
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *kept)
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*order[len(bucket):])
    return (
        df.join(counts, condition, "inner")
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before", *[f"_k_{k}" for k in keys])
    )


def with_running_sum(
    df: DataFrame, value: str, name: str, group: Sequence[str], bucket: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Sum of ``value`` over earlier rows of the group, again as bucket offset plus in-bucket part."""
    group, bucket = list(group), list(bucket)
    keys = group + bucket
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_t"))
    running = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(running), F.lit(0.0))).drop("_t")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, keys)
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
        .drop("_base")
    )


def temporal_split(df: DataFrame, share: float, group: Sequence[str] = ()) -> DataFrame:
    """Add ``is_train``: the first ``floor(n * share)`` rows in match order."""
    out = with_ordinal(df, group=group, name="_pos", size="_size")
    return out.withColumn("is_train", F.col("_pos") < F.floor(F.col("_size") * F.lit(share))).drop("_pos", "_size")


def with_blocks(df: DataFrame, group: Sequence[str] = (), complete: bool = True) -> DataFrame:
    """Add ``block`` (from 1) and ``num`` (1 to 15) in match order; by default only full blocks stay."""
    size = settings.BLOCK_SIZE
    out = with_ordinal(df, group=group, name="_pos", size="_size")
    out = out.withColumn("block", F.floor(F.col("_pos") / size) + 1).withColumn(
        "num", (F.col("_pos") % size + 1).cast("int")
    )
    if complete:
        out = out.filter(F.col("block") * size <= F.col("_size"))
    return out.drop("_pos", "_size")


def split_by_season(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows of earlier seasons for training and rows of the target season for testing."""
    start = int(str(target).split("-")[0])
    return df.filter(season_index(F.col("season")) < start), df.filter(F.col("season") == target)


def seasons_in_order(df: DataFrame) -> list[str]:
    """Distinct seasons by start year. One row per season reaches the driver."""
    rows = df.select("season").where(F.col("season").isNotNull()).distinct().collect()
    def key(season: str) -> tuple[int, str]:
        head = season.split("-")[0]
        return (int(head) if head.lstrip("-").isdigit() else 0, season)
    return sorted((r["season"] for r in rows), key=key)


def with_target_seasons(df: DataFrame) -> DataFrame:
    """Every row once for each later season of the data, named ``target_season``: what a model of that season may learn from.

    Rows multiply by the number of seasons at most, which the calendar bounds.
    """
    seasons = [(s, s.split("-")[0]) for s in seasons_in_order(df)]
    later = [(s, t) for s, a in seasons for t, b in seasons if a.isdigit() and b.isdigit() and int(a) < int(b)]
    pairs = df.sparkSession.createDataFrame(later, "season string, target_season string")
    return df.join(F.broadcast(pairs), "season")  # one row per pair of seasons


def with_calibration_holdout(blocks: DataFrame, share: float = 0.4) -> DataFrame:
    """Add ``is_holdout``: rows of the first ``share`` of the full blocks of each season."""
    counts = blocks.groupBy("season").agg(F.max("block").alias("_blocks"))
    limit: Column = F.greatest(F.lit(1), F.floor(F.col("_blocks") * F.lit(share)))
    return blocks.join(counts, "season").withColumn("is_holdout", F.col("block") <= limit).drop("_blocks")
