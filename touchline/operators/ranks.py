"""Exact order statistics without holding a group's values anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import stage

#: Ranges a group's values are cut into, and distinct values that are few enough to be sorted.
BINS = 1024
SORTED_VALUES = 10_000


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``median``, a double, for every group with a value; NULL values are left out, an even number takes the middle two's mean.

    Equal values are counted together first. While a group has many distinct values left, they are counted by ranges, and the
    range that holds the middle rank becomes the next whole; what remains is sorted. Each round reads the counted values once
    and moves at most ``BINS`` rows a group. Rounds end: a range shrinks by ``BINS`` until it holds one double.
    """
    keys = [f"g{i}" for i in range(len(by))] or ["g0"]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("g0")]
    counted = df.select(*named, (F.col(value).cast("double") + F.lit(0.0)).alias("v")).filter(F.col("v").isNotNull())
    counted = stage(counted.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    state = stage(counted.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.lit(0).cast("long").alias("below"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
    ))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    wide = (F.col("d") > SORTED_VALUES) & F.col("low").isNull()

    def inside(groups: DataFrame) -> DataFrame:
        known = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "below", "lo", "hi")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = counted.join(known, same).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        return joined.drop(*[f"_{k}" for k in keys])

    while state.filter(wide).limit(1).count():
        width = F.col("hi") - F.col("lo")
        at = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / width * BINS))
        bins = inside(state.filter(wide)).withColumn("bin", at).groupBy(*keys, "bin").agg(
            F.max("n").alias("n"), F.max("below").alias("below"), F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d"),
        )
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = bins.withColumn("upto", F.col("below") + F.sum("c").over(upto))
        here = F.struct("bin", "lo", "hi", "d", (F.col("upto") - F.col("c")).alias("before"))
        found = ranked.groupBy(*keys).agg(
            F.max("n").alias("n"), F.min(F.when(F.col("upto") > first, here)).alias("x"), F.min(F.when(F.col("upto") > second, here)).alias("y"),
        )
        apart = F.col("x.bin") != F.col("y.bin")  # the middle two are the last of one range and the first of another
        narrowed = found.select(
            *keys, "n", F.col("x.before").alias("below"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"), F.col("x.d").alias("d"),
            F.when(apart, F.col("x.hi")).alias("low"), F.when(apart, F.col("y.lo")).alias("high"),
        )
        state = stage(state.filter(~wide).unionByName(narrowed))
    order = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside(state.filter(F.col("low").isNull())).withColumn("upto", F.col("below") + F.sum("c").over(order))
    sorted_out = ranked.groupBy(*keys).agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("low"), F.min(F.when(F.col("upto") > second, F.col("v"))).alias("high"))
    done = sorted_out.unionByName(state.filter(F.col("low").isNotNull()).select(*keys, "low", "high"))
    return done.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], ((F.col("low") + F.col("high")) / 2).alias("median"))
