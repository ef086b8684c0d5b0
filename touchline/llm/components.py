"""Connected components of a link table by alternating stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of links and an order-free sum of their hashes: two numbers reach the driver."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest node it reaches, itself included.

    ``edges`` has two comparable columns. Null ends and self links count as no link, repeated links as one. Large-star
    and small-star alternate, so the number of rounds grows with the logarithm of the longest chain. Nothing but a
    fingerprint of a round reaches the driver; hubs are summed map-side, their joins are left to Spark's skew split.
    """
    u, v = edges.columns
    now = stage(_tidy(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna()))
    seen = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        now = stage(_tidy(_small_star(_tidy(_large_star(now)))))
        found = _fingerprint(now)
        if found == seen:
            members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = found
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
