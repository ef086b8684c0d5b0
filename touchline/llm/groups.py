"""Links inside groups of any size, without emitting pairs: a leader first, blocks of the rest after."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

#: Compares row i of one frame with rows of another: (payload of i, payloads) -> similarities, linked where >= 0.
Compare = Callable[[bytes, list[bytes]], np.ndarray]


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that end where a group ends, with the group borders; rows arrive sorted by ``key``."""
    left = None
    for pdf in frames:
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        if not len(pdf):
            continue
        g = pdf[key].to_numpy()
        new = np.flatnonzero(g[1:] != g[:-1]) + 1
        cut = new[-1] if len(new) else 0
        left = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield pdf.iloc[:cut], np.concatenate([[0], new])
    if left is not None and len(left):
        yield left, np.array([0, len(left)])


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def forest_links(payload: list[bytes], role: np.ndarray, compare: Compare) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows. Rows of role 0 are one component already (they share the leader), and
    rows of equal positive role meet in another task if ``role`` names two blocks."""
    n = len(payload)
    forest, out = Forest(n), []
    near = np.flatnonzero(role == 0)
    for i in near[1:]:
        forest.join(int(near[0]), int(i))
    two = len(np.unique(role)) > 1
    for i in range(n):
        if two and role[i] == 0:
            continue
        others = [j for j in range(n) if (j > i or role[j] == 0) and (not two or role[j] != role[i]) and forest.root(j) != forest.root(i)]
        if not others:
            continue
        like = compare(payload[i], [payload[j] for j in others])
        for at in np.flatnonzero(like >= 0):
            if forest.join(i, others[at]):
                out.append((i, others[at]))
    return out


def _linker(compare: Compare) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, borders in whole_groups(frames, "task"):
            k, payload, role = pdf["k"].to_numpy(), pdf["payload"].to_numpy(), pdf["role"].to_numpy()
            u, v = [], []
            for a, b in zip(borders, [*borders[1:], len(pdf)], strict=True):
                if b - a < 2:
                    continue
                for i, j in forest_links(list(payload[a:b]), role[a:b], compare):
                    u.append(k[a + i])
                    v.append(k[a + j])
            yield pd.DataFrame({"u": u, "v": v})

    return run


def _tasks(rows: DataFrame, compare: Compare) -> DataFrame:
    kind = rows.schema["k"].dataType.simpleString()
    return rows.repartition("task").sortWithinPartitions("task").mapInPandas(_linker(compare), f"u {kind}, v {kind}")


def links(members: DataFrame, compare: Compare, block: int) -> DataFrame:
    """``u, v``: links that connect, inside every group, exactly what the full set of links connects.

    ``members`` has ``g`` (the group), ``k`` (row key) and ``payload`` (binary); ``compare`` tells which rows link. Groups of
    up to ``block`` rows are worked out in one piece. In larger ones every row is compared with the group's smallest key (a
    join that Spark may split); rows linked to it are connected, so only the rest still meets all others, block by block.
    Pairs of rows that are connected already are not compared. No group is held in one task beyond two blocks.
    """
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("leader")).filter("n > 1")
    sized = members.join(sizes, "g")
    small = sized.filter(F.col("n") <= block).select(F.xxhash64("g").alias("task"), "k", "payload", F.lit(1).alias("role"))
    # Hash collisions of two group names would only add comparisons, never links that do not hold.
    out = _tasks(small, compare)
    large = stage(sized.filter(F.col("n") > block))
    if not large.limit(1).count():
        return out
    heads = large.filter(F.col("k") == F.col("leader")).select("g", F.col("payload").alias("head")).dropDuplicates(["g"])

    @F.pandas_udf("boolean")
    def with_head(payload: pd.Series, head: pd.Series) -> pd.Series:
        hit = np.zeros(len(payload), bool)
        for one, at in payload.groupby(head, sort=False).indices.items():
            hit[at] = compare(one, [payload.iloc[i] for i in at]) >= 0
        return pd.Series(hit)

    met = stage(large.join(heads, "g").withColumn("near", (F.col("k") == F.col("leader")) | with_head("payload", "head")).drop("head"))
    star = met.filter(F.col("near") & (F.col("k") != F.col("leader"))).select(F.col("leader").alias("u"), F.col("k").alias("v"))
    shape = met.groupBy("g").agg(F.count(F.when(F.col("near"), 1)).alias("n_near"), F.count(F.when(~F.col("near"), 1)).alias("n_rest"))
    blocks = shape.select("g", F.ceil(F.col("n_near") / block).alias("b_near"), F.ceil(F.col("n_rest") / block).alias("b_rest")).filter("b_rest > 0")
    laid = met.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.when(F.col("near"), F.col("b_near")).otherwise(F.col("b_rest"))))
    name = lambda *c: F.xxhash64("g", *c)
    near = laid.filter("near").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_rest") - 1)))
    near = near.select(name(F.lit("near"), "i", "own").alias("task"), "k", "payload", F.lit(0).alias("role"))
    rest = laid.filter("not near")
    rest_near = rest.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_near") - 1)))
    rest_near = rest_near.select(name(F.lit("near"), "own", "j").alias("task"), "k", "payload", F.lit(1).alias("role"))
    rest_rest = rest.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_rest") - 1)))
    rest_rest = rest_rest.select(
        name(F.lit("rest"), F.least("own", "j"), F.greatest("own", "j")).alias("task"), "k", "payload",
        F.when(F.col("own") <= F.col("j"), 1).otherwise(2).alias("role"),
    )
    return out.union(star).union(_tasks(near.union(rest_near).union(rest_rest), compare))
