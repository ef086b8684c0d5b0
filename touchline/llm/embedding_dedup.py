"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks. If two of them are within squared distance D, some block of w of d dimensions is
within D * w / d. Each block is range-joined on a grid over its first coordinates; a pair is taken up in the first block
whose budget it keeps, so the union of the candidates needs no deduplication, and it is verified in double precision.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.groups import Forest, whole_groups
from touchline.session import stage

WIDTH = 16
GRID = 2
#: Vectors of one side that a task compares at once; fuller cells are cut into pieces of about this size.
PIECE = 2_000
#: Pairs compared at once inside a task.
PAIRS = 400_000
SLACK = 1e-9


@dataclass(frozen=True)
class Plan:
    """Blocks and budgets for vectors of one dimension at a cosine threshold."""

    dim: int
    cosine: float

    @property
    def blocks(self) -> list[slice]:
        return [slice(i, min(i + WIDTH, self.dim)) for i in range(0, self.dim, WIDTH)]

    def budget(self, block: slice) -> float:
        return max(0.0, 2 - 2 * self.cosine) * (block.stop - block.start) / self.dim + SLACK

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng(3).normal(size=(self.dim, self.dim)))
        return unit @ (q * np.sign(np.diag(r)))


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, k, label, dim, payload`` per row; ``k`` names the class of equal vectors of a label, null if it cannot link."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            k, dim, payload = [], [], []
            for v, label in zip(pdf["embedding"], pdf["label"], strict=True):
                x = None if v is None or label is None else np.array(v, np.float64)  # a null component becomes NaN
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    k.append(None), dim.append(None), payload.append(None)
                    continue
                raw = (x + 0.0).tobytes()  # -0.0 equals 0.0
                k.append(hashlib.md5(f"{label}|".encode() + raw).digest())
                dim.append(len(x))
                payload.append(raw)
            yield pd.DataFrame({"vec_id": list(pdf["vec_id"]), "k": k, "label": list(pdf["label"]), "dim": pd.array(dim, "Int32"), "payload": payload})

    typed = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    return typed.mapInPandas(run, "vec_id string, k binary, label string, dim int, payload binary").withColumn("vec_id", F.col("vec_id").cast("long"))


def _matrix(payload: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(payload), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(reps: DataFrame, cosine: float) -> DataFrame:
    """``k, dim, block, cell, home``: the cell a vector lives in, in every block, and the later neighbours its ball reaches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for (label, dim), rows in pdf.groupby(["label", "dim"], sort=False):
                plan = Plan(int(dim), cosine)
                y = plan.rotated(_unit(_matrix(rows["payload"], int(dim))))
                keys = rows["k"].to_numpy()
                for j, block in enumerate(plan.blocks):
                    side = np.sqrt(plan.budget(block)) * (1 + SLACK)
                    at = y[:, block][:, :GRID] / side
                    low = np.floor(at).astype(np.int64)
                    for step in itertools.product((-1, 0, 1), repeat=low.shape[1]):
                        lead = next((s for s in step if s), 0)
                        if lead < 0:  # the other side visits
                            continue
                        s = np.array(step)
                        gap = np.where(s > 0, low + 1 - at, np.where(s < 0, at - low, 0.0))
                        reach = (gap * gap).sum(axis=1) <= 1
                        if not reach.any():
                            continue
                        names = [f"{label}|{dim}|{j}|{','.join(map(str, c))}" for c in (low + s)[reach].tolist()]
                        yield pd.DataFrame({"k": keys[reach], "dim": dim, "block": j, "cell": names, "home": lead == 0})

    return reps.select("k", "label", "dim", "payload").mapInPandas(run, "k binary, dim int, block int, cell string, home boolean")


def _linked(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, within: bool, dim: int, block: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked weight of every row, and links that connect what the linked pairs connect."""
    plan = Plan(dim, cosine)
    unit = _unit(x)
    y = plan.rotated(unit)
    parts = plan.blocks
    got, forest, out = np.zeros(len(x), np.int64), Forest(len(x)), []
    sq = [(y[:, b] ** 2).sum(axis=1) for b in parts]
    step = max(1, PAIRS // max(1, len(right)))
    for lo in range(0, len(left), step):
        mine = left[lo : lo + step]
        # Rounding may not lose a pair at the budget's edge: the product form gets a slack, the cosine decides.
        d = sq[block][mine][:, None] + sq[block][right] - 2 * (y[mine, parts[block]] @ y[right, parts[block]].T)
        i, j = np.nonzero(d <= plan.budget(parts[block]))
        if within:
            keep = mine[i] < right[j]
            i, j = i[keep], j[keep]
        i, j = mine[i], right[j]
        for b in range(block):  # taken up in an earlier block
            before = _block_distance(sq[b], y, parts[b], i, j) <= plan.budget(parts[b])
            i, j = i[~before], j[~before]
        for a in range(0, len(i), 50_000):
            p, q = i[a : a + 50_000], j[a : a + 50_000]
            like = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[like], q[like]
            got += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
            out += [(u, v) for u, v in zip(p.tolist(), q.tolist(), strict=True) if forest.join(u, v)]
    return got, out


def _block_distance(sq: np.ndarray, y: np.ndarray, part: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 100_000):
        p, q = i[a : a + 100_000], j[a : a + 100_000]
        out[a : a + 100_000] = sq[p] + sq[q] - 2 * np.einsum("ij,ij->i", y[p, part], y[q, part])
    return out


def cell_links(reps: DataFrame, cosine: float, piece: int = PIECE) -> DataFrame:
    """``u, v, n``: rows with ``v`` null say how many vectors ``u`` links to in one task, the others are links that connect.

    Cells without a partner go first. A full cell is cut into pieces, and every two pieces meet in a task of their own.
    """
    placed = stage(cells(reps, cosine))
    sizes = placed.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("visitors"))
    sizes = sizes.filter((F.col("homes") > 1) | ((F.col("homes") > 0) & (F.col("visitors") > 0)))
    sizes = sizes.withColumn("hs", F.ceil(F.col("homes") / piece)).withColumn("vs", F.ceil(F.col("visitors") / piece))
    sized = placed.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("k"), F.when(F.col("home"), F.col("hs")).otherwise(F.col("vs"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    task = lambda kind, a, b: F.xxhash64("cell", F.lit(kind), a, b).alias("task")
    keep = ["k", "dim", "block"]
    home = sized.filter("home and homes > 1").withColumn("o", F.explode(upto("hs")))
    home = home.select(*keep, task("home", F.least("own", "o"), F.greatest("own", "o")), F.when(F.col("own") == F.col("o"), F.when(F.col("hs") == 1, 0).otherwise(3)).when(F.col("own") < F.col("o"), 1).otherwise(2).alias("role"))
    host = sized.filter("home and visitors > 0").withColumn("o", F.explode(upto("vs"))).select(*keep, task("visit", "own", "o"), F.lit(1).alias("role"))
    visit = sized.filter("not home").withColumn("o", F.explode(upto("hs"))).select(*keep, task("visit", "o", "own"), F.lit(2).alias("role"))
    rows = home.union(host).union(visit).join(reps.select("k", "payload", "copies"), "k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, borders in whole_groups(frames, "task"):
            us, vs, ns = [], [], []
            for a, b in zip(borders, [*borders[1:], len(pdf)], strict=True):
                rows_ = pdf.iloc[a:b]
                role = rows_["role"].to_numpy()
                one, two = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
                within = not len(one) and not len(two)
                if within:
                    one = two = np.arange(len(role))
                if not len(one) or not len(two):
                    continue
                dim = int(rows_["dim"].iloc[0])
                got, edges = _linked(_matrix(rows_["payload"], dim), rows_["copies"].to_numpy(), one, two, within, dim, int(rows_["block"].iloc[0]), cosine)
                k = rows_["k"].to_numpy()
                for i in np.flatnonzero(got):
                    us.append(k[i]), vs.append(None), ns.append(int(got[i]))
                for i, j in edges:
                    us.append(k[i]), vs.append(k[j]), ns.append(0)
            yield pd.DataFrame({"u": us, "v": vs, "n": pd.array(ns, "int64")})

    return rows.repartition("task").sortWithinPartitions("task").mapInPandas(run, "u binary, v binary, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, piece: int = PIECE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector row.

    Vectors of one non-null label link when their cosine is at least ``cosine``. A vector that is null, empty, all zero, or
    holds a null or non-finite component links with nothing, nor do vectors of different lengths. Equal vectors are one row
    from the start and count as links of each other. ``component_id`` is the smallest vec_id reachable, its own included;
    rows that share a vec_id each get a row, a null vec_id names a component only if no other member does.
    """
    rows = stage(prepared(vectors))
    reps = stage(rows.filter(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("payload").alias("payload")))
    links = stage(cell_links(reps, cosine, piece))
    linked = components(links.filter(F.col("v").isNotNull()).select("u", "v")).select(F.col("node").alias("k"), "root")
    counts = links.groupBy(F.col("u").alias("k")).agg(F.sum("n").alias("others"))
    classes = reps.select("k", "copies", "vec_id").join(linked, "k", "left").join(counts, "k", "left").withColumn("root", F.coalesce("root", "k"))
    smallest = classes.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    classes = classes.join(smallest, "root").select("k", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "k").join(classes, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
