"""Prefix trie of conversations, screened by a count-min sketch.

The prefix of a conversation is known by the sum of its turns' positioned digests, so prefixes are made without carrying
texts. A sketch counts all prefix digests. Where it estimates one, the prefix is in one conversation only, and so is every
longer one: those nodes are written where they are. Only prefixes that may be shared are shuffled, and grouped exactly.

A node's subtree is never walked. Its smallest member owns a node, and a conversation owns its path from some depth on; sums
over a subtree are sums over members of what they own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import mix
from touchline.session import stage

#: Rows of the sketch, and its width for each prefix. The width ends at LARGEST cells (12 MB of bits in all, 96 MB while a task
#: counts): a fuller sketch proves fewer singletons, which then are grouped like shared prefixes; results stay the same.
SKETCH_ROWS, CELLS_EACH, LARGEST = 3, 4, 1 << 25
SLICE = 1 << 16
#: Turns of a conversation that one window frame sums up.
BLOCK = 1024
#: Conversation numbers packed into one row before they are hashed in order.
PACK = 4096
LIMBS = ("s0", "s1", "s2", "s3")
KEY = ["pos", "a", "b"]


def lent_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its hundred's first: part of the contract's data, not of the trie."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, rank, digest, chars`` of every turn, and ``conv_id, n`` of every conversation.

    A sort by ranges numbers all turns through; a turn's rank is its distance to its conversation's first, so no conversation has
    to fit a task. Equal turn numbers are ordered by role and the digest of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("t"), F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "t"]
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "t"), 256)
    lined = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), "chars", F.monotonically_increasing_id().alias("seq"))
    lined = stage(lined)
    part = F.shiftright("seq", 33)
    sizes = lined.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    local = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lined.join(F.broadcast(offsets), part == F.col("part")).withColumn("g", F.col("offset") + local)  # as many rows as partitions
    convs = stage(numbered.groupBy("conv_id").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")))
    ranked = numbered.join(convs.select("conv_id", "first"), "conv_id").select("conv_id", (F.col("g") - F.col("first") + 1).alias("rank"), "digest", "chars")
    return ranked, convs.select("conv_id", "n")


def rebuilt(ranked: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, len, digest, chars`` of the rebuilt conversations, and ``conv_id, len`` of all, turnless ones too."""
    mine = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), lent_turns(F.col("conv_id")).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = mine.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = stage(known.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = ranked.join(known, "conv_id").filter(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("lent")).alias("pos"), "len", "digest", "chars")
    # A base lends at most five turns to at most 199 conversations.
    lender = ranked.filter((F.col("rank") <= 5) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    lent = lender.join(known, "base").filter(F.col("rank") <= F.col("lent")).select("conv_id", F.col("rank").alias("pos"), "len", "digest", "chars")
    return own.unionByName(lent), known.select("conv_id", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, len, chars, before, a, b, pa, pb``: every prefix with its key, its parent's key and the code points before
    its last turn. Written once."""
    placed = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest"), 256)
    limbs = [F.conv(F.substring("placed", 1 + 8 * i, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(LIMBS)]
    rows = turns.withColumn("placed", placed).select("conv_id", "pos", "len", "chars", *limbs, F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    rows = stage(rows.repartition("conv_id", "block"))
    summed = ("chars", *LIMBS)
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK turns
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in summed]).select("conv_id", "block", *[F.sum(c).over(ahead).alias(f"o_{c}") for c in summed])
    met = rows.join(blocks.filter("block > 0"), ["conv_id", "block"], "left")
    met = met.select("*", *[(F.sum(c).over(inside) + F.coalesce(f"o_{c}", F.lit(0))).alias(f"u_{c}") for c in summed])
    low = F.lit((1 << 32) - 1)

    def joined(x: Column, y: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(low), 32).bitwiseOR(y.bitwiseAND(low))

    upto = [F.col(f"u_{s}") for s in LIMBS]
    parent = [F.col(f"u_{s}") - F.col(s) for s in LIMBS]
    return stage(met.select(
        "conv_id", "pos", "len", "chars", (F.col("u_chars") - F.col("chars")).alias("before"),
        joined(*upto[:2]).alias("a"), joined(*upto[2:]).alias("b"), joined(*parent[:2]).alias("pa"), joined(*parent[2:]).alias("pb"),
    ))


class Sketch:
    """Which cells of a count-min sketch count two or more: all that the question 'is it one?' needs."""

    def __init__(self, bits: np.ndarray, width: int) -> None:
        self.bits, self.width = bits, width

    @staticmethod
    def cells(pos: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            key = a.astype(np.uint64) + mix(b.astype(np.uint64) + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            return [(mix(key + np.uint64(k + 1) * np.uint64(0xD1B54A32D192ED03)) & np.uint64(width - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]

    def maybe_shared(self, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where the estimate is one, which proves that the prefix is in one conversation."""
        out = np.ones(len(pos), bool)
        for k, cell in enumerate(self.cells(pos, a, b, self.width)):
            out &= (self.bits[k, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return out


def sketch(rows: DataFrame, n: int) -> Sketch:
    """The sketch over ``n`` prefixes: each task counts into its own, slices of them are added up, a bit a cell is fetched."""
    width = min(LARGEST, 1 << max(3, (CELLS_EACH * n - 1).bit_length()))
    piece = min(SLICE, width)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((SKETCH_ROWS, width), np.uint8)  # 0, 1, or 2 for more
        for pdf in frames:
            for k, cell in enumerate(Sketch.cells(pdf["pos"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy(), width)):
                hit, times = np.unique(cell, return_counts=True)
                counts[k, hit] = np.minimum(counts[k, hit] + np.minimum(times, 2), 2)
        for at, part in enumerate(counts.reshape(-1, piece)):
            if part.any():
                yield pd.DataFrame({"slice": [at], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros(piece, np.uint8)
        done = lambda: pd.DataFrame({"slice": [at], "bits": [np.packbits(total == 2).tobytes()]})
        for pdf in frames:
            for s, counts in zip(pdf["slice"], pdf["counts"], strict=True):
                if s != at:
                    if at is not None:
                        yield done()
                    at, total = s, np.zeros(piece, np.uint8)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counts), np.uint8), 2)
        if at is not None:
            yield done()

    partial = rows.select("pos", "a", "b").mapInPandas(count, "slice long, counts binary")
    got = partial.repartition("slice").sortWithinPartitions("slice").mapInPandas(add, "slice long, bits binary").collect()
    bits = np.zeros((SKETCH_ROWS * width // piece, piece // 8), np.uint8)
    for r in got:
        bits[r["slice"]] = np.frombuffer(r.bits, np.uint8)
    return Sketch(bits.reshape(SKETCH_ROWS, width // 8), width)


SINGLE, BOUNDARY, SHARED = 0, 1, 2


def screened(rows: DataFrame) -> DataFrame:
    """Adds ``kind``: SINGLE (in one conversation, as is its parent), BOUNDARY (its parent may be shared) or SHARED (may be)."""
    known = rows.sparkSession.sparkContext.broadcast(sketch(rows, rows.count()))

    @F.pandas_udf("int")
    def kind(pos: pd.Series, a: pd.Series, b: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
        pos = pos.to_numpy()
        mine = known.value.maybe_shared(pos, a.to_numpy(), b.to_numpy())
        parents = known.value.maybe_shared(pos - 1, pa.to_numpy(), pb.to_numpy()) | (pos == 1)
        return pd.Series(np.where(mine, SHARED, np.where(parents, BOUNDARY, SINGLE)).astype(np.int32))

    return stage(rows.withColumn("kind", kind("pos", "a", "b", "pa", "pb")), partition_by=("kind",))


def end_digests(ends: DataFrame) -> DataFrame:
    """``pos, a, b, ends_sha256`` of nodes where conversations end, from ``pos, a, b, conv_id``.

    Ids are sorted by ranges and packed where they lie; a task then runs over a node's packs in order. It holds one pack.
    """
    order = [*KEY, "conv_id"]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            part = np.arange(len(pdf)) // PACK
            got = pdf.groupby([*KEY, part], sort=False)["conv_id"]
            yield pd.DataFrame({"first": got.min(), "ids": got.agg(lambda c: ",".join(map(str, c)))}).reset_index(level=KEY)[[*KEY, "first", "ids"]]

    def hash_in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in frames:
            out = []
            for pos, a, b, ids in zip(pdf["pos"], pdf["a"], pdf["b"], pdf["ids"], strict=True):
                if (pos, a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (pos, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, "pos long, a long, b long, first long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(hash_in_order, "pos long, a long, b long, ends_sha256 string")


NOBODY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations: ``COLUMNS`` as the contract names them.

    Null roles and texts are empty, equal turns are ordered by role and text digest, repeated rows are turns of their own. Rows
    without a conv_id belong to no conversation. An empty table has no conversation, hence no root and an empty result.
    """
    turns, convs = rebuilt(*ordered_turns(conversations))
    rows = screened(prefixes(turns))
    alone, shared = rows.filter(F.col("kind") != SHARED), rows.filter(F.col("kind") == SHARED)
    group = stage(shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("len") == F.col("pos")).alias("n_ends"),
        F.max("before").alias("before"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    ))

    # What each conversation owns: from which depth on, the code points it has before that, and whether its end is a leaf.
    start = F.struct("pos", "before")
    total = F.struct((F.col("pos") + 1).alias("pos"), (F.col("before") + F.col("chars")).alias("before"))
    by_conv = rows.groupBy("conv_id").agg(F.min(F.when(F.col("kind") != SHARED, start)).alias("single"), F.max(total).alias("past"))
    by_owner = group.groupBy("conv_id").agg(F.min(start).alias("owned"), F.max(F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    own = by_conv.join(by_owner, "conv_id", "left").select(
        "conv_id", F.least("single", "owned", "past").alias("o"), (F.col("single").isNotNull() | F.coalesce("leaf", F.lit(False))).cast("long").alias("leaf"),
    )
    own = stage(own.select("conv_id", F.col("o.pos").alias("from_pos"), F.col("o.before").alias("not_owned"), "leaf"))
    spared = F.when(F.col("pos") < F.col("from_pos"), F.col("not_owned") - F.col("before")).otherwise(0)
    below = shared.join(own, "conv_id").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(spared).alias("saved_tokens"))

    border = alone.filter(F.col("kind") == BOUNDARY)
    up = [(F.col("pos") - 1).alias("pos"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = group.select(*up).unionAll(border.select(*up)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    root_id = convs.agg(F.min("conv_id").alias("c")).first().c
    if root_id is None:
        return convs.select(*[F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in COLUMNS]).limit(0)
    ends = shared.filter(F.col("len") == F.col("pos")).select(*KEY, "conv_id")
    zero = F.lit(0).cast("long")
    turnless = convs.filter("len = 0").select(zero.alias("pos"), zero.alias("a"), zero.alias("b"), "conv_id")
    digests = end_digests(ends.unionByName(turnless))

    owners = group.select(F.col("pos").alias("p"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("conv_id").alias("owner"))
    parent_of = (F.col("pos") - 1 == F.col("p")) & (F.col("pa") == F.col("x")) & (F.col("pb") == F.col("y"))
    parent = F.when(F.col("pos") == 1, F.lit(root_id)).otherwise(F.coalesce("owner", "conv_id")).alias("parent_conv_id")
    one, none = F.lit(1).cast("long"), F.lit(NOBODY)

    def row(parent_id: Column, n: Column, n_children: Column, n_leaves: Column, saved: Column, sha: Column) -> list[Column]:
        values = ["conv_id", F.col("pos"), parent_id, n, n_children, n_leaves, saved, sha]
        return [(F.col(v) if isinstance(v, str) else v).alias(c) for v, c in zip(values, COLUMNS, strict=True)]

    at_end = F.col("pos") == F.col("len")
    tail = (one, F.when(at_end, 0).otherwise(1).cast("long"), one, zero, F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none))
    tails = alone.filter(F.col("kind") == SINGLE).select(*row(F.col("conv_id"), *tail))
    borders = border.join(owners, parent_of, "left").select(*row(parent, *tail))
    # The root is a node like the others, with every conversation as a member.
    met = group.join(owners, parent_of, "left").join(below, KEY).join(children, KEY, "left").join(digests, KEY, "left")
    inner = met.select(*row(parent, F.col("n_convs"), F.coalesce("n_children", zero), F.col("n_leaves"), F.col("saved_tokens"), F.coalesce("ends_sha256", none)))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), zero.alias("pos"), zero.alias("a"), zero.alias("b"))
    of_all = own.agg(F.coalesce(F.sum("leaf"), zero).alias("n_leaves"), F.coalesce(F.sum("not_owned"), zero).alias("saved_tokens"), zero.alias("pos"))
    first = top.join(of_all, "pos").join(children, KEY, "left").join(digests, KEY, "left")
    root = first.select(*row(F.lit(None).cast("long"), F.col("n_convs"), F.coalesce("n_children", zero), F.greatest("n_leaves", one), F.col("saved_tokens"), F.coalesce("ends_sha256", none)))
    return tails.unionByName(borders).unionByName(inner).unionByName(root)
