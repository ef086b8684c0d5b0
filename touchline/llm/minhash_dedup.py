"""MinHash near-duplicates by a chosen-path set similarity join.

Every document is a set of word shingles. Trees of nodes are grown over the distinct sets: a node names a few coordinates of
the signature, and a member goes down one branch for each of them, chosen by its minwise token there. Small nodes, and
the nodes of the last level, are compared exhaustively by sketch; several independent trees bring the recall to the target.
What the sketches connect is then confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import WordHasher, in_chunks, mix, texts_of
from touchline.llm.components import components
from touchline.llm.groups import links
from touchline.session import stage

COORDINATES = 128
#: Members up to which a node is compared exhaustively instead of branching again.
LEAF = 200
DEPTH = 3
BRANCH = 2
#: Sets compared exactly in one piece.
SET_BLOCK = 128

#: Key of a row of the documents, whatever its doc_id.
ROW = "__document_row"

SIGNATURES = f"{ROW} long, doc_id string, n_shingles long, k binary, sig array<int>, sketch binary"


def trees_for(recall: float, similarity: float, branch: int = BRANCH, depth: int = DEPTH) -> int:
    """Independent trees after which a pair of that similarity has met in a common node with the wanted probability."""
    one = (1 - (1 - similarity) ** branch) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words than ``size`` has its whole sequence as one."""
    out, at = [], 0
    ends = np.cumsum(counts)
    n = len(hashes)
    rolled = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n >= size:
            rolled = hashes[: n - size + 1]
            for j in range(1, size):
                rolled = mix(rolled) + hashes[j : n - size + 1 + j]
            rolled = mix(rolled + np.uint64(size))
        for end, count in zip(ends, counts, strict=True):
            if count >= size:
                out.append(np.unique(rolled[at : end - size + 1]))
            elif count:
                h = hashes[at : at + 1]
                for j in range(1, count):
                    h = mix(h) + hashes[at + j : at + j + 1]
                out.append(mix(h + np.uint64(count)))
            else:
                out.append(np.zeros(0, np.uint64))
            at = end
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share, whatever their order."""
    with np.errstate(over="ignore"):
        a, b = mix(s + np.uint64(1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


class Signer:
    """Minwise values of a set under ``n`` fixed random orders."""

    def __init__(self, n: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        h = (s >> np.uint64(32)).astype(np.uint32)
        low = None
        for i in range(0, len(h), 1024):  # a slice of the table stays in the cache
            part = (h[i : i + 1024, None] * self.a + self.b).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low


def signatures(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """ROW, ``doc_id, n_shingles, k`` (128-bit name of the set), ``sig, sketch``; without words the last three are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, signer = WordHasher("blank"), Signer(COORDINATES)
        for pdf in in_chunks(frames):
            sets = shingle_sets(*hasher(texts_of(pdf["text"])), shingle)
            sigs = [signer(s) if len(s) else None for s in sets]
            yield pd.DataFrame({
                ROW: pdf[ROW], "doc_id": list(pdf["doc_id"]), "n_shingles": [len(s) for s in sets], "k": [set_key(s) if len(s) else None for s in sets],
                "sig": [None if x is None else x.view(np.int32) for x in sigs],
                "sketch": [None if x is None else mix(x.astype(np.uint64)).astype(np.uint8).tobytes() for x in sigs],
            })

    return documents.select(ROW, F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SIGNATURES).withColumn("doc_id", F.col("doc_id").cast("long"))


def _children(rows: DataFrame, branch: int) -> DataFrame:
    """Next nodes of ``path, k, sig``: the node's coordinates follow from its path, so members agree on them."""
    picks = [F.pmod(F.xxhash64("path", F.lit(j)), F.lit(COORDINATES)).cast("int") for j in range(branch)]
    at = rows.select("path", "k", "sig", F.explode(F.array(*picks)).alias("c"))
    return at.select(F.xxhash64("path", "c", F.element_at("sig", F.col("c") + 1)).alias("path"), "k").distinct()


def nodes(reps: DataFrame, trees: int, branch: int = BRANCH, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """``g, k``: members of every node that is compared exhaustively. ``reps`` has ``k, sig``, one row per distinct set."""
    roots = F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees)])
    rows, out = reps.select(F.explode(roots).alias("path"), "k", "sig"), None
    for level in range(1, depth + 1):
        met = _children(rows, branch)
        if level == 1:  # lazily twice would hash every signature twice
            met = stage(met)
        sizes = met.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = stage(met.join(sizes, "path"))
        done = met if level == depth else met.filter(F.col("n") <= leaf)
        done = done.select(F.col("path").alias("g"), "k")
        out = done if out is None else out.union(done)
        if level == depth:
            break
        wide = met.filter(F.col("n") > leaf)
        if not wide.limit(1).count():
            break
        rows = wide.select("path", "k").join(reps.select("k", "sig"), "k")
    return out


class SketchCompare:
    """Agreement of sketches less the agreement of a pair some standard deviations below the threshold."""

    def __init__(self, similarity: float, deviations: float = 4.5) -> None:
        low = similarity - deviations * math.sqrt(similarity * (1 - similarity) / COORDINATES)
        self.least = math.floor(COORDINATES * low)

    def __call__(self, one: bytes, others: list[bytes]) -> np.ndarray:
        table = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), COORDINATES)
        return (table == np.frombuffer(one, np.uint8)).sum(axis=1) - self.least


class SetCompare:
    """percent * |union| <= 100 * |intersection|, in integers, on full sets."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, one: bytes, others: list[bytes]) -> np.ndarray:
        a = np.frombuffer(one, np.uint64)
        out = np.full(len(others), -1.0)
        for i, raw in enumerate(others):
            b = np.frombuffer(raw, np.uint64)
            small, large = min(len(a), len(b)), max(len(a), len(b))
            if 100 * small < self.percent * large:
                continue
            both = np.concatenate([a, b])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * same - self.percent * (len(a) + len(b) - same)
        return out


def full_sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``k, g, payload``: the sorted shingle hashes of the wanted sets (``doc_id, k, g``), from the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher("blank")
        for pdf in in_chunks(frames):
            sets = shingle_sets(*hasher(texts_of(pdf["text"])), shingle)
            # A doc_id may stand on several texts: only the text whose set is meant goes on.
            mine = [len(s) > 0 and set_key(s) == k for s, k in zip(sets, pdf["k"], strict=True)]
            yield pd.DataFrame({"k": pdf["k"][mine], "g": pdf["g"][mine], "payload": [s.tobytes() for s, m in zip(sets, mine, strict=True) if m]})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["doc_id"])).select("k", "g", "text")
    return met.mapInPandas(run, "k binary, g binary, payload binary").dropDuplicates(["k"])


def keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn(ROW, F.monotonically_increasing_id())


def near_duplicates(documents: DataFrame, percent: int = 85, shingle: int = 3, recall: float = 0.99999) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their distinct word shingles, confirmed on the full
    sets. Equal sets are one row from the start, so a group of copies of any size costs a map-side minimum. ``component_id``
    is the smallest doc_id reachable, ``kept`` tells whether it is the row's own. Texts without words (null, empty, blanks)
    have an empty set and link with nothing. Rows that share a doc_id each get a row; a null doc_id takes part, but names a
    component only if no other member does. A pair at the threshold is missed with a probability below ``1 - recall``.
    """
    return row_components(keyed(documents), percent, shingle, recall).drop(ROW, "first")


def row_components(documents: DataFrame, percent: int, shingle: int, recall: float = 0.99999) -> DataFrame:
    """As ``near_duplicates``, with the ROW of ``documents`` and ``first``: whether it is the one row that stands for its component,
    the one of the smallest id (null last) and ROW. A text without words stands for itself."""
    signed = stage(signatures(documents, shingle))
    reps = stage(signed.filter(F.col("k").isNotNull()).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    trees = trees_for(recall, percent / 100)
    met = nodes(reps, trees).join(reps.select("k", F.col("sketch").alias("payload")), "k")
    close = components(links(met, SketchCompare(percent / 100), LEAF))
    wanted = close.join(reps.select("k", "doc_id"), close["node"] == reps["k"]).select("doc_id", "k", F.col("root").alias("g"))
    sets = stage(full_sets(documents, wanted, shingle))
    linked = components(links(sets, SetCompare(percent), SET_BLOCK))
    named = signed.select(ROW, "doc_id", "n_shingles", "k").join(linked.select(F.col("node").alias("k"), "root"), "k", "left")
    named = named.withColumn("c", F.coalesce("root", "k")).drop("root", "k")
    alone = named.filter(F.col("c").isNull()).withColumn("component_id", F.col("doc_id")).withColumn("first", F.lit(True))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", ROW)
    smallest = named.filter(F.col("c").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(order)[ROW].alias("keeper"))
    member = named.filter(F.col("c").isNotNull()).join(smallest, "c").withColumn("first", F.col(ROW) == F.col("keeper")).drop("keeper")
    out = member.unionByName(alone)
    return out.select(ROW, "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")


def clean(documents: DataFrame, percent: int = 85, shingle: int = 3) -> DataFrame:
    """One row of every component of linked documents; columns as they came.

    Rows are judged one by one, by a key that is written once with them: a row with a null or shared doc_id goes only if its own
    text is a copy. Of rows that repeat one doc_id and text a single one stays. Texts without words all stay.
    """
    docs = stage(keyed(documents))
    gone = row_components(docs, percent, shingle).filter(~F.col("first")).select(ROW)
    return docs.join(gone, ROW, "left_anti").select(documents.columns)
