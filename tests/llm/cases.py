"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = (
    "row", "k", "g", "key", "size", "copies", "parts", "label", "path", "n", "rid", "shard", "score", "root", "c", "spans", "block", "tokens",
    "rank", "h", "sub", "big", "__row", "node", "u", "v", "items", "start", "end", "kind", "template", "payload",
)
VOCABULARY = [a + b for a in ("the", "an", "on", "re", "ed", "in", "ha", "st") for b in ("er", "ing", "ly", "ble", "tion", "ou", "nd", "es", "wh")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, sentence(rng, rng.randint(1, 120)), "en", f"s{i % 3 if i % 2 else 0}", 0) for i in range(n)]
    out += [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s1", 3), (103, "One", "en", None, 3), (104, "é ü ß", "de", "s1", 5),
        (None, "a row without an id " + sentence(rng, 20), "en", "s2", 1), (105, sentence(rng, 30_000), "en", "s0", 1), (106, "x" * 200_000, "en", "s0", 1),
        (107, "\U0001f600 \U0001f600 emoji 😀😀 text", "en", "s2", 1), (-5, "negative id", "en", "s2", 1),
    ]
    out += [out[3], out[3], out[7]]  # repeated rows
    base = sentence(rng, 300).split()
    for i in range(30):  # a group of near copies, and of exact ones
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        out.append((200 + i, " ".join(copy), "en", "s0", 1))
        out.append((300 + i, " ".join(base), "en", "s0", 1))
    rng.shuffle(out)
    return [(i, t, a, s, None if t is None else len(t)) for i, t, a, s, _ in out]


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def with_clashes(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


def as_set(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
