"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import UPPER

FEATURES = 1 << 14
GRAMS = (3, 4, 5)
#: Bytes of addresses whose windows are held at a time.
STEP = 1 << 18


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

#: The labelled table: words that hosts and paths of either kind are made of, and urls written with them.
ALLOWED = tuple(
    f"https://{h}/{p}"
    for h in ("docs.python.org", "www.university.edu", "en.wikipedia.org", "news.publisher.com", "blog.engineer.dev", "library.museum.org", "recipes.kitchen.com", "www.example.com", "shop.bookstore.com")
    for p in ("en/article/12", "en/304", "de/85/", "fr/7731.html", "tutorial/introduction.html", "2021/05/history-of-science", "about/contact", "page/3?ref=x", "research/paper-14", "")
)
BLOCKED = tuple(
    f"http://{h}/{p}"
    for h in ("casino-bonus.win", "cheap-pills24.biz", "xxx-cams.adult", "free-loans.click", "hot-dating.top", "win-prizes.xyz", "replica-watches.shop", "crack-keygen.download", "bet365-slots.club")
    for p in ("casino/jackpot", "buy-viagra-cheap", "porn/videos", "free-money-now", "sexy-singles", "claim-prize?aff=77", "discount-replica", "warez/keygen.exe", "poker-slots-bonus", "")
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; of equally long ones a blocking one, then by name."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):  # later ones win
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _crc_table() -> np.ndarray:
    """Remainders of all bytes under the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _pieces(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row numbers of whole rows, STEP bytes or a little more at a time; a longer row is a piece of its own."""
    held, size = [], 0
    for i, r in enumerate(raw):
        if held and size + len(r) > STEP:
            yield np.frombuffer(b"".join(raw[held[0] : i]), np.uint8), np.repeat(held, [len(raw[j]) for j in held])
            held, size = [], 0
        held.append(i)
        size += len(r)
    if held:
        yield np.frombuffer(b"".join(raw[held[0] :]), np.uint8), np.repeat(held, [len(raw[j]) for j in held])


def _grams(data: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct ``row * FEATURES + feature``: CRC-32 of every window of GRAMS bytes within a row, all windows at once."""
    found = [np.zeros(0, np.int64)]
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        crc = np.full(m, 0xFFFFFFFF, np.uint32)
        for k in range(n):
            crc = _CRC[(crc ^ data[k : k + m]) & 255] ^ (crc >> 8)
        inside = row[:m] == row[n - 1 :]
        found.append(row[:m][inside] * FEATURES + (~crc[inside] % np.uint32(FEATURES)).astype(np.int64))
    return np.unique(np.concatenate(found))


def gram_table(addresses: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features of the distinct hashed character n-grams of addresses (host and path in one string, ends marked)."""
    keys = [np.zeros(0, np.int64)]
    for data, row in _pieces([f"^{a}$".encode("utf-8", "surrogatepass") for a in addresses]):
        # Windows that begin in a slice are taken with it, so a very long row is worked off slice by slice.
        width = max(GRAMS) - 1
        parts = [_grams(data[i : i + STEP + width], row[i : i + STEP + width]) for i in range(0, len(data), STEP)]
        keys.append(parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)))
    found = np.concatenate(keys)
    return found // FEATURES, found % FEATURES


_PARTS = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")


def address_of(url: str) -> str:
    m = _PARTS.match(url)
    return m[1].lower() + m[2] if m else ""


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __call__(self, address: str) -> float:
        """Probability of ``block``."""
        return float(self.judge([address])[0])

    def judge(self, addresses: list[str]) -> np.ndarray:
        """Probability of ``block`` of every address, worked out for all of them together."""
        row, feature = gram_table(addresses)
        n = np.bincount(row, minlength=len(addresses))
        z = self.bias + np.bincount(row, self.weights[feature], len(addresses)) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(allowed: tuple[str, ...] = ALLOWED, blocked: tuple[str, ...] = BLOCKED, steps: int = 300, rate: float = 1.0, decay: float = 1e-3) -> Model:
    """Gradient descent on the log loss over the labelled table, on the driver: the table is a parameter of fixed size."""
    rows = [*allowed, *blocked]
    y = np.repeat([0.0, 1.0], [len(allowed), len(blocked)])
    row, at = gram_table([address_of(u) for u in rows])
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))
    weights, bias = np.zeros(FEATURES), 0.0
    for _ in range(steps):
        z = bias + np.bincount(row, weights[at], len(rows)) * value
        d = (1 / (1 + np.exp(-z)) - y) / len(rows)
        weights -= rate * (np.bincount(at, (d * value)[row], FEATURES) * len(rows) / 10 + decay * weights)
        bias -= rate * d.sum()
    return Model(weights, bias)


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` per page row; ``score`` is the model's probability of ``block``.

    A null url, or one without ``://``, has empty host and path, which the model judges like any other. Every row is judged
    on its own; only ``page_id`` and ``url`` are read.
    """
    model = model or train()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for addresses in parts:
            yield pd.Series(shared.value.judge(list(addresses)))

    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("score", score(F.concat("host", "path"))).withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__rule.name").alias("rule"), F.coalesce("__rule.verdict", by_model).alias("verdict"), "score")
