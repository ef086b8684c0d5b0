"""Shared column expressions and numpy helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value of the contract: a word is a run of anything but ASCII controls, blanks, punctuation and capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Texts handled together inside a task, in characters: bounds the numpy buffers, not what is read.
CHUNK_CHARS = 2_000_000


def lower_ascii(text: str | Column) -> Column:
    """A-Z lower-cased, everything else untouched; null becomes empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns an operator reads; columns it does not know never meet its own names."""
    return df.select(*names)


def byte_table(separators: str) -> np.ndarray:
    """256 byte codes: 0 for a separator, else the byte with A-Z lower-cased, plus one."""
    table = np.arange(1, 257, dtype=np.uint64)
    table[ord("A") : ord("Z") + 1] += 32
    for lo, hi in SEPARATORS[separators]:
        table[lo : hi + 1] = 0
    return table


#: Byte ranges that separate words. Both sets are ASCII, so splitting UTF-8 bytes equals splitting characters.
SEPARATORS = {
    "blank": [(0x20, 0x20), (0x09, 0x0D)],
    "word": [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)],
}

_P = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word's polynomial over its bytes is a difference of running sums, moved to position 0 with the inverse powers,
    then mixed. Equal words get equal hashes wherever they stand.
    """

    def __init__(self, separators: str) -> None:
        self.table = byte_table(separators)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 2 * len(self.powers))
            with np.errstate(over="ignore"):
                up, down = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
                up[0] = down[0] = 1
                self.powers, self.inverse = np.cumprod(up), np.cumprod(down)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(b) for b in raw), np.int64, len(raw))
        codes = self.table[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        self._grow(len(codes))
        inside = codes != 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * self.powers[: len(codes)], out=total[1:])
            value = mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        border = np.concatenate([[0], np.cumsum(sizes + 1)])
        return value, np.diff(np.searchsorted(start, border))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def in_chunks(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """Pieces of about CHUNK_CHARS characters; a longer text is a piece of its own."""
    for pdf in frames:
        if not len(pdf):
            continue
        size = pdf[column].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
        piece = np.cumsum(size) // CHUNK_CHARS
        for _, rows in pdf.groupby(piece, sort=False):
            yield rows.reset_index(drop=True)


def texts_of(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]
