"""Quality classifier: random-indexing word vectors pooled per document, then a small two-layer network.

Every token has a sparse random index vector. A token's word vector is the sum of the index vectors of its neighbours over
the whole corpus; it is gathered in one pass and summed by Spark. Documents are the mean of their tokens' vectors. A network
of one hidden layer is fitted on a bounded sample of labelled documents and its probabilities are calibrated by temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import CHUNK_CHARS, WordHasher, in_chunks, mix, texts_of

BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 4
OFFSETS = (1, 2)
#: Pooled besides the mean: how alike and how often equal neighbours are, the length of the mean, the number of tokens.
EXTRA = 4
HIDDEN = 24
#: Labelled documents that the network is fitted and calibrated on; everything is scored.
MAX_LABELLED = 8_000
THRESHOLD = 0.7
#: Token vectors held at a time.
STEP = 1 << 16
#: Characters hashed at a time: a worker holds some thirty bytes for each. A longer text is hashed alone.
HASHED_CHARS = 1 << 18


class RunHasher(WordHasher):
    """Hashes of runs of letters, of digits and of other signs; case is kept, blanks separate."""

    def __init__(self) -> None:
        super().__init__("blank")
        self.table = np.arange(1, 257, dtype=np.uint64)
        self.kind = np.full(256, 3, np.uint8)
        self.kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
        self.kind[0x30:0x3A] = 2
        self.kind[[0x20, *range(0x09, 0x0E)]] = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        piece = np.cumsum([len(t) for t in texts]) // HASHED_CHARS
        border = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
        parts = [self._some(texts[lo:hi]) for lo, hi in zip(border, border[1:])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self._grow(len(data))
        kind = self.kind[data]
        new = np.flatnonzero(np.diff(kind, prepend=0) != 0)
        end = np.concatenate([new[1:], [len(data)]])
        word = kind[new] > 0
        start, end = new[word], end[word]
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.table[data] * self.powers[: len(data)], out=total[1:])
            value = mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        border = np.concatenate([[0], np.cumsum([len(b) + 1 for b in raw])])
        return value, np.diff(np.searchsorted(start, border))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero components of every bucket's index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_vectors(documents: DataFrame) -> DataFrame:
    """``bucket, n, v0 ...``: token counts and summed index vectors of neighbours, over all documents.

    A task adds up its own partition in a table of fixed size and emits the buckets it met; Spark sums them map-side first.
    """
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, (position, sign) = RunHasher(), index_vectors()
        table, seen = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
        for pdf in in_chunks(frames):
            hashes, counts = hasher(texts_of(pdf["text"]))
            b, doc = _buckets(hashes), np.repeat(np.arange(len(counts)), counts)
            seen += np.bincount(b, minlength=BUCKETS)
            for o in OFFSETS:
                same = doc[o:] == doc[:-o]
                left, right = b[:-o][same], b[o:][same]
                for mine, other in ((left, right), (right, left)):
                    at = (mine[:, None] * DIMENSIONS + position[other]).ravel()
                    table += np.bincount(at, sign[other].ravel(), len(table))
        met = np.flatnonzero(seen)
        out = pd.DataFrame(table.reshape(BUCKETS, DIMENSIONS)[met].astype(np.int64), columns=names)
        out.insert(0, "bucket", met)
        out.insert(1, "n", seen[met])
        yield out

    schema = "bucket long, n long, " + ", ".join(f"{c} long" for c in names)
    parts = documents.select("text").mapInPandas(run, schema)
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def collected_vectors(table: DataFrame) -> np.ndarray:
    """Unit word vectors as a BUCKETS x DIMENSIONS table; its size is fixed by the parameters."""
    rows = table.toPandas()
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    raw = rows.drop(columns=["bucket", "n"]).to_numpy(np.float64)
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    out[rows["bucket"].to_numpy(np.int64)] = raw / np.where(norm > 0, norm, 1)
    return out


class Pooler:
    """Mean word vector of every text and EXTRA pooled figures; a text without tokens is the zero vector."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.hasher = vectors, RunHasher()

    def _some(self, texts: list[str]) -> np.ndarray:
        hashes, counts = self.hasher(texts)
        b = _buckets(hashes)
        # A document that goes on into the next step is added up.
        out = np.zeros((len(texts), DIMENSIONS))
        doc = np.repeat(np.arange(len(texts)), counts)
        alike, equal = np.zeros(len(texts)), np.zeros(len(texts))
        for lo in range(0, len(b), STEP):
            d, mine = doc[lo : lo + STEP + 1], b[lo : lo + STEP + 1]  # one token more, for the last pair
            vectors = self.vectors[mine]
            pair = np.where(d[1:] == d[:-1], np.einsum("ij,ij->i", vectors[1:], vectors[:-1]), 0)
            alike += np.bincount(d[:-1], pair, len(texts))
            equal += np.bincount(d[:-1], (d[1:] == d[:-1]) & (mine[1:] == mine[:-1]), len(texts))
            d = d[:STEP]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            out[d[first]] += np.add.reduceat(vectors[:STEP], first, axis=0)
        out /= np.maximum(counts, 1)[:, None]
        pairs = np.maximum(counts - 1, 1)
        return np.column_stack([out, alike / pairs, equal / pairs, np.linalg.norm(out, axis=1), np.log1p(counts)])

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, piece, size = [], [], 0
        for t in texts:
            piece.append(t)
            size += len(t)
            if size > CHUNK_CHARS:
                out.append(self._some(piece))
                piece, size = [], 0
        if piece or not out:
            out.append(self._some(piece) if piece else np.zeros((0, DIMENSIONS + EXTRA)))
        return np.concatenate(out)


@dataclass
class Network:
    """tanh layer and logit; probabilities are sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
        """Log loss, full batch, Adam. Both classes weigh alike, so a rare one is learnt too."""
        rng = np.random.default_rng(seed)
        scale = x.std(axis=0) + 1e-6
        net = cls(x.mean(axis=0), scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
        z = (x - net.mean) / scale
        share = np.bincount(y, minlength=2) / len(y)
        weight = np.where(y == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)) / len(y)
        moment = [np.zeros_like(p, dtype=float) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
        square = [m.copy() for m in moment]
        for t in range(1, steps + 1):
            h = np.tanh(z @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
            d = (p - y) * weight
            dh = np.outer(d, net.w2) * (1 - h * h)
            grads = [z.T @ dh + decay * net.w1, dh.sum(axis=0), h.T @ d + decay * net.w2, np.array([d.sum()])]
            steps_ = []
            for i, g in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                steps_.append(rate * moment[i] / (1 - 0.9**t) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - steps_[0], net.b1 - steps_[1], net.w2 - steps_[2], net.b2 - float(steps_[3][0])
        return net

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Temperature of least log loss on rows the network was not fitted on, by sectioning its logarithm."""
        z = self.logit(x)

        def loss(log_t: float) -> float:
            m = z / np.exp(log_t) * (2 * y - 1)
            return float(np.logaddexp(0, -m).mean())

        low, high = np.log(0.05), np.log(20.0)
        for _ in range(40):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the labels of which are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network | None

    def scorer(self, spark):  # noqa: ANN001, ANN201
        model = spark.sparkContext.broadcast((self.vectors, self.network))

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vectors, network = model.value
            pool = Pooler(vectors)
            for text in parts:
                yield pd.Series(network(pool(texts_of(text))) if network is not None else np.full(len(text), 0.5))

        return score


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Word vectors from all documents; the network from at most ``max_labelled`` labelled ones that are not held out.

    The sample is drawn by a hash of the id. Three quarters fit the network, the rest its temperature. Labels other than 0
    and 1 and labels without a document are left out; without any label there is no network and every score is 0.5.
    """
    vectors = collected_vectors(word_vectors(documents))
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = marked.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    # The limit bounds this side at max_labelled rows of two numbers.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = Pooler(shared.value)
        for pdf in in_chunks(frames):
            yield pd.DataFrame({"doc_id": list(pdf["doc_id"]), "quality": pdf["quality"], "x": list(pool(texts_of(pdf["text"])))})

    got = rows.mapInPandas(pooled, "doc_id long, quality int, x array<double>").toPandas()
    if not len(got):
        return Classifier(vectors, None)
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    x, y = np.stack(got["x"].to_numpy()), got["quality"].to_numpy(np.int64)
    fit = mix(got["doc_id"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(4) != 0
    if fit.sum() == 0 or (~fit).sum() == 0:
        fit = np.ones(len(y), bool)
        network = Network.fit(x, y)
    else:
        network = Network.fit(x[fit], y[fit])
        network.calibrate(x[~fit], y[~fit])
    return Classifier(vectors, network)


def scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document row, from the text alone.

    A null text is empty; an empty one is scored like any other. Repeated rows get equal scores. An empty table trains on
    nothing and gives an empty result.
    """
    score = train(documents, labels).scorer(documents.sparkSession)
    out = documents.select("doc_id", "text").withColumn("score", score("text"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``; columns as they came."""
    score = train(documents, labels).scorer(documents.sparkSession)
    names = [F.col(f"`{c}`") for c in documents.columns]
    return documents.withColumn("__score", score("text")).filter(F.col("__score") >= threshold).select(*names)
