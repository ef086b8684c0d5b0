"""Product codes of vectors by member-resident Lloyd.

A vector is cut into parts; a part lives with the owner of its (position, entry, salt). Owners add up their resident members,
the sums of an entry's owners give its new value, and each owner assigns its residents anew: parts that keep their entry stay
in the file they are in, only parts that change it go through the next shuffle. All arithmetic is on integers, so results
do not depend on the order of rows or on the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

#: Fixed values of the contract.
SCALE, POSITIONS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Arrivals of one entry that share an owner; more of them get further salts.
OWNED = 256
#: Scaled components are held within this bound, distances within the next, so that sums fit their types.
LARGEST, FARTHEST = 1 << 52, 1 << 60

_ROW = "row long, vec_id long, label int, position int, part array<long>"
STATE = f"{_ROW}, entry int"
ASSIGNED = f"{STATE}, distance long, moved boolean"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def kept(embeddings: DataFrame) -> DataFrame:
    """``row, vec_id, label, x``: the usable vectors in integer components, written once so that ``row`` stays what it is."""
    floored = lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    usable = embeddings.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: _finite(v.cast("double"))))
    out = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", floored).alias("x"))
    return stage(out.withColumn("row", F.monotonically_increasing_id()))


def _cut(x: Column, width: int) -> Column:
    """``POSITIONS`` parts of ``width``; a vector shorter than the longest one goes on with zeros."""
    full = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(POSITIONS * width) - F.size(x)))
    return F.array(*[F.slice(full, p * width + 1, width) for p in range(POSITIONS)])


def first_books(vectors: DataFrame, width: int) -> np.ndarray:
    """``[position, entry, component]`` of the smallest ids (null last, ties by components): at most ``ENTRIES`` rows are fetched."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select(_cut(F.col("x"), width).alias("parts")).collect()
    return np.array([r.parts for r in first], np.int64).reshape(len(first), POSITIONS, width).transpose(1, 0, 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry; ties go to the lower index. Exact for components of any size."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    room = x.shape[1] * (2 * top) ** 2
    kind = np.float64 if room < 1 << 53 else np.int64 if room < 1 << 62 else object
    entry, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    b = book.astype(kind)
    square = (b * b).sum(axis=1)
    for at in range(0, len(x), 4096):
        a = x[at : at + 4096].astype(kind)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + square[None, :]
        entry[at : at + 4096] = best = np.argmin(d, axis=1)
        distance[at : at + 4096] = np.minimum(d[np.arange(len(a)), best], FARTHEST)
    return entry, distance


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("part"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assigned(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds the nearest ``entry``, its ``distance``, and ``moved``: whether it is another one than the part's owner holds."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            x, position, before = _matrix(batch, width), cols["position"].to_numpy(), cols["entry"].to_numpy(zero_copy_only=False)
            entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                entry[at], distance[at] = nearest(x[at], books[p])
            cols |= {"entry": pa.array(entry.astype(np.int32)), "distance": pa.array(distance), "moved": pa.array(entry != before)}
            yield pa.RecordBatch.from_pydict(cols)

    return parts.mapInArrow(run, ASSIGNED)


def placed(parts: DataFrame) -> DataFrame:
    """The parts with their new owners. An entry's arrivals are dealt to as many salts as their number asks for."""
    arrivals = parts.groupBy("position", "entry").agg(F.ceil(F.count(F.lit(1)) / OWNED).alias("salts"))
    # One row an entry: at most POSITIONS * ENTRIES rows of three numbers.
    met = parts.join(F.broadcast(arrivals), ["position", "entry"]).withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
    return stage(met.repartition("position", "entry", "salt").select(*_names(STATE)))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def updated(books: np.ndarray, residents: DataFrame) -> np.ndarray:
    """Entries replaced by the floored mean of their parts; unused ones stay.

    Every task adds up its residents, a row for each entry it holds a part of; fetched are the sums, as many as a codebook has
    components. Sums are exact decimals.
    """
    n_positions, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(n_positions * n_entries, np.int64), np.zeros((n_positions * n_entries, width), object)
        for batch in batches:
            x = _matrix(batch, width)
            entry = batch.column("position").to_numpy().astype(np.int64) * n_entries + batch.column("entry").to_numpy()
            order = np.argsort(entry, kind="stable")
            owned, start = np.unique(entry[order], return_index=True)
            if len(owned):
                # Within LARGEST, and batches are bounded by the session: no overflow below 2,000 rows at a time.
                for lo in range(0, len(order), 2000):
                    some, at = np.unique(entry[order[lo : lo + 2000]], return_index=True)
                    total[some] += np.add.reduceat(x[order[lo : lo + 2000]], at, axis=0).astype(object)
                count[owned] += np.diff(np.append(start, len(order)))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(used.astype(np.int32), pa.int32()), "n": pa.array(count[used]),
            "sums": pa.array([[str(v) for v in total[u]] for u in used], pa.list_(pa.string())),
        })

    sums = residents.select("position", "entry", "part").mapInArrow(run, "part int, n long, sums array<string>")
    each = sums.select("part", "n", F.posexplode("sums").alias("i", "v"))
    got = each.groupBy("part", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    new = books.reshape(n_positions * n_entries, width).copy()
    for r in got:
        new[r.part, r.i] = int(r.v) // r.n
    return new.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``row, vec_id, label, position, entry, distance`` of every part, and the codebooks.

    Null vectors and such with null or non-finite components are left out. Components beyond 2**52 after scaling count as that
    bound. Parts are a fourth of the longest vector's length, rounded up. Repeated rows are vectors of their own.
    """
    vectors = kept(embeddings)
    width = -(-(vectors.agg(F.max(F.size("x"))).first()[0] or 0) // POSITIONS)
    books = first_books(vectors, width)
    parts = vectors.select("row", "vec_id", "label", F.posexplode(_cut(F.col("x"), width)).alias("position", "part"))
    names = _names(STATE)
    now = stage(assigned(parts.withColumn("entry", F.lit(-1)).select(*names), books))
    residents = placed(now)
    for last in [False] * (rounds - 1) + [True]:
        books = updated(books, residents)
        now = stage(assigned(residents, books), partition_by=() if last else ("moved",))
        if not last:
            residents = now.filter(~F.col("moved")).select(*names).unionByName(placed(now.filter("moved")))
    return now.select("row", "vec_id", "label", "position", "entry", "distance"), books


def codes(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per usable vector.

    ``label_error`` adds up the errors of equal labels, nulls together. Errors end at 2**62, far beyond any exact vector's.
    Without usable vectors the result is empty.
    """
    parts, books = compress(embeddings)
    hexed = F.transform(F.sort_array(F.collect_list(F.struct("position", "entry"))), lambda p: F.lpad(F.lower(F.hex(p["entry"])), 2, "0"))
    rows = parts.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_join(hexed, "").alias("code"), F.sum("distance").alias("error"))
    rows = stage(rows)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    of_label = rows.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return rows.join(of_label, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"),
    )
