"""Shards of near equal size by sampled splitters, with DataFrame functions only.

Documents are ordered by the hash of their text, so that equal texts stand together. A size-weighted sample of the keys gives
quantile boundaries; records are range-partitioned by them and overfull ranges are subdivided. Ranges only spread the
work: the shard follows from the exact running size over all ranges.

Splitters are a table, never a list on the driver. Keys are hashes, so the leading bits of a key name a cell that holds about one
splitter: a record finds its range by an equality join with its cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.session import stage

#: Records a range should hold, and sampled keys for each splitter.
RANGE_ROWS = 200_000
SAMPLES = 16
#: Equal texts stay together unless they fill more than this part of a shard, or more than RANGE_ROWS records.
WHOLE = 20
MAX_SPLITS = 3
#: The cell of a key: its leading bits, as many as its group needs.
CELL = "shiftright(place, 63 - bits)"


def _place(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 1)


def records(documents: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, h, d, tie``: bytes of the text plus 8, its checksum, and the hashes that order text, id and row.
    A null text is empty."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.xxhash64("doc_id").alias("d"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )


def keyed(rows: DataFrame, total: Row, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """Records with their key ``g, place``, and the table of groups ``g``.

    Group 0 is ordered by text. A text too heavy to stay whole is a group ordered by document, and a document of such a text that
    is repeated as often is one ordered by row. Heavy keys are few: 20 a shard, and one in RANGE_ROWS records.
    """
    heavy = (F.col("b") > total.bytes / n_shards / WHOLE) | (F.col("n") > RANGE_ROWS)
    weigh = (F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    texts = stage(rows.groupBy("h").agg(*weigh).filter(heavy).select("h", F.xxhash64("h", F.lit("text")).alias("by_text")))
    ids = rows.join(texts.select("h"), "h").groupBy("h", "d").agg(*weigh).filter(heavy)
    ids = stage(ids.select("h", "d", F.xxhash64("h", "d", F.lit("row")).alias("by_row")))
    marked = rows.join(texts, "h", "left").join(ids, ["h", "d"], "left")
    hashed = F.when(F.col("by_row").isNotNull(), F.col("tie")).when(F.col("by_text").isNotNull(), F.col("d")).otherwise(F.col("h"))
    group = F.coalesce("by_row", "by_text", F.lit(0).cast("long"))
    out = stage(marked.select("doc_id", "size", "text_crc32", group.alias("g"), _place(hashed).alias("place")))
    groups = texts.select(F.col("by_text").alias("g")).union(ids.select("by_row")).union(rows.sparkSession.range(1).select("id"))
    return out, groups.distinct()


def _bits(n: Column) -> Column:
    return F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int").alias("bits")


def _before(n: Column) -> Column:
    """Running sum before a cell; there is one row for about each splitter."""
    return F.coalesce(F.sum(n).over(Window.orderBy("g", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _drawn(rows: DataFrame, chance: Column, salt: int) -> DataFrame:
    """Records drawn with the given chance each, by a hash: the same ones at every run over the written table."""
    draw = F.pmod(F.xxhash64("g", "place", "doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < chance)


def _quantiles(sample: DataFrame) -> DataFrame:
    """``g, place`` of every SAMPLES-th sampled key in the order of the keys."""
    keys = stage(sample.groupBy("g", "place").agg(F.count(F.lit(1)).alias("n")))
    bits = keys.groupBy("g").agg(_bits(F.sum("n") / SAMPLES))
    laid = keys.join(bits, "g").withColumn("cell", F.expr(CELL))
    starts = laid.groupBy("g", "cell").agg(F.sum("n").alias("s")).select("g", "cell", _before(F.col("s")).alias("before"))
    run = Window.partitionBy("g", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = laid.join(starts, ["g", "cell"]).withColumn("upto", F.col("before") + F.sum("n").over(run))
    return ranked.filter(F.floor(F.col("upto") / SAMPLES) > F.floor((F.col("upto") - F.col("n")) / SAMPLES)).select("g", "place")


def _ranged(rows: DataFrame, groups: DataFrame, splitters: DataFrame) -> DataFrame:
    """Adds ``rid``, the number of splitters not above the key."""
    counts = splitters.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    bits = stage(groups.join(counts, "g", "left").select("g", _bits(F.coalesce("m", F.lit(0)))))
    held = splitters.join(bits, "g").groupBy("g", F.expr(CELL).alias("cell")).agg(F.sort_array(F.collect_list("place")).alias("at"))
    grid = bits.select("g", F.explode(F.expr("sequence(0L, shiftleft(1L, bits) - 1)")).alias("cell"))
    at = F.coalesce("at", F.array().cast("array<bigint>"))
    cells = grid.join(held, ["g", "cell"], "left").select("g", "cell", at.alias("at"))
    cells = stage(cells.select("g", "cell", "at", _before(F.size("at")).alias("base")))
    placed = rows.join(bits, "g").withColumn("cell", F.expr(CELL)).join(cells, ["g", "cell"])
    rid = F.col("base") + F.size(F.filter("at", lambda s: s <= F.col("place")))
    return placed.select(*rows.columns, rid.cast("long").alias("rid"))


def ranges(rows: DataFrame, groups: DataFrame, total: Row, range_rows: int = RANGE_ROWS, least: int = 1) -> DataFrame:
    """Adds ``rid``, the number of the record's range, to a written table with ``g, place, doc_id, size``; the result is written too."""
    parts = max(least, math.ceil(total.n / range_rows))
    splitters = stage(_quantiles(_drawn(rows, F.lit(SAMPLES * parts / total.bytes) * F.col("size"), 0)))
    limit = 2 * max(range_rows, math.ceil(total.n / parts))
    for salt in range(1, MAX_SPLITS + 1):
        ranged = stage(_ranged(rows, groups, splitters))
        # Ranges are equal in bytes; those of many short texts hold too many records.
        over = stage(ranged.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("rid"))
        if salt == MAX_SPLITS or not over.limit(1).count():
            break
        inside = ranged.join(over, "rid", "left_semi")
        splitters = stage(splitters.union(_quantiles(_drawn(inside, F.lit(SAMPLES / range_rows), salt))).distinct())
    return ranged


def shards(documents: DataFrame, n_shards: int = 24, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per document row, under the law ``bytes``.

    Shards are consecutive stretches of the order, each of an n-th of the bytes; a document, or a group of equal texts that
    fills at most a twentieth of a shard and RANGE_ROWS records, goes where its middle falls, so shards differ from the mean by no
    more than that or the longest document. Larger groups are split by document, and a document repeated that often by row.
    ``slot`` counts from 0 in the order without gaps. ``grown_shard`` is null: this law does not promise it. A null text is
    empty; a null doc_id is an id like others; repeated rows take slots of their own. An empty table gives an empty result.
    """
    rows = stage(records(documents))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    rows, groups = keyed(rows, total, n_shards)
    ranged = ranges(rows, groups, total, range_rows, n_shards)
    sums = ranged.groupBy("rid").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sums.select("rid", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("rid").orderBy("g", "place", "doc_id", "size")
    unit = Window.partitionBy("rid", "g", "place")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(starts, "rid").withColumn("upto", F.sum("size").over(run)).withColumn("at", F.row_number().over(inside))
    middle = F.col("b0") + F.min(F.col("upto") - F.col("size")).over(unit) + F.sum("size").over(unit) / 2
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(total.bytes)))).cast("int")
    placed = stage(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("at") - 1).alias("rank")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
