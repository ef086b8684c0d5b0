"""Mixing sources to target weights by temperature, with DataFrame functions only.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they come). The exponent is found by
sectioning its interval until the weights have the target entropy, or no source is repeated more than allowed. Weights
become token budgets; a budget is filled by whole passes over the source and a last, partial pass that follows a permutation
of blocks, and of the documents inside a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.session import stage

#: Rows of a per-source table that may be broadcast; beyond it the join is left to Spark.
BROADCAST_SOURCES = 50_000
SECTIONS = 16
ROUNDS = 8


@dataclass(frozen=True)
class Target:
    """Either the entropy wanted, as a share of the largest possible, or the most passes over any source."""

    max_repeats: float | None = None
    entropy_share: float | None = None

    def __post_init__(self) -> None:
        if (self.max_repeats is None) == (self.entropy_share is None):
            raise ValueError("give one of max_repeats and entropy_share")


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def document_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, source, tokens``: words between blanks; a null source counts as ''."""
    return documents.select("doc_id", _source().alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))


def source_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))


def _weights(totals: DataFrame, exponent: Column, by: list[str]) -> DataFrame:
    """Adds ``weight``: p ** exponent, normalised. A source without tokens has weight 0."""
    total = F.sum("source_tokens").over(Window.partitionBy(*by))
    raw = F.when(F.col("source_tokens") > 0, F.pow(F.col("source_tokens") / total, exponent)).otherwise(0.0)
    with_raw = totals.withColumn("__raw", raw)
    return with_raw.withColumn("weight", F.col("__raw") / F.sum("__raw").over(Window.partitionBy(*by))).drop("__raw")


def find_exponent(totals: DataFrame, target: Target, budget_share: float) -> float:
    """The smallest exponent that keeps the repetition limit, or the largest one that reaches the entropy, to six digits.

    Every round lays a grid of exponents over the interval, aggregates all of them at once and keeps the section where the
    condition turns; only the grid's verdicts reach the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = F.explode(F.array(*[F.lit(low + (high - low) * i / SECTIONS) for i in range(SECTIONS + 1)]))
        # Weights by plain sums, not windows: a grid point's sources may be many.
        at = totals.filter("source_tokens > 0").withColumn("a", grid)
        summed = at.groupBy("a").agg(F.sum(F.pow("source_tokens", "a")).alias("z"), F.sum("source_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        met = at.join(summed, "a").withColumn("w", F.pow("source_tokens", "a") / F.col("z"))
        if target.max_repeats is not None:
            fine = F.max(F.col("w") * F.col("t") * F.lit(budget_share) / F.col("source_tokens")) <= F.lit(target.max_repeats)
        else:
            fine = F.sum(-F.col("w") * F.ln("w")) >= F.lit(target.entropy_share) * F.ln(F.first("n"))
        verdict = dict(met.groupBy("a").agg(fine.alias("fine")).collect())
        if not verdict:
            return 1.0
        points = sorted(verdict)
        if target.max_repeats is not None:  # false at the low end, true from some point on
            turn = next((i for i, p in enumerate(points) if verdict[p]), None)
            if turn is None:
                return 1.0
        else:  # true at the low end, false from some point on
            turn = next((i for i, p in enumerate(points) if not verdict[p]), None)
            if turn is None:
                return 1.0
        if turn == 0:
            return points[0] if target.max_repeats is not None else 0.0
        low, high = points[turn - 1], points[turn]
    digits = 1_000_000
    return min(1.0, (int(high * digits) + 1) / digits) if target.max_repeats is not None else int(low * digits) / digits


def plan(tokens: DataFrame, target: Target, budget_share: float = 1.0) -> DataFrame:
    """Per source ``source, source_tokens, source_docs, weight, budget, passes, rest, n_blocks``. ``tokens`` is a written table."""
    totals = stage(source_totals(tokens))
    exponent = find_exponent(totals, target, budget_share)
    every = totals.withColumn("__one", F.lit(1))
    weighted = _weights(every, F.lit(exponent), ["__one"])
    budget = F.floor(F.round(F.col("weight") * F.sum("source_tokens").over(Window.partitionBy("__one")) * F.lit(budget_share), 6))
    out = weighted.withColumn("exponent", F.lit(exponent)).withColumn("budget", budget.cast("long")).drop("__one")
    return stage(
        out.withColumn("passes", F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_tokens"))
        .withColumn("n_blocks", F.ceil(F.sqrt("source_docs")).cast("long"))
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the permutation keys: the document's digest, its block and the block's digest."""
    out = rows.withColumn("__dk", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.conv(F.substring("__dk", 1, 8), 16, 10).cast("long")
    out = out.withColumn("block", F.shiftright(place * F.col("n_blocks"), 32))
    return out.withColumn("__bk", F.md5(F.concat_ws("|", "source", F.col("block").cast("string"))))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    small = sources.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if small else sources, "source")


def cuts(tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the end of the partial pass: the digest of the block it ends in, and the last document taken there.

    Blocks are as many as the root of a source's documents, so neither the running sum over a source's blocks nor the one
    over the documents of the block that is cut grows faster than that.
    """
    keyed = _keyed(_with_sources(tokens, sources.select("source", "rest", "n_blocks")))
    blocks = keyed.groupBy("source", "__bk").agg(F.sum("tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    upto = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("__bk"))
    turned = blocks.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    cut = stage(turned.groupBy("source").agg(F.min("__bk").alias("cut_bk"), F.min_by("upto", "__bk").alias("upto"), F.min_by("block_tokens", "__bk").alias("block_tokens")))
    few = cut.withColumn("before", F.col("upto") - F.col("block_tokens")).select("source", "cut_bk", "before")
    # Only documents of the block that is cut: one block a source.
    inside = _with_sources(keyed, few).filter(F.col("__bk") == F.col("cut_bk"))
    at = F.struct("__dk", "doc_id")
    seen = F.sum("tokens").over(Window.partitionBy("source").orderBy("__dk", "doc_id"))  # equal rows count together
    last = inside.withColumn("seen", F.col("before") + seen).filter(F.col("seen") <= F.col("rest")).groupBy("source").agg(F.max(at).alias("cut_at"))
    return sources.join(few.select("source", "cut_bk"), "source", "left").join(last, "source", "left")


def with_copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds ``copies`` and ``block`` to rows that have ``doc_id`` and a non-null ``source``; nothing is shuffled."""
    keyed = _keyed(_with_sources(rows, cut.select("source", "passes", "n_blocks", "cut_bk", "cut_at")))
    before = F.col("__bk") < F.col("cut_bk")
    inside = (F.col("__bk") == F.col("cut_bk")) & (F.struct("__dk", "doc_id") <= F.col("cut_at"))
    extra = F.when(F.col("cut_bk").isNull(), 0).when(before, 1).when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return keyed.withColumn("copies", (F.col("passes") + extra).cast("long"))


def mixture(documents: DataFrame, target: Target, budget_share: float = 1.0) -> DataFrame:
    """``doc_id, source, tokens, block, copies`` per document row: how often the mixture holds it, 0 for not at all.

    The budget of all sources is ``budget_share`` of the tokens there are. A source's realised tokens stay below its budget by
    less than one document. A null source counts as '', a null text has no tokens; repeated rows share their number of
    copies. Sources without tokens get no budget. An empty table gives an empty result.
    """
    tokens = stage(document_tokens(documents))
    cut = stage(cuts(tokens, plan(tokens, target, budget_share)))
    return with_copies(tokens, cut).select("doc_id", "source", "tokens", "block", "copies")


def mixed(documents: DataFrame, target: Target, budget_share: float = 1.0) -> DataFrame:
    """The documents themselves, each as often as the mixture holds it; columns as they came."""
    names = documents.columns
    tokens = stage(document_tokens(documents))
    cut = stage(cuts(tokens, plan(tokens, target, budget_share)))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "doc_id", _source().alias("source"))
    taken = with_copies(rows, cut).filter(F.col("copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
