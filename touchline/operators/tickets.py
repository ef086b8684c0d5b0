"""Pool tickets: building, ranking, exact distributions, economics and ex-post results."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import settings
from touchline.functions import odds
from touchline.functions import tickets as tk
from touchline.functions.probability import UNIFORM
from touchline.operators.ordinal import with_blocks


def collect_tickets(
    rows: DataFrame, key: Sequence[str], fields: Sequence[str] = ("p",), size: int = settings.TICKET_MATCHES
) -> DataFrame:
    """One row per ticket with ``matches``: structs (num, fields) ordered by num.

    A ticket holds one row per num of 1..size, so the collected array is bounded.
    """
    inside = rows.filter(F.col("num").between(1, size))
    packed = F.struct("num", *fields)
    return inside.groupBy(*key).agg(F.array_sort(F.collect_list(packed)).alias("matches"))


def fill_uniform(p: Column) -> Column:
    return F.coalesce(p, F.array(*[F.lit(u) for u in UNIFORM]))


def source_probs(override: Column | None, source: Column) -> Column:
    """Model probabilities first, then the percentages of a source; NULL if neither is complete."""
    from_source = odds.percent_to_probs(source)
    return from_source if override is None else F.coalesce(override, from_source)


def main_block(rows: DataFrame, last: int = settings.BLOCK_SIZE) -> DataFrame:
    """Matches of the 1X2 ticket; the score match is played apart."""
    return rows.filter(F.col("num") != last)


def ticket_metrics(tickets: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Best development of each ticket with exact hit distribution and tail probabilities."""
    out = tickets.withColumn("doubles", tk.best_doubles(F.col("matches")) if chosen is None else chosen)
    out = out.withColumn("signs", tk.development(F.col("matches"), F.col("doubles")))
    out = out.withColumn("covers", tk.coverages(F.col("matches"), F.col("doubles")))
    out = out.withColumn("dist", tk.hit_distribution(F.col("covers")))
    seconds = F.transform("doubles", lambda i: tk.second_probability(F.get(F.col("matches"), i)["p"]))
    return out.withColumns(
        {
            "expected_hits": tk.total(F.col("covers")), "second_sum": tk.total(seconds),
            **{f"p_ge_{k}": tk.tail(F.col("dist"), k) for k in tk.TAILS},
        }
    )


#: Tickets worked out together inside a task: bounds its arrays, not what is read.
TICKETS_AT_ONCE = 64


def _middle(p: np.ndarray) -> np.ndarray:
    return np.sort(p, axis=2)[:, :, 1]


def _remainder(p: np.ndarray) -> np.ndarray:
    return p[:, :, 0] + p[:, :, 1] + p[:, :, 2] - p.max(axis=2) - p.min(axis=2)


def _decimal_key(values: np.ndarray) -> np.ndarray:
    """Twelve digits of the shortest decimal text, halves up; only values near a half need the text."""
    scaled = values * 1e12
    key = np.floor(scaled + 0.5)
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 0.02)):
        key[at] = float(Decimal(repr(float(values[at]))).scaleb(12).quantize(Decimal(1), ROUND_HALF_UP))
    return key


def _binary_key(values: np.ndarray) -> np.ndarray:
    """Twelve digits of the number times 1e12, halves up."""
    return np.floor(values * 1e12 + 0.5)


#: How the middle probability is taken, the favourites are added (1: from the first match) and twelve digits are compared.
#: Combinations of equal value differ in their last bits; where twelve digits end on a half, these decide.
RANKINGS = {"decimal": (_middle, 1, _decimal_key), "binary": (_remainder, 1, _binary_key)}


def _ranked(p: np.ndarray, size: np.ndarray, ranking: str, top: int | None) -> dict[str, np.ndarray]:
    """Columns of the ranked combinations of a few tickets. ``p`` is ticket x match x 3; matches from ``size`` on are absent."""
    choices = np.array(list(itertools.combinations(range(p.shape[1]), settings.DOUBLES)))
    middle, step, key_of = RANKINGS[ranking]
    absent = np.arange(p.shape[1]) >= size[:, None]
    best, second = p.max(axis=2), middle(p)
    best[absent] = 0.0
    base = np.zeros(len(p))
    for m in range(p.shape[1])[::step]:
        base = base + best[:, m]
    extra = np.zeros((len(p), len(choices)))
    for d in range(settings.DOUBLES):
        extra = extra + second[:, choices[:, d]]
    hits = base[:, None] + extra
    key = key_of(hits)
    order = np.argsort(np.where(np.isnan(key), -np.inf, -key), axis=1, kind="stable")[:, :top]
    taken = choices[order]
    # One convolution per match, all combinations side by side.
    dist = np.zeros((p.shape[1] + 1, *order.shape))
    dist[0] = 1.0
    second = np.where(absent, 0.0, second)
    for m in range(p.shape[1]):
        h = best[:, m, None] + np.where((taken == m).any(axis=2), second[:, m, None], 0.0)
        dist[1 : m + 2] = dist[1 : m + 2] * (1 - h) + dist[: m + 1] * h
        dist[0] *= 1 - h
    out = {
        "rank": np.broadcast_to(np.arange(1, order.shape[1] + 1), order.shape), "combination": order,
        "expected_hits": np.take_along_axis(hits, order, axis=1), "second_sum": np.take_along_axis(extra, order, axis=1),
    }
    for k in tk.TAILS:
        tail = np.zeros(order.shape)
        for v in dist[k:]:
            tail = tail + v
        out[f"p_ge_{k}"] = np.where(size[:, None] >= k, tail, np.nan)
    return out


def ranked_combinations(
    tickets: DataFrame, key: Sequence[str], top: int | None = None, ranking: str = "decimal"
) -> DataFrame:
    """All combinations of doubles per ticket by expected hits on twelve digits, earlier ones first on a tie.

    ``top`` limits the report, ``ranking`` is one of ``RANKINGS``. Spark deals the tickets; a task ranks a few at a time and
    convolves all their combinations together. A combination that lacks a probability comes first, without figures.
    """
    if ranking not in RANKINGS:
        raise ValueError(f"no ranking {ranking!r}")
    names, matches = list(key), settings.TICKET_MATCHES
    unknown = F.array(*[F.lit(None).cast("double")] * 3)
    flat = F.flatten(F.transform("matches", lambda m: F.coalesce(m["p"], unknown)))
    wide = tickets.select(*names, flat.cast("array<double>").alias("_p"))
    figures = ["expected_hits", "second_sum", *[f"p_ge_{k}" for k in tk.TAILS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TICKETS_AT_ONCE):
                some = batch.slice(lo, TICKETS_AT_ONCE)
                lists = some.column(len(names))
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 3
                p = np.full((some.num_rows, matches * 3), np.nan)
                p[np.arange(matches * 3) < 3 * size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                out = _ranked(p.reshape(-1, matches, 3), size, ranking, top)
                rows = pa.array(np.repeat(np.arange(some.num_rows), out["rank"].shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(i).take(rows) for i in range(len(names))]
                    + [pa.array(out[c].ravel().astype(np.int32)) for c in ("rank", "combination")]
                    + [pa.array(out[c].ravel(), from_pandas=True) for c in figures],
                    names=[*names, "rank", "combination", *figures],
                )

    schema = T.StructType([wide.schema[c] for c in names])
    schema = schema.add("rank", "integer").add("combination", "integer")
    for c in figures:
        schema = schema.add(c, "double")
    out = wide.mapInArrow(run, schema)
    doubles = F.get(tk.combinations_of_doubles(), F.col("combination"))
    return out.select(*names, "rank", "combination", doubles.alias("doubles"), *figures)


def ticket_columns(tickets: DataFrame, key: Sequence[str], alpha: float = 0.6) -> DataFrame:
    """The eight columns of each ticket by anti-popularity value. Matches need ``p`` and ``public``."""
    out = tickets.withColumn("doubles", tk.best_doubles(F.col("matches"))).withColumn(
        "signs", tk.development(F.col("matches"), F.col("doubles"))
    )
    probs = F.transform("matches", lambda m: m["p"])
    public = F.transform("matches", lambda m: m["public"])
    valued = tk.let(
        F.struct(probs.alias("probs"), public.alias("public")),
        lambda v: F.transform(
            tk.columns_of(F.col("signs")),
            lambda c, i: (
                tk.let(
                    tk.column_value(c, v["probs"], v["public"], alpha),
                    lambda x: F.struct((-tk.digits(x, tk.VALUE_DIGITS)).alias("k"), i.alias("index"), c.alias("column"), x.alias("value")),
                )
            ),
        ),
    )
    out = out.select(*key, F.posexplode(F.array_sort(valued)).alias("rank", "c"))
    return out.select(*key, (F.col("rank") + 1).alias("rank"), F.col("c.column").alias("column"), F.col("c.value").alias("value"))


def favourite_tickets(tickets: DataFrame) -> DataFrame:
    """One column of favourites per ticket with the exact distribution."""
    none = F.array().cast("array<int>")
    return ticket_metrics(tickets, none)


def reference_ticket(rows: DataFrame, key: Sequence[str], field: str) -> DataFrame:
    """Singles taken from a field of the matchday, NULL if any match lacks a sign."""
    sign = F.when(F.col(field).isin(*settings.SIGNS), F.col(field))
    cover = tk.cover_of(F.col("p"), sign)
    grouped = rows.groupBy(*key).agg(
        F.count(sign).alias("_known"), F.count(F.lit(1)).alias("_all"),
        F.array_sort(F.collect_list(F.struct("num", sign.alias("sign"), cover.alias("cover")))).alias("picks"),
    )
    complete = F.col("_known") == F.col("_all")
    out = grouped.withColumns(
        {
            "signs": F.when(complete, F.transform("picks", lambda x: x["sign"])),
            "dist": F.when(complete, tk.hit_distribution(F.transform("picks", lambda x: x["cover"]))),
        }
    )
    hits = F.when(complete, tk.total(F.transform("picks", lambda x: x["cover"])))
    return out.select(
        *key, F.lit(field).alias("source"), "signs", hits.alias("expected_hits"),
        *[tk.tail(F.col("dist"), k).alias(f"p_ge_{k}") for k in tk.TAILS],
    )


# ---------------------------------------------------------------------------
# Economics
# ---------------------------------------------------------------------------

def with_economics(
    tickets: DataFrame, prizes: dict[int, float] = settings.PRIZES, cost: float = settings.TICKET_COST
) -> DataFrame:
    """Expected prize, net value and return of tickets with ``dist``."""
    expected = tk.expected_prize(F.col("dist"), prizes)
    return tickets.withColumns(
        {
            "ev_prizes": expected, "cost": F.lit(cost), "ev_net": expected - cost,
            "roi": (expected - cost) / cost if cost > 0 else F.lit(None).cast("double"),
            **{f"p_{k}": F.get("dist", F.lit(k)) for k in tk.TAILS},
        }
    )


def economics_by_scenario(
    tickets: DataFrame, key: Sequence[str], scenarios: dict[str, dict[int, float]] = settings.PRIZE_SCENARIOS,
    cost: float = settings.TICKET_COST,
) -> DataFrame:
    """One row per ticket and prize scenario."""
    cases = F.array(*[
        F.struct(F.lit(n).alias("scenario"), tk.expected_prize(F.col("dist"), p).alias("ev_prizes"))
        for n, p in scenarios.items()
    ])
    net = F.col("ev_prizes") - cost
    return tickets.select(*key, F.inline(cases)).withColumns({"ev_net": net, "roi": net / cost})


def compare_with_market(
    rows: DataFrame, key: Sequence[str], prizes: dict[int, float] = settings.PRIZES
) -> DataFrame:
    """Model ticket with doubles against market favourites. ``rows`` hold ``model`` and ``market`` arrays.

    The market column is charged both the full ticket price and its own single column.
    """
    both = collect_tickets(rows, key, ("model", "market"))
    model = both.select(*key, F.transform("matches", lambda m: F.struct(m["num"].alias("num"), m["model"].alias("p"))).alias("matches"))
    market = both.select(*key, F.transform("matches", lambda m: F.struct(m["num"].alias("num"), m["market"].alias("p"))).alias("matches"))
    a = with_economics(ticket_metrics(model), prizes).select(
        *key, F.col("ev_net").alias("model_ev_net"), F.col("roi").alias("model_roi"), F.col("p_ge_12").alias("model_p_ge_12"),
        F.col("expected_hits").alias("model_expected_hits"),
    )
    b = with_economics(favourite_tickets(market), prizes)
    single = (F.col("ev_prizes") - settings.PRICE_PER_COLUMN) / settings.PRICE_PER_COLUMN
    b = b.select(
        *key, F.col("ev_net").alias("market_ev_net"), F.col("roi").alias("market_roi"),
        single.alias("market_roi_one_column"), F.col("p_ge_12").alias("market_p_ge_12"),
    )
    return a.join(b, list(key)).withColumns(
        {
            "delta_ev_net": F.col("model_ev_net") - F.col("market_ev_net"),
            "delta_roi": F.col("model_roi") - F.col("market_roi"),
            "delta_p_ge_12": F.col("model_p_ge_12") - F.col("market_p_ge_12"),
        }
    )


# ---------------------------------------------------------------------------
# Ex-post results
# ---------------------------------------------------------------------------

def settle_blocks(
    predictions: DataFrame, group: Sequence[str], prizes: dict[int, float] = settings.PRIZES
) -> DataFrame:
    """Result of one ticket per block of 15 (14 played) and group.

    ``predictions`` hold match keys, ``result``, ``model`` and ``market`` arrays. A block with a
    missing probability or result is not evaluated.
    """
    blocks = with_blocks(predictions, group)
    tickets = collect_tickets(blocks, [*group, "block"], ("model", "market", "result"))
    complete = F.forall(
        "matches", lambda m: m["model"].isNotNull() & m["market"].isNotNull() & m["result"].isin(*settings.SIGNS)
    )
    tickets = tickets.filter((F.size("matches") == settings.TICKET_MATCHES) & complete)
    model = F.transform("matches", lambda m: F.struct(m["num"].alias("num"), m["model"].alias("p")))
    results = F.transform("matches", lambda m: m["result"])
    favourites = F.transform("matches", lambda m: tk.favourite(m["market"]))
    out = tickets.select(*group, "block", model.alias("m"), results.alias("results"), favourites.alias("favourites"))
    out = out.withColumn("signs", tk.development(F.col("m"), tk.best_doubles(F.col("m"))))
    out = out.withColumns(
        {
            "model_hits": tk.count_hits(F.col("results"), F.col("signs")),
            "market_hits": tk.count_hits(F.col("results"), F.col("favourites")),
        }
    )
    return out.select(
        *group, "block", "model_hits", "market_hits",
        tk.prize_for(F.col("model_hits"), prizes).alias("model_prize"),
        tk.prize_for(F.col("market_hits"), prizes).alias("market_prize"),
    )


def _share(column: str, k: int) -> Column:
    return F.avg((F.col(column) >= k).cast("int"))


def season_economics(
    settled: DataFrame, group: Sequence[str] = ("season",), cost: float = settings.TICKET_COST,
    column_price: float = settings.PRICE_PER_COLUMN,
) -> DataFrame:
    """Costs, prizes, returns and hit shares per group of settled tickets."""
    out = settled.groupBy(*group).agg(
        F.count(F.lit(1)).alias("jornadas"),
        F.avg("model_hits").alias("model_mean_hits"), F.avg("market_hits").alias("market_mean_hits"),
        F.sum("model_prize").alias("model_prize_eur"), F.sum("market_prize").alias("market_prize_eur"),
        *[_share("model_hits", k).alias(f"model_p_ge_{k}") for k in tk.TAILS],
    )
    full, single = F.col("jornadas") * cost, F.col("jornadas") * column_price
    return out.withColumns(
        {
            "model_cost_eur": full, "model_roi": (F.col("model_prize_eur") - full) / full,
            "market_roi_1col": (F.col("market_prize_eur") - single) / single,
            "market_roi_full": (F.col("market_prize_eur") - full) / full,
        }
    )


def scenario_sensitivity(
    settled: DataFrame, scenarios: dict[str, dict[int, float]] = settings.PRIZE_SCENARIOS,
    cost: float = settings.TICKET_COST,
) -> DataFrame:
    """Return of model and market tickets under each prize scenario: one pass over the tickets."""
    cases = F.array(*[
        F.struct(
            F.lit(n).alias("scenario"), F.lit(who).alias("arm"),
            tk.prize_for(F.col(f"{who}_hits"), p).alias("prize"),
        )
        for n, p in scenarios.items() for who in ("model", "market")
    ])
    out = settled.select(F.inline(cases)).groupBy("scenario", "arm").agg(
        F.sum("prize").alias("prize_eur"), (F.count(F.lit(1)) * cost).alias("cost_eur")
    )
    return out.withColumn("roi", (F.col("prize_eur") - F.col("cost_eur")) / F.col("cost_eur"))


# ---------------------------------------------------------------------------
# Arms (several probability sets over the same matches)
# ---------------------------------------------------------------------------

def evaluate_arms(
    rows: DataFrame, prizes: dict[int, float] = settings.PRIZES, cost: float = settings.TICKET_COST
) -> DataFrame:
    """Season results of several arms: ``rows`` hold season, match keys, result and ``arms``.

    ``arms`` is an array of structs (arm, p). Blocks are numbered once; arms are unfolded inside
    the row of the block, so adding arms adds no shuffle of matches.
    """
    simple = rows.select("season", "result", F.inline("arms")).filter(F.col("p").isNotNull())
    accuracy = simple.filter(F.col("result").isin(*settings.SIGNS)).groupBy("season", "arm").agg(
        F.avg((tk.favourite(F.col("p")) == F.col("result")).cast("int")).alias("accuracy_simple")
    )
    blocks = collect_tickets(with_blocks(rows, ["season"]), ["season", "block"], ("arms", "result"))
    blocks = blocks.filter(
        (F.size("matches") == settings.TICKET_MATCHES)
        & F.forall("matches", lambda m: m["result"].isin(*settings.SIGNS))
    )
    names = F.transform(F.get("matches", F.lit(0))["arms"], lambda a: a["arm"])
    per_arm = blocks.select("season", "block", "matches", F.posexplode(names).alias("i", "arm"))
    own = F.transform(
        "matches", lambda m: F.struct(m["num"].alias("num"), F.get(m["arms"], F.col("i"))["p"].alias("p"))
    )
    per_arm = per_arm.withColumn("m", own).filter(F.forall("m", lambda x: x["p"].isNotNull()))
    per_arm = per_arm.withColumn("signs", tk.development(F.col("m"), tk.best_doubles(F.col("m")))).withColumn(
        "hits", tk.count_hits(F.transform("matches", lambda m: m["result"]), F.col("signs"))
    ).withColumn("prize", tk.prize_for(F.col("hits"), prizes))
    result = per_arm.groupBy("season", "arm").agg(
        F.count(F.lit(1)).alias("jornadas"), F.avg("hits").alias("mean_hits"),
        *[_share("hits", k).alias(f"p_ge_{k}") for k in (12, 13, 14)],
        F.sum("prize").alias("prize_eur"),
    )
    full = F.col("jornadas") * cost
    return result.join(accuracy, ["season", "arm"], "left").withColumns(
        {"cost_eur": full, "roi": (F.col("prize_eur") - full) / full}
    )


def aggregate_arms(per_season: DataFrame) -> DataFrame:
    return per_season.groupBy("arm").agg(
        F.count(F.lit(1)).alias("temporadas"),
        ((F.sum("prize_eur") - F.sum("cost_eur")) / F.sum("cost_eur")).alias("roi_global"),
        F.avg("accuracy_simple").alias("mean_accuracy"), F.avg("mean_hits").alias("mean_hits"),
        F.avg("p_ge_12").alias("mean_p_ge_12"), F.stddev_pop("p_ge_12").alias("std_p_ge_12"),
        F.avg("p_ge_13").alias("mean_p_ge_13"), F.avg("roi").alias("mean_roi_seasonal"),
        F.stddev_pop("roi").alias("std_roi_seasonal"),
    )


def replacement_decision(per_season: DataFrame, baseline: str, last: int = 5, wins_needed: int = 4) -> DataFrame:
    """Does an arm replace the baseline? It must win P(>=12) in enough of the last seasons and be
    better on mean minus half the deviation. One row per challenger."""
    seasons = per_season.select("season").distinct().withColumn(
        "_recent", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("season")))
    ).filter(F.col("_recent") <= last)
    base = per_season.filter(F.col("arm") == baseline).select("season", F.col("p_ge_12").alias("_base"))
    recent = per_season.filter(F.col("arm") != baseline).join(seasons, "season", "left_semi").join(base, "season")
    duels = recent.groupBy("arm").agg(
        F.count_if(F.col("p_ge_12") > F.col("_base")).alias("wins"),
        F.count_if(F.col("p_ge_12") == F.col("_base")).alias("ties"),
    )
    scores = aggregate_arms(per_season).select(
        "arm", (F.col("mean_p_ge_12") - settings.STABILITY_PENALTY * F.col("std_p_ge_12")).alias("score"), "roi_global"
    )
    own = scores.filter(F.col("arm") == baseline).select(
        F.col("score").alias("baseline_score"), F.col("roi_global").alias("baseline_roi"), F.lit(1).alias("_one")
    )
    out = scores.filter(F.col("arm") != baseline).withColumn("_one", F.lit(1)).join(own, "_one").join(duels, "arm", "left")
    out = out.fillna(0, ["wins", "ties"])
    replaces = (F.col("wins") >= wins_needed) & (F.col("score") > F.col("baseline_score"))
    return out.select(
        "arm", "wins", "ties", "score", "baseline_score", "roi_global", "baseline_roi", replaces.alias("replaces")
    )
