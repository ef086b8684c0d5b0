"""Score-model expressions: Poisson and Dixon-Coles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import settings

FLOOR = 1e-15


def poisson_pmf(goals: int, mean: Column) -> Column:
    return F.exp(-mean) * F.pow(mean, F.lit(float(goals))) / math.factorial(goals)


def _rectangle_sums(home: Column, away: Column, max_goals: int) -> list[Column]:
    """Mass of home win, draw and away win on the truncated score grid, as plain column sums."""
    h = [poisson_pmf(g, home) for g in range(max_goals + 1)]
    a = [poisson_pmf(g, away) for g in range(max_goals + 1)]
    win, draw, loss = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    below_a, below_h = F.lit(0.0), F.lit(0.0)
    for g in range(max_goals + 1):
        win = win + h[g] * below_a
        loss = loss + a[g] * below_h
        draw = draw + h[g] * a[g]
        below_a = below_a + a[g]
        below_h = below_h + h[g]
    return [win, draw, loss]


def poisson_1x2(home: Column, away: Column, max_goals: int = settings.MAX_GOALS) -> list[Column]:
    """Independent Poisson outcome probabilities, truncated and renormalised."""
    win, draw, loss = _rectangle_sums(home, away, max_goals)
    total = win + draw + loss
    return [F.when(total > 0, p / total) for p in (win, draw, loss)]


def dixon_coles_factor(hg: int, ag: int, home: Column, away: Column, rho: Column) -> Column:
    """Low-score correction of one cell."""
    if (hg, ag) == (0, 0):
        return 1.0 - home * away * rho
    if (hg, ag) == (1, 0):
        return 1.0 + home * rho
    if (hg, ag) == (0, 1):
        return 1.0 + away * rho
    if (hg, ag) == (1, 1):
        return 1.0 - rho
    return F.lit(1.0)


def with_score_cells(
    df: DataFrame, rho: Column | float, home: str = "lambda_home", away: str = "lambda_away",
    max_goals: int = settings.MAX_GOALS, name: str = "cells",
) -> DataFrame:
    """Add an array of structs (hg, ag, p) over the score grid; probabilities sum to 1.

    NULL without means. Goal probabilities, grid mass and cells are separate plain columns, so each
    is computed once per row in generated code.
    """
    rho = F.lit(rho)
    h, a = F.col(home), F.col(away)
    goals = range(max_goals + 1)
    out = df.withColumns(
        {f"_h{g}": poisson_pmf(g, h) for g in goals} | {f"_a{g}": poisson_pmf(g, a) for g in goals}
    )
    mass = {
        (i, j): F.greatest(F.col(f"_h{i}") * F.col(f"_a{j}") * dixon_coles_factor(i, j, h, a, rho), F.lit(FLOOR))
        for i in goals for j in goals
    }
    out = out.withColumn("_mass", sum(mass.values(), F.lit(0.0)))
    cells = F.array(*[
        F.struct(F.lit(i).alias("hg"), F.lit(j).alias("ag"), (m / F.col("_mass")).alias("p")) for (i, j), m in mass.items()
    ])
    known = h.isNotNull() & a.isNotNull()
    return out.withColumn(name, F.when(known, cells)).drop(
        "_mass", *[f"_h{g}" for g in goals], *[f"_a{g}" for g in goals]
    )


def outcome_from_cells(cells: Column) -> list[Column]:
    def mass(keep) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.when(keep(c), c["p"]).otherwise(0.0))

    return [
        mass(lambda c: c["hg"] > c["ag"]),
        mass(lambda c: c["hg"] == c["ag"]),
        mass(lambda c: c["hg"] < c["ag"]),
    ]


def dixon_coles_1x2(
    home: Column, away: Column, rho: Column | float, max_goals: int = settings.MAX_GOALS
) -> list[Column]:
    """Dixon-Coles outcomes by correcting only the four low-score cells of the Poisson sums.

    Plain column arithmetic, so the whole computation stays inside generated code. It differs from
    the cell form only in the floor of 1e-15 per cell.
    """
    rho = F.lit(rho)
    win, draw, loss = _rectangle_sums(home, away, max_goals)

    def correction(hg: int, ag: int) -> Column:
        base = poisson_pmf(hg, home) * poisson_pmf(ag, away)
        return F.greatest(base * dixon_coles_factor(hg, ag, home, away, rho), F.lit(FLOOR)) - base

    win = win + correction(1, 0)
    loss = loss + correction(0, 1)
    draw = draw + correction(0, 0) + correction(1, 1)
    total = win + draw + loss
    return [F.when(total > 0, p / total) for p in (win, draw, loss)]


def top_scores(cells: Column, n: int = 3) -> Column:
    """The ``n`` most probable scores; ties (12 digits) by home goals, then away goals."""
    # Only cells that may round up to the n-th largest value are rounded and sorted; rounding moves none by more than half a digit.
    values = F.sort_array(F.transform(cells, lambda c: c["p"]), asc=False)
    least = F.coalesce(F.get(values, F.lit(n - 1)) - 2e-12, F.lit(float("-inf")))
    # The limit is bound as a lambda's variable, or it would be worked out again for every cell.
    close = F.get(F.transform(F.array(least), lambda limit: F.filter(cells, lambda c: c["p"] >= limit)), F.lit(0))
    ordered = F.array_sort(
        F.transform(
            close,
            lambda c: F.struct(
                (-F.round(c["p"], 12)).alias("k"), c["hg"].alias("hg"), c["ag"].alias("ag"), c["p"].alias("p")
            ),
        )
    )
    return F.transform(
        F.slice(ordered, 1, n),
        lambda c: F.struct(
            F.concat_ws("-", c["hg"].cast("string"), c["ag"].cast("string")).alias("score"),
            c["p"].alias("prob"), c["hg"].alias("hg"), c["ag"].alias("ag"),
        ),
    )


# Goal buckets of match 15.
BUCKETS = ("0", "1", "2", "M")


def bucket_probs(cells: Column, side: str) -> Column:
    """Probabilities of 0, 1, 2 and 3 or more goals of one side, four digits."""
    total = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["p"])

    def one(bucket: int) -> Column:
        inside = (lambda c: c[side] >= 3) if bucket == 3 else (lambda c: c[side] == bucket)
        mass = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.when(inside(c), c["p"]).otherwise(0.0))
        return F.round(F.when(total > 0, mass / total).otherwise(mass), 4)

    return F.when(cells.isNotNull(), F.array(*[one(b) for b in range(4)]))


def pick_bucket(buckets: Column, gap: float = settings.ALTERNATIVE_BUCKET_GAP) -> Column:
    """Most probable bucket and, when the next one is close, an alternative."""
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-buckets[i]).alias("np"), F.lit(i).alias("i"), F.lit(b).alias("label"))
                for i, b in enumerate(BUCKETS)
            ]
        )
    )
    close = (ranked[1]["np"] - ranked[0]["np"]) < gap
    return F.struct(
        ranked[0]["label"].alias("main"),
        F.when(close, ranked[1]["label"]).alias("alternative"),
        (-ranked[0]["np"]).alias("p"),
    )
