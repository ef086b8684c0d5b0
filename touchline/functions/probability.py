"""Expressions over the three outcome probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import settings

UNIFORM = (1 / 3, 1 / 3, 1 / 3)


def argmax_sign(one: Column, draw: Column, two: Column) -> Column:
    """Most probable sign; ties go to the first of 1, X, 2. NULLs are skipped."""
    top = F.greatest(one, draw, two)
    return F.when(one == top, "1").when(draw == top, "X").when(two == top, "2")


def clip_and_normalise(parts: Sequence[Column], floor: float = settings.TINY) -> list[Column]:
    clipped = [F.greatest(p, F.lit(floor)) for p in parts]
    total = clipped[0] + clipped[1] + clipped[2]
    return [c / total for c in clipped]


def entropy_confidence(one: Column, draw: Column, two: Column) -> Column:
    """1 minus the relative entropy, 4 digits. Zero or missing entries count as 0.333."""
    parts = [F.coalesce(F.nullif(p, F.lit(0.0)), F.lit(0.333)) for p in (one, draw, two)]
    spread = sum((F.when(p > 0, p * F.log(p)).otherwise(0.0) for p in parts), F.lit(0.0))
    return F.round(1 + spread / math.log(3), 4)


def top_two(one: Column, draw: Column, two: Column) -> tuple[Column, Column]:
    """The two most probable signs, ties in the order 1, X, 2. Plain comparisons, no arrays."""
    first = argmax_sign(one, draw, two)
    second = (
        F.when(first == "1", F.when(draw >= two, "X").otherwise("2"))
        .when(first == "X", F.when(one >= two, "1").otherwise("2"))
        .when(first == "2", F.when(one >= draw, "1").otherwise("X"))
    )
    return first, second


def value_of(sign: Column, values: Sequence[Column]) -> Column:
    """Value of a sign among three."""
    return F.when(sign == "1", values[0]).when(sign == "X", values[1]).when(sign == "2", values[2])


def play(first: Column, second: Column) -> Column:
    """Two signs (possibly equal) joined in the order 1, X, 2 without repetition."""
    return F.concat(*[F.when((first == s) | (second == s), s).otherwise("") for s in settings.SIGNS])


def double_for(one: Column, draw: Column, two: Column, threshold: Column | float) -> Column:
    """The double to play: the draw rule at the threshold, otherwise the two most probable signs."""
    top, second = top_two(one, draw, two)
    by_draw = F.when(top == "1", "1X").when(top == "2", "X2")
    return F.coalesce(F.when(draw >= threshold, by_draw), play(top, second))


def blend(
    weights: Mapping[str, Column | float], boost: Column | float = 0.0,
    segunda_boost: Column | float = 0.0, get: Callable[[str], Column] = F.col,
) -> list[Column]:
    """Weighted sum of the four sources with draw boosts, normalised.

    Missing market and score-model probabilities count as 0; the trained models are never filled.
    ``get`` finds a value by name, so the same rule serves columns and structs inside arrays.
    """
    return normalise_present(blend_parts(weights, boost, segunda_boost, get))


def blend_parts(
    weights: Mapping[str, Column | float], boost: Column | float, segunda_boost: Column | float,
    get: Callable[[str], Column] = F.col,
) -> list[Column]:
    parts = [
        weights["logit"] * get(f"logit_prob_{sign}")
        + weights["hgb"] * get(f"hgb_prob_{sign}")
        + weights["market"] * F.coalesce(get(f"market_{sign}"), F.lit(0.0))
        + weights["poisson"] * F.coalesce(get(f"poisson_{sign}"), F.lit(0.0))
        for sign in ("1", "x", "2")
    ]
    bonus = F.when(get("division") == "Segunda", F.lit(segunda_boost)).otherwise(F.lit(0.0))
    parts[1] = parts[1] + F.lit(boost) + bonus
    return parts


def normalise_present(parts: Sequence[Column]) -> list[Column]:
    """Divide by the sum of the present parts; NULL when that sum is zero."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return [F.when(total != 0, p / total) for p in parts]


def model_disagreement(get: Callable[[str], Column] = F.col) -> Column:
    gaps = [F.abs(get(f"logit_prob_{s}") - get(f"hgb_prob_{s}")) for s in ("1", "x", "2")]
    return (gaps[0] + gaps[1] + gaps[2]) / 3.0


def nudge_by_divergence(market: Sequence[Column], model: Sequence[Column]) -> list[Column]:
    """Move the market half way where the model is 0.05 to 0.10 above it."""
    market = clip_and_normalise(market)
    model = clip_and_normalise(model)
    moved = []
    for base, other in zip(market, model):
        gap = other - base
        moved.append(base + F.when((gap >= 0.05) & (gap <= 0.10), gap * 0.5).otherwise(0.0))
    return clip_and_normalise(moved)


def substitute_draw(one: Column, two: Column, draw: Column) -> list[Column]:
    """Replace P(X) and share the rest in the proportion of the old 1 and 2."""
    rest = one + two
    rest = F.when(rest == 0, 1e-6).otherwise(rest)
    return [one / rest * (1 - draw), draw, two / rest * (1 - draw)]


def pair_mean(a: Column, b: Column) -> Column:
    """Mean of the present ones of two values."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)


def favourite_hit(favourite: Column, result: Column) -> Column:
    return F.coalesce((favourite == result).cast("int"), F.lit(0))
