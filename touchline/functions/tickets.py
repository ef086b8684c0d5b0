"""Expressions over one ticket held in a row: an array of at most 15 match structs.

A match struct has ``num`` and ``p`` (array of three probabilities). Everything here works inside
the row, so ranking 364 combinations of doubles or eight columns never shuffles.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import settings

TAILS = (10, 11, 12, 13, 14)
_DIGITS = 12
#: Column values are sums of logarithms: their last digits depend on the order of the terms.
VALUE_DIGITS = 10


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    A lambda re-evaluates every outer expression per element; a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(value: Column, n: int) -> Column:
    """``value`` in units of the n-th digit, halves away from zero."""
    return let(value * 10.0**n, lambda x: F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)))


def second_probability(p: Column) -> Column:
    return F.get(F.array_sort(p), F.lit(1))


def favourite(p: Column) -> Column:
    """Most probable sign, the first of 1, X, 2 on a tie."""
    top = F.array_max(p)
    return F.when(p[0] == top, "1").when(p[1] == top, "X").otherwise("2")


def double_signs(p: Column) -> Column:
    """The two most probable signs; on a tie for the last place the earlier sign is left out."""
    low = F.array_min(p)
    return F.when(p[0] == low, "X2").when(p[1] == low, "12").otherwise("1X")


def double_cover(p: Column) -> Column:
    low = F.array_min(p)
    return F.when(p[0] == low, p[1] + p[2]).when(p[1] == low, p[0] + p[2]).otherwise(p[0] + p[1])


def combinations_of_doubles(matches: int = settings.TICKET_MATCHES, doubles: int = settings.DOUBLES) -> Column:
    """All choices of doubles as a constant array of position arrays, in lexicographic order."""
    if matches < doubles:
        raise ValueError(f"{doubles} doubles need at least {doubles} matches")
    table = json.dumps([list(c) for c in itertools.combinations(range(matches), doubles)])
    return F.from_json(F.lit(table), "array<array<int>>")


def best_doubles(matches: Column, doubles: int = settings.DOUBLES) -> Column:
    """Positions of the best doubles: the largest second probabilities, earlier matches on a tie.

    The expected hits of a choice are a constant plus its second probabilities, so this equals the
    first maximum over all combinations in lexicographic order.
    """
    keyed = F.transform(
        matches,
        lambda m, i: F.struct((-F.round(second_probability(m["p"]), _DIGITS)).alias("k"), i.alias("i")),
    )
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, doubles), lambda s: s["i"]))


def development(matches: Column, chosen: Column) -> Column:
    """Played signs per match: two at the chosen positions, the favourite elsewhere."""
    return let(
        chosen,
        lambda taken: F.transform(
            matches,
            lambda m, i: F.when(F.array_contains(taken, i), double_signs(m["p"])).otherwise(favourite(m["p"])),
        ),
    )


def coverages(matches: Column, chosen: Column) -> Column:
    return let(
        chosen,
        lambda taken: F.transform(
            matches,
            lambda m, i: F.when(F.array_contains(taken, i), double_cover(m["p"])).otherwise(F.array_max(m["p"])),
        ),
    )


def cover_of(p: Column, signs: Column) -> Column:
    """Probability that one of the played signs comes."""
    parts = [F.when(signs.contains(s), p[i]).otherwise(0.0) for i, s in enumerate(settings.SIGNS)]
    return parts[0] + parts[1] + parts[2]


def hit_distribution(covers: Column) -> Column:
    """Exact distribution of hits 0..n: one Bernoulli convolution per match."""
    return F.aggregate(
        covers,
        F.array(F.lit(1.0)),
        lambda dist, h: F.zip_with(
            F.concat(F.transform(dist, lambda d: d * (1.0 - h)), F.array(F.lit(0.0))),
            F.concat(F.array(F.lit(0.0)), F.transform(dist, lambda d: d * h)),
            lambda a, b: a + b,
        ),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def tail(dist: Column, k: int) -> Column:
    """P(at least k); NULL when the ticket has fewer matches."""
    return F.when(F.size(dist) > k, total(F.slice(dist, k + 1, 100)))


def expected_prize(dist: Column, prizes: dict[int, float]) -> Column:
    """Prizes are paid for the exact number of hits, nothing below the lowest category."""
    out = F.lit(0.0)
    for k, euros in prizes.items():
        out = out + F.coalesce(F.get(dist, F.lit(k)), F.lit(0.0)) * euros
    return out


def prize_for(hits: Column, prizes: dict[int, float]) -> Column:
    return F.coalesce(*[F.when(hits == k, F.lit(v)) for k, v in prizes.items()], F.lit(0.0))


def count_hits(results: Column, signs: Column) -> Column:
    """Matches whose result is among the played signs."""
    flags = F.zip_with(results, signs, lambda r, s: F.when(s.contains(r), 1).otherwise(0))
    return F.aggregate(flags, F.lit(0), lambda acc, f: acc + f)


def columns_of(signs: Column, doubles: int = settings.DOUBLES) -> Column:
    """All columns of a development as strings, first double slowest."""

    def numbered(played: Column) -> Column:
        """Signs with the bit of the column number that decides them (NULL for singles)."""
        flags = F.transform(played, lambda s: (F.length(s) > 1).cast("int"))
        return F.zip_with(
            played,
            let(flags, lambda f: F.transform(
                f, lambda flag, i: F.when(flag == 1, F.aggregate(F.slice(f, F.lit(1), i), F.lit(0), lambda a, x: a + x))
            )),
            lambda s, earlier: F.struct(
                s.alias("s"), F.pow(F.lit(2.0), F.lit(doubles - 1) - earlier).cast("int").alias("weight")
            ),
        )

    def one(entries: Column, c: Column) -> Column:
        def sign(e: Column) -> Column:
            upper = F.floor(c / e["weight"]) % 2 == 1
            return F.when(e["weight"].isNull(), e["s"]).when(upper, F.substring(e["s"], 2, 1)).otherwise(F.substring(e["s"], 1, 1))

        return F.array_join(F.transform(entries, sign), "")

    return let(
        numbered(signs),
        lambda entries: F.transform(F.sequence(F.lit(0), F.lit(2**doubles - 1)), lambda c: one(entries, c)),
    )


def column_value(column: Column, probs: Column, public: Column, alpha: float) -> Column:
    """Log-probability of a column minus ``alpha`` times its log-popularity."""

    def picked(p: Column, i: Column) -> Column:
        sign = F.substring(column, i + 1, F.lit(1))
        chosen = F.when(sign == "1", p[0]).when(sign == "X", p[1]).otherwise(p[2])
        return F.log(F.least(F.greatest(chosen, F.lit(1e-12)), F.lit(1.0)))

    return total(F.transform(probs, picked)) - alpha * total(F.transform(public, picked))
