"""Odds expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import settings
from touchline.functions.text import parse_number


# Prefix of parsed odds columns.
PARSED = "_parsed_"
_NUMBERS = "_numbers"


def normalise_result(code: Column) -> Column:
    text = F.upper(F.trim(code.cast("string")))
    return (
        F.when(text.isin("H", "1", "0", "0.0"), "1")
        .when(text.isin("D", "X", "1.0"), "X")
        .when(text.isin("A", "2", "2.0"), "2")
    )


def result_from_goals(home: Column, away: Column) -> Column:
    return F.when(home > away, "1").when(home < away, "2").when(home == away, "X")


def with_parsed_odds(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Parse every odds column, and those of ``more``, once, into columns the lookups below read.

    All texts pass through one function over their array: a method for each column would make the generated code too long.
    """
    parsed = [c for c in (*more, *settings.odds_columns()) if c in df.columns]
    if not parsed:
        return df
    numbers = F.transform(F.array(*[F.col(c).cast("string") for c in parsed]), parse_number)
    read = df.withColumn(_NUMBERS, numbers)
    return read.withColumns({f"{PARSED}{c}": F.get(_NUMBERS, F.lit(i)) for i, c in enumerate(parsed)}).drop(_NUMBERS)


def without_parsed_odds(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(PARSED)])


def _present(columns: Sequence[str], available: Sequence[str]) -> list[tuple[str, Column]]:
    known = set(available)
    return [
        (c, F.col(f"{PARSED}{c}") if f"{PARSED}{c}" in known else parse_number(F.col(c))) for c in columns if c in known
    ]


def first_valid_odds(columns: Sequence[str], available: Sequence[str]) -> Column:
    """First column, in order of preference, that holds playable odds."""
    values = [F.when(value > settings.MIN_ODDS, value) for _, value in _present(columns, available)]
    return F.coalesce(*values) if values else F.lit(None).cast("double")


def first_valid_source(columns: Sequence[str], available: Sequence[str]) -> Column:
    """Name of the column ``first_valid_odds`` takes its value from."""
    names = [F.when(value > settings.MIN_ODDS, name) for name, value in _present(columns, available)]
    return F.coalesce(*names) if names else F.lit(None).cast("string")


def _triplet(table: Mapping[str, Sequence[str]], pick, available: Sequence[str]) -> Column:
    one, draw, two = (pick(table[sign], available) for sign in settings.SIGNS)
    complete = one.isNotNull() & draw.isNotNull() & two.isNotNull()
    return F.when(complete, F.struct(one.alias("one"), draw.alias("draw"), two.alias("two")))


def odds_triplet(table: Mapping[str, Sequence[str]], available: Sequence[str]) -> Column:
    """Struct of three odds, NULL unless all three exist."""
    return _triplet(table, first_valid_odds, available)


def odds_triplet_sources(table: Mapping[str, Sequence[str]], available: Sequence[str]) -> Column:
    return _triplet(table, first_valid_source, available)


def overround(triplet: Column) -> Column:
    return 1.0 / triplet["one"] + 1.0 / triplet["draw"] + 1.0 / triplet["two"]


def is_suspicious(
    value: Column, low: float = settings.OVERROUND_MIN, high: float = settings.OVERROUND_MAX
) -> Column:
    return (value < low) | (value > high)


def market_move(opening: Column, closing: Column, has_close: Column) -> list[Column]:
    """Change of the three implied probabilities, NULL when there is no real close."""
    out = []
    for field, name in (("one", "market_move_1"), ("draw", "market_move_x"), ("two", "market_move_2")):
        move = (1.0 / closing[field]) / overround(closing) - (1.0 / opening[field]) / overround(opening)
        out.append(F.when(has_close, move).alias(name))
    return out


def implied_probabilities(odds: Sequence[str], names: Sequence[str]) -> dict[str, Column]:
    """Normalised inverse odds. Odds of 0 count as missing and the margin sums what is present."""
    inverse = [F.when(F.col(c) != 0, 1.0 / F.col(c)) for c in odds]
    margin = sum((F.coalesce(i, F.lit(0.0)) for i in inverse), F.lit(0.0))
    return {
        name: F.when(i.isNotNull(), i / margin) for name, i in zip(names, inverse)
    }


def percent_to_probs(percent: Column) -> Column:
    """Struct of percentages by sign to an array of probabilities; NULL if incomplete or empty."""
    parts = [percent[s].cast("double") for s in settings.SIGNS]
    total = parts[0] + parts[1] + parts[2]
    return F.when(total > 0, F.array(*[p / total for p in parts]))


def row_probs(columns: Sequence[str]) -> Column:
    """Three columns to a normalised array; NULL if any is missing or the sum is not positive."""
    parts = [F.col(c).cast("double") for c in columns]
    total = parts[0] + parts[1] + parts[2]
    return F.when(total > 0, F.array(*[p / total for p in parts]))
