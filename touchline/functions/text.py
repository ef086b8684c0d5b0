"""Text expressions: name folding, encoding repair, number and date parsing, blank tests."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decompositions() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters of the Latin blocks with their accent-free form, derived from Unicode itself."""
    source, target, longer = [], [], []
    for start, stop in ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)):
        for code in range(start, stop):
            char = chr(code)
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if plain == char:
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            else:
                longer.append((char, plain))
    return "".join(source), "".join(target), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _decompositions()
# Plain characters are told by one comparison and never meet the long class.
_LONGER_CLASS = r"(?=[^\x00-\x7F])[" + "".join(c for c, _ in _FOLD_LONGER) + "]"


def _expand_ligatures(text: Column) -> Column:
    out = text
    for char, plain in _FOLD_LONGER:
        out = F.replace(out, F.lit(char), F.lit(plain))
    # Only the few texts that hold such a character walk the replacement chain.
    return F.when(text.rlike(_LONGER_CLASS), out).otherwise(text)


def strip_accents(text: Column, ligatures: bool = True) -> Column:
    """Compatibility-decompose Latin text and drop combining marks."""
    folded = F.translate(_expand_ligatures(text) if ligatures else text, _FOLD_FROM, _FOLD_TO)
    return F.regexp_replace(folded, r"\p{M}+", "")


def _squeeze(text: Column) -> Column:
    # Here and in ``fold_words`` a single space, by far the commonest match, is already what it would become.
    return F.trim(F.regexp_replace(text, r"[\s\u001c-\u001f]{2,}|[\t-\r\u001c-\u001f]", " "))


def fold_name(name: Column) -> Column:
    """Accent-free lower case without dots and with single spaces; NULL becomes empty."""
    return F.coalesce(_squeeze(F.replace(F.lower(strip_accents(name)), F.lit("."), F.lit(""))), F.lit(""))


def fold_words(name: Column) -> Column:
    """Only ``a-z0-9`` words separated by single spaces."""
    folded = strip_accents(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]{2,}|[^a-z0-9 ]", " "))


def fold_key(name: Column) -> Column:
    """Only ``a-z0-9`` characters."""
    return F.regexp_replace(F.lower(strip_accents(name)), "[^a-z0-9]+", "")


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 text once read as Latin-1; anything that cannot be such text is left alone."""
    suspect = text.rlike("[ÃÂ]") & text.rlike(r"^[\x{0}-\x{FF}]*$")
    safe = F.when(suspect, text)
    raw = F.encode(safe, "ISO-8859-1")
    repaired = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))
    return F.coalesce(repaired, text)


def is_reserve_name(name: Column) -> Column:
    words = fold_words(name)
    return words.rlike("(^| )(b|ii|u23|reserves?)$") | words.contains("fortuna")


def clean(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return clean(text) == ""


def all_blank(columns: list[Column]) -> Column:
    """True when no column holds anything but spaces."""
    if not columns:
        return F.lit(True)
    return F.trim(F.concat_ws("", *columns)) == ""


# Digits are bounded so that every accepted text is a finite double.
_NUMBER = r"^[+-]?([0-9]{1,200}\.?[0-9]{0,200}|\.[0-9]{1,200})([eE][+-]?[0-9]{1,2})?$"


def parse_number(text: Column) -> Column:
    """Locale-tolerant finite double: comma or point decimals, otherwise NULL."""
    value = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.regexp_extract(value, _NUMBER, 0).try_cast("double")


# Accepted date layouts, rewritten one after the other to year-month-day.
# Two-digit years pivot at 1969.
_DATE_REWRITES = (
    (r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{4})$", "$4-$3-$1"),
    (r"^([0-9]{1,2})([/-])([0-9]{1,2})\2(69|[7-9][0-9])$", "19$4-$3-$1"),
    (r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{2})$", "20$4-$3-$1"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
    (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([01][0-9]|2[0-3])(:[0-5][0-9]){0,2}([.,][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1"),
)


def parse_date(text: Column) -> Column:
    """First layout that yields a calendar date, otherwise NULL."""
    value = F.trim(text)
    for pattern, target in _DATE_REWRITES:
        value = F.regexp_replace(value, pattern, target)
    return F.regexp_extract(value, "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", 0).try_cast("date")


def infer_season(date: Column) -> Column:
    """Season label that switches on 1 July; without a date the published default season."""
    start = F.year(date) - F.when(F.month(date) >= 7, 0).otherwise(1)
    label = F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))
    return F.coalesce(label, F.lit("2025-2026"))


def season_index(season: Column) -> Column:
    """Start year of a season label, 0 when it has none."""
    return F.coalesce(F.split_part(season, F.lit("-"), F.lit(1)).try_cast("int"), F.lit(0))
