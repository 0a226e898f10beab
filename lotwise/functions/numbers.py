"""Numbers and money. Three parsers differ on purpose: see each one's first line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(x: Column, positive: bool = False, allow_negative: bool = False) -> Column:
    """The first number of a text (a blank ends it): `15 707,43` is 15."""
    n = _double(F.translate(F.regexp_extract(x.cast("string"), r"(-?\d+(?:[.,]\d+)?)", 1), ",", "."))
    return F.when(n > 0 if positive else F.lit(True) if allow_negative else n >= 0, n)


def _double(x: Column) -> Column:
    return F.nullif(x, F.lit("")).try_cast("double")


def parse_quantity(x: Column) -> Column:
    """The first number without a sign."""
    return _double(F.translate(F.regexp_extract(x.cast("string"), r"(\d+(?:[.,]\d+)?)", 1), ",", "."))


def parse_money(x: Column) -> Column:
    """All digits of a text as one amount, with millions and billions: `15 707,43` is 15707.43.

    With both separators the right one is the decimal one; a single kind is decimal before
    one or two digits, else it separates thousands. Negative and broken amounts are null.
    """
    text = x.cast("string")
    # array elements are computed once, however often the lambda names them
    parts = F.array(text, F.rtrim(F.regexp_replace(text, r"[^0-9,.\-]+", ""), F.lit(".,")))
    any_text = F.get(F.filter(F.transform(F.array(parts), lambda p: _amount(p[0], p[1])), lambda n: n >= 0), F.lit(0))
    # most amounts are plain numbers, which need none of this
    return F.when(text.isNull(), None).when(text.rlike(r"^[0-9]+(?:\.[0-9]{1,2})?\z"), text.try_cast("double")).otherwise(any_text)


def _amount(text: Column, kept: Column) -> Column:
    """The amount, negative ones too, that the digits and separators of a text make."""
    # the digits after the last separator of each kind
    after_comma, after_dot = F.substring_index(kept, ",", -1), F.substring_index(kept, ".", -1)
    comma, dot = kept.contains(","), kept.contains(".")
    short = lambda tail: F.length(tail).between(1, 2)
    decimal_comma = comma & F.when(dot, F.length(after_comma) < F.length(after_dot)).otherwise(short(after_comma))
    decimal_dot = dot & F.when(comma, F.length(after_dot) < F.length(after_comma)).otherwise(short(after_dot))
    plain = F.when(decimal_comma, F.translate(kept, ",.", ".")).when(decimal_dot, F.translate(kept, ",", "")).otherwise(F.translate(kept, ",.", ""))
    low = F.lower(text)
    times = F.when(~low.contains("мл"), 1.0).when(low.rlike(r"(?U)\bмлрд"), 1e9).when(low.rlike(r"(?U)\bмлн"), 1e6).otherwise(1.0)
    return F.when(kept.rlike("[0-9]"), plain.try_cast("double")) * times


def numbers_in(text: Column, pattern: str, least: float) -> Column:
    """The numbers (decimal comma or dot) that the pattern's first group finds, from `least` on, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.translate(v, ",", ".").try_cast("double"))
    return F.filter(found, lambda v: v >= least)


def round_money(x: Column) -> Column:
    return F.round(x + 1e-12, 2)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, rounded to even at two places; null without a whole."""
    return F.when(whole != 0, F.bround(part.cast("double") / whole.cast("double") * 100, 2))


def format_money(x: Column, unit: str = " руб.") -> Column:
    """Blank between thousands, decimal comma."""
    return F.concat(F.translate(F.format_number(x, 2), ",.", " ,"), F.lit(unit))
