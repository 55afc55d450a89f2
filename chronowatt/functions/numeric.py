"""Number expressions: exact money sums, safe ratios, half-up rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cents(col: Column | str) -> Column:
    """A two-decimal amount as whole cents.

    Whole-number sums do not depend on the order in which shuffled partials arrive, so a retried
    task gives the same total to the last bit.
    """
    return F.round(_c(col) * 100).cast("bigint")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL instead of an error or infinity when the denominator is zero."""
    return _c(numerator) / F.nullif(_c(denominator), F.lit(0))


def percent(part: Column | str, whole: Column | str) -> Column:
    return ratio(100.0 * _c(part), whole)


def percent_of_sums(part: Column | str, whole: Column | str) -> Column:
    """Ratio of sums, never a mean of ratios."""
    return percent(F.sum(_c(part)), F.sum(_c(whole)))


def clamp0(col: Column | str) -> Column:
    return F.greatest(_c(col), F.lit(0))


def half_up(col: Column | str) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(_c(col) + 0.5)


def displayed_percent(part: Column | str, whole: Column | str) -> Column:
    """Whole percentage of two *displayed* (already rounded) quantities, in exact integers."""
    a, b = half_up(part), half_up(whole)
    return F.floor((200 * a + b) / (2 * b))


def total(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [_c(c) for c in cols])


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, _c(value)))


def avg_if(condition: Column, value: Column | str) -> Column:
    return F.avg(F.when(condition, _c(value)))


def stable(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the nudge keeps decimal ties on one side whatever the sum order."""
    return F.round(_c(col) + F.lit(10.0 ** -(digits + 3)), digits)


# What a number in text looks like, the special ones in any case; every other text is NULL without a cast being tried.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def number(text: Column | str) -> Column:
    """Text as double, NULL where it is no number. A failed cast costs an exception a row, so the form is tested
    first."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(NUMBER), c.try_cast("double"))
