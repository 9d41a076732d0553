"""Number helpers: rounding, digit extraction, threshold tests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Amounts from here on are not money: doubles no longer hold their cents.
AMOUNT_LIMIT = 1e15


def is_amount(c: Column) -> Column:
    """A finite number that a ledger can hold."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < AMOUNT_LIMIT), F.lit(False))


def js_round(c: Column) -> Column:
    """Round half towards +infinity, as an integer."""
    return F.floor(c + F.lit(0.5))


def amount_cents(c: Column) -> Column:
    """Amount rounded to cents, used in keys."""
    return F.round(c, 2)


def exact_amount(c: Column) -> Column:
    """Decimal amount: sums of it do not depend on the order of the rows."""
    return c.try_cast("decimal(24,6)")


def total_amount(c: Column) -> Column:
    """Sum of money, the same for any partitioning."""
    return F.coalesce(F.sum(exact_amount(c)).cast("double"), F.lit(0.0))


def _significant_digits(c: Column) -> Column:
    # plain decimal text (never an exponent), no padding zeros, no point
    text = F.abs(c).try_cast("decimal(38,10)").cast("string")
    text = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.ltrim(F.replace(text, F.lit("."), F.lit("")), F.lit("0"))


def first_digit(c: Column) -> Column:
    return F.nullif(F.substring(_significant_digits(c), 1, 1), F.lit("")).cast("int")


def second_digit(c: Column) -> Column:
    return F.nullif(F.substring(_significant_digits(c), 2, 1), F.lit("")).cast("int")


def just_below(c: Column, thresholds: Iterable[float], margin: float) -> Column:
    """Amount at most ``margin`` under one of the thresholds. A chain of plain
    comparisons rather than an array function, so it stays in generated code."""
    return reduce(or_, [(c < t) & ((F.lit(t) - c) <= margin) for t in thresholds])


def is_round(c: Column, thresholds: Iterable[float], margin: float) -> Column:
    return ((c % 1000) == 0) | just_below(c, thresholds, margin)
