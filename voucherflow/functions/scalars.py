"""Scalar expressions. All are built-in functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HOLIDAYS, MISSING, WORKDAYS


def to_day(c: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to a day; null if it is none. One format only, as mixed formats are a sign of damage."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(fmt)).cast("date")


def to_long(c: str | Column) -> Column:
    """Text to a whole number; null if it is none or has a fraction."""
    number = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def money_to_cents(c: str | Column) -> Column:
    """Text to cents, halves to even; null if it is no finite number."""
    number = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < 9e16)
    return F.when(finite, F.rint(number * 100).cast("long"))


def missing(c: str) -> Column:
    """A code that is null or the sentinel."""
    return F.col(c).isNull() | (F.col(c) == MISSING)


def both(f, a: Column, b: Column) -> Column:
    """``f`` (greatest or least) of two columns, null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def ratio(n: Column, d: Column, digits: int = 3) -> Column:
    """n / d for whole numbers, rounded half away from zero to ``digits`` places, in integer arithmetic; 0 if d is 0."""
    scale = 10**digits
    size = F.call_function("div", 2 * scale * F.abs(n) + F.abs(d), 2 * F.abs(d)) / F.lit(float(scale))
    return F.when(d == 0, F.lit(0.0)).otherwise(F.signum(n) * F.signum(d) * size + 0.0)


def amount_bin(c: str, splits: list[int]) -> Column:
    """Up to the first split 0, up to the second 1, else 2; null is 2 as well."""
    return F.when(F.col(c) <= splits[0], 0).when(F.col(c) <= splits[1], 1).otherwise(2)


def expiry_bin(days: int = 10) -> Column:
    """Valid for at most so many days 0, longer 1, ends before it starts or unknown -1."""
    span = F.datediff("End_date", "Start_date")
    return F.when(span.between(0, days), 0).when(span > days, 1).otherwise(-1)


def generosity() -> Column:
    return F.col("Coupon_amt_cent") / (F.col("Price_limit_cent") + 1)


def before_receipt(c: str) -> Column:
    """1 if the date is before the receipt's, 0 if not, null if either is unknown."""
    return (F.col(c) < F.col("Receive_date")).cast("int")


def weekday_marker(c: str = "Receive_date") -> Column:
    return F.coalesce((F.weekday(c) < 5).cast("int"), F.lit(0))


def listed_day(days: Iterable[date], c: str = "Receive_date") -> Column:
    """1 on the days listed, else 0."""
    days = list(days)
    return F.coalesce(F.col(c).isin(days).cast("int"), F.lit(0)) if days else F.lit(0)


def workday_marker(days: Iterable[date] = WORKDAYS) -> Column:
    """Marks make-up working days only, not ordinary ones."""
    return listed_day(days)


def holiday_marker(days: Iterable[date] = HOLIDAYS) -> Column:
    return listed_day(days)


def sigmoid(c: str | Column) -> Column:
    return 1 / (1 + F.exp(-(F.col(c) if isinstance(c, str) else c)))


OPERATORS = {
    "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
}


def dnf(filters: list) -> Column | None:
    """[[(column, op, value), ...] AND inside, OR between the lists]; a flat list is one AND; None if nothing is filtered."""
    groups = [filters] if filters and isinstance(filters[0], tuple) else filters
    if not groups or any(not g for g in groups):
        return None  # an empty AND is true
    terms = [reduce(lambda a, b: a & b, [OPERATORS[op](F.col(c), v) for c, op, v in g]) for g in groups]
    return reduce(lambda a, b: a | b, terms)


def also(filters: list[list[tuple]], term: tuple) -> list[list[tuple]]:
    """The DNF with one more term in every AND; the caller's lists stay as they are."""
    return [[*g, term] for g in filters]
