"""Dates, pay and amounts as Column expressions.  "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_valid(text: Column, first: int = 1900, last: int = 2100) -> Column:
    """``YYYY-MM-DD`` of the calendar, between two years."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull() & F.substring(text, 1, 4).try_cast("int").between(first, last), F.lit(False))


def years_between(start: Column, end: Column) -> Column:
    """Whole years by comparing month and day: 29 February to 28 February next year is none."""
    before = (F.month(end) * 100 + F.dayofmonth(end)) < (F.month(start) * 100 + F.dayofmonth(start))
    return (F.year(end) - F.year(start) - before.cast("int")).cast("long")


def validity(status: Column, until: Column, today: Column) -> Column:
    """expired, expiring (within 30 days) or valid, for what one has; null otherwise or without a date."""
    left = F.datediff(until, today)
    return F.when((status == "have") & until.isNotNull(), F.when(left < 0, "expired").when(left <= 30, "expiring").otherwise("valid"))


def div(a: Column, b: Column | int) -> Column:
    """Integer division towards zero."""
    b = F.lit(b) if isinstance(b, int) else b
    a, b = a.cast("long"), b.cast("long")
    return ((a - a % b) / b).cast("long")


def vacation_days(years: Column) -> Column:
    """12 in the first year, two more in each of the next four, then two more every five years; none before a year."""
    return F.when(years < 1, 0).when(years <= 5, 10 + 2 * years).otherwise(20 + 2 * (1 + div(years - 6, 5))).cast("long")


def monthly_pay(amount: Column, every: Column) -> Column:
    """A weekly amount times 30 by 7, rounded half up; a biweekly one doubled; a monthly one as it is."""
    return F.when(every == "weekly", div(amount * 30 + 3, 7)).when(every == "biweekly", amount * 2).otherwise(amount).cast("long")


def annual_benefits(salary: Column, vacation: Column) -> Column:
    """Fifteen days of bonus and a quarter of the vacation days' pay, each rounded half up."""
    return div(salary * 15 + 15, 30) + div(salary * vacation + 60, 120)


def monthly_cost_each(expense: Column, people: Column) -> Column:
    return F.when(people > 0, F.floor((expense + 6 * people) / (12 * people))).cast("long")


def occupied(people: Column, capacity: Column) -> Column:
    """Percent, rounded half up and at most 100; null without a capacity."""
    return F.when(capacity > 0, F.least(div(people * 100 + div(capacity, 2), capacity), F.lit(100))).cast("long")


def lockout_seconds(failures: Column) -> Column:
    return F.when(failures < 5, 0).otherwise(F.least(F.lit(900), 30 * F.pow(F.lit(2.0), F.least(failures - 5, F.lit(10))))).cast("long")


def locale_number(text: Column) -> Column:
    """A number written with commas, points or blanks between groups of three, or with a decimal comma; null otherwise.

    One group after a point is decimals (``1.250`` is 1.25); two or more are thousands.  A last point or comma is dropped.
    """
    t = F.regexp_replace(F.trim(text), "[.,]+$", "")
    plain = F.regexp_replace(t, "[, ]", "")
    swapped = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(t.rlike(r"^[0-9]{1,3}([, ][0-9]{3})+(\.[0-9]+)?$"), plain)
        .when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{3}){2,}(,[0-9]+)?$") | t.rlike(r"^[0-9]+,[0-9]{1,2}$"), swapped)
        .when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain)
        .try_cast("double")
    )


def pesos(text: Column) -> Column:
    """Whole units with optional sign ``$`` and groups of three after commas, blanks or points; null for cents or other groups."""
    t = F.trim(F.regexp_replace(F.trim(text), r"^\$", ""))
    return F.when(t.rlike("^([0-9]+|[0-9]{1,3}([, .][0-9]{3})+)$"), F.regexp_replace(t, "[, .]", "")).try_cast("long")


def annual(amount: Column, period: Column) -> Column:
    """What an amount is worth in a year: twelve times a monthly one."""
    return F.when(period == "monthly", amount * 12).otherwise(amount).cast("long")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("long")


def add_days(day: Column, days: Column | int) -> Column:
    return F.date_add(day, days)


def banded(value: Column, bands: list[tuple[str, float]], last: str) -> Column:
    """The name of the first band (name, upper bound, itself outside) that holds a value; ``last`` beyond all; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, below in bands:
        out = out.when(value < below, name)
    return out.otherwise(last)


#: Seniority in years, and age bands of two kinds of institution.
SENIORITY = ([("under 1", 1), ("1 to 4", 5), ("5 to 9", 10)], "10 and over")
