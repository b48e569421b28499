"""Small column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from cashweave.schemas import MONEY, TOTAL


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(value: Column) -> Column:
    """A sum of money, or an amount made from one."""
    return value.cast(TOTAL)


def double(value: Column) -> Column:
    return value.cast("double")


def count_where(condition: Column) -> Column:
    """Number of rows where the condition is TRUE (NULL does not count)."""
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def signed(flow_type: Column, amount: Column) -> Column:
    """Inflows count up, anything else counts down."""
    return F.when(flow_type == "inflow", amount).otherwise(-amount)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE; NULL when the denominator is zero."""
    return double(numerator) / F.nullif(double(denominator), F.lit(0.0))


def weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def month_bounds(day: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a month, as literals a scan can push down."""
    first = day.replace(day=1)
    following = (first + dt.timedelta(days=32)).replace(day=1)
    return first, following - dt.timedelta(days=1)


def padded_id(prefix: str, number: Column, width: int = 7) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def dollars(amount: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, digits))


def month_and_day(day: Column) -> Column:
    return F.date_format(day, "MMMM dd")
