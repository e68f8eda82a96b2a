"""Periods: buckets of dates and month numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(date_col: str, grain: str) -> Column:
    """day, week (Monday first; week 00 comes before the first Monday), month, quarter, year or all."""
    d = F.col(date_col)
    year = F.date_format(d, "yyyy")
    if grain == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if grain == "week":
        week = F.expr(f"(dayofyear({date_col}) + 6 - weekday({date_col})) div 7")
        return F.concat(year, F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    if grain == "month":
        return F.date_format(d, "yyyy-MM")
    if grain == "quarter":
        return F.concat(year, F.lit("-Q"), F.quarter(d).cast("string"))
    return year if grain == "year" else F.lit("all")


def month_number(year: str = "year", month: str = "month") -> Column:
    return (F.col(year) * 12 + F.col(month) - 1).cast("int")


def month_label(number: str) -> Column:
    return F.format_string("%04d-%02d", F.expr(f"{number} div 12").cast("int"), (F.col(number) % 12 + 1).cast("int"))
