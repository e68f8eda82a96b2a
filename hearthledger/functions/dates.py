"""Dates as statements print them, with or without a year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthledger.functions.columns import let

#: Days beyond a statement's period on which its rows may still be dated.
SLACK_DAYS = 5
#: A date without a year that would be more than this after the anchor is of the year before.
AHEAD_DAYS = 31
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_FULL = "january february march april may june july august september october november december".split()


def day(year: Column, month: Column, day_: Column) -> Column:
    """A date of three numbers; null if there is no such day."""
    padded = lambda n, width: F.lpad(n.cast("int").cast("string"), width, "0")
    return F.when(year.between(1, 9999) & month.between(1, 12) & day_.between(1, 31), F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day_, 2)).try_cast("date"))


def month_of(name: Column) -> Column:
    """The number of an English month's name, whole or its first three letters; null for another word."""
    known = F.lit([*_MONTHS, *_FULL])
    place = F.array_position(known, F.lower(F.regexp_replace(name, r"\.$", "")))
    return F.when(place > 0, (place - 1) % 12 + 1).cast("int")


def parts(text: Column) -> Column:
    """A struct (month, day, year) of a printed date; year is null where none is printed, all are where it is no date.

    `6/3/2026`, `06-03-26`, `6/3`, `Jun 3, 2026`, `June 3 2026`, `Jun 3`. A year of two digits from 69 on is of the last century.
    """
    number, words = r"^(\d{1,2})([/-])(\d{1,2})(?:\2(\d{4}|\d{2}))?$", r"^([A-Za-z]+)\.? (\d{1,2})(?:,? (\d{4}))?$"

    def read(bare: Column) -> Column:
        got = lambda shape, *ks: [F.regexp_extract(bare, shape, k) for k in ks]
        month, day_, year = got(number, 1, 3, 4)
        name, of_month, full_year = got(words, 1, 2, 3)
        numeric = F.struct(month.try_cast("int").alias("m"), day_.try_cast("int").alias("d"), year.alias("y"))
        named = F.struct(month_of(name).alias("m"), of_month.try_cast("int").alias("d"), full_year.alias("y"))
        return F.when(bare.rlike(number), numeric).when(bare.rlike(words), named)

    def checked(p: Column) -> Column:
        short = F.when(p["y"] != "", p["y"].try_cast("int"))  # a failing cast costs an exception, also where it is tried
        year = F.when(F.length(p["y"]) == 2, short + F.when(short < 69, 2000).otherwise(1900)).otherwise(short)
        # Without a year 29 February is a day, as in a leap year.
        real = day(F.coalesce(year, F.lit(2000)), p["m"], p["d"]).isNotNull()
        return F.when(real, F.struct(p["m"].alias("month"), p["d"].alias("day"), year.alias("year")))

    return let(let(F.trim(text), read), checked)


def full(text: Column) -> Column:
    """A printed date that has a year; else null."""
    return let(parts(text), lambda p: F.when(p["year"].isNotNull(), day(p["year"], p["month"], p["day"])))


def in_period(p: Column, start: Column, end: Column) -> Column:
    """The date of `parts`: its own year, else the earlier year of the period's two with which it lies in the period, give or take SLACK_DAYS.

    Null where neither does: the reader reports such a row.
    """
    low, high = F.date_sub(start, SLACK_DAYS), F.date_add(end, SLACK_DAYS)

    def placed(q: Column) -> Column:
        tried = [let(day(year, q["month"], q["day"]), lambda d: F.when(d.between(low, high), d)) for year in (F.year(start), F.year(end))]
        return F.coalesce(day(q["year"], q["month"], q["day"]), *tried)

    return let(p, placed)


def near_anchor(p: Column, anchor: Column) -> Column:
    """The date of `parts`: its own year, else the anchor's, or the year before if that would be over AHEAD_DAYS after it."""
    def placed(q: Column) -> Column:
        same = day(F.year(anchor), q["month"], q["day"])
        before = day(F.year(anchor) - 1, q["month"], q["day"])
        return F.coalesce(day(q["year"], q["month"], q["day"]), F.when(same > F.date_add(anchor, AHEAD_DAYS), before).otherwise(same))

    return let(p, placed)
