"""Dates written in several formats, and what ids and periods say about time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import year_from_id

FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy")


def parse_date(c: Column) -> Column:
    """The first format that fits; null for anything else."""
    return F.coalesce(*(F.try_to_date(c, f) for f in FORMATS))


def year_from_date(c: Column) -> Column:
    """Part 0 of a date cut at ``-``; of one cut at ``/`` the last part if it has four digits, else the first."""
    dash, slash = F.split(c, "-"), F.split(c, "/")
    last = F.element_at(slash, -1)
    y = F.when(F.contains(c, F.lit("-")), dash[0]).when(F.contains(c, F.lit("/")), F.when(F.length(last) == 4, last).otherwise(slash[0]))
    return y.try_cast("int")


def article_year(date: Column, id: Column) -> Column:
    """The year of the date, else of the id."""
    return F.coalesce(F.year(parse_date(date)), year_from_id(id))


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def five_year_range(year: Column, first: int = 1960, last: int = 2000) -> Column:
    """``1960-1965`` and so on, left-closed; the last range holds its end, too."""
    start = F.when(year == last, last - 5).otherwise(F.floor((year - first) / 5) * 5 + first)
    return F.when((year >= first) & (year <= last), F.concat(start.cast("string"), F.lit("-"), (start + 5).cast("string")))
