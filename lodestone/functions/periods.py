"""Half-years, years and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(period: Column) -> Column:
    """[X13] "2010-H1" to 4020; other texts to null."""
    ok = period.rlike(r"^\d{4}-H[12]$")
    return F.when(ok, F.substring(period, 1, 4).cast("long") * 2 + F.substring(period, 7, 1).cast("long") - 1)


def period_of(index: Column) -> Column:
    return F.format_string("%04d-H%d", F.floor(index / 2), index % 2 + 1)


def half_of(date: Column) -> Column:
    """[X13] The index of a date's half-year."""
    return F.year(date).cast("long") * 2 + (F.month(date) > 6).cast("long")


def term_index(term: Column) -> Column:
    """"2023-spring" and "2023-fall"."""
    return F.when(term.rlike(r"^\d{4}-(spring|fall)$"), F.substring(term, 1, 4).cast("long") * 2 + term.endswith("fall").cast("long"))


def year_label(years: Column) -> Column:
    """[W17] Sorted years as runs: "2001–2003, 2005"."""
    starts = F.filter(years, lambda y: ~F.array_contains(years, y - 1))
    ends = F.filter(years, lambda y: ~F.array_contains(years, y + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string"))))
    return F.array_join(runs, ", ")


def era_bounds(label: Column) -> Column:
    """[X25] (from, to) of the years in brackets at a label's end: "(~2010)", "(2011-13)", "(2020-)"."""
    inside = F.regexp_extract(label, r"\(([^()]*)\)\s*$", 1)
    a, b = F.regexp_extract(inside, r"^\s*(\d{4})", 1), F.regexp_extract(inside, r"[-–~]\s*(\d{4}|\d{2})\s*$", 1)
    start = F.when(a != "", a.cast("int"))
    end = F.when(F.length(b) == 4, b.cast("int")).when(F.length(b) == 2, F.concat(F.substring(a, 1, 2), b).cast("int")).when(inside.rlike(r"^\s*\d{4}\s*$"), start)
    return F.struct(start.alias("start"), end.alias("end"))
