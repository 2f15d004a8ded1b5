"""Dates of noisy records as native column expressions. Today is always the explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import col

FIRST_YEAR = 2000
#: Month names in Spanish and English.
MONTHS = {"ENE": 1, "JAN": 1, "FEB": 2, "MAR": 3, "ABR": 4, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AGO": 8, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DIC": 12, "DEC": 12}


def year_is_possible(year: str | Column, as_of: Column) -> Column:
    return col(year).between(FIRST_YEAR, F.year(as_of))


def month_is_possible(year: str | Column, month: str | Column, as_of: Column) -> Column:
    """Not after ``as_of``'s month."""
    return year_is_possible(year, as_of) & col(month).between(1, 12) & (col(year) * 12 + col(month) <= F.year(as_of) * 12 + F.month(as_of))


def date_is_possible(value: str | Column, as_of: Column, allow_month_end: bool = False) -> Column:
    ok = col(value) <= as_of
    if allow_month_end:
        ok = ok | ((col(value) == F.last_day(col(value))) & (F.last_day(col(value)) == F.last_day(as_of)))
    return ok & (F.year(col(value)) >= FIRST_YEAR)


def month_end(value: str | Column, as_of: Column) -> Column:
    """The last day of a month that isn't in the future; null otherwise."""
    return F.when(month_is_possible(F.year(col(value)), F.month(col(value)), as_of), F.last_day(col(value)))


def usual_start(as_of: Column) -> Column:
    """The first day of the month before."""
    return F.add_months(F.trunc(as_of, "MM"), -1)


def review_start(as_of: Column) -> Column:
    """The first of January, of the year before while it is January."""
    return F.make_date(F.year(as_of) - F.when(F.month(as_of) == 1, 1).otherwise(0), F.lit(1), F.lit(1))


def needs_review_for_age(value: str | Column, as_of: Column) -> Column:
    return col(value) < review_start(as_of)


def days_outside_usual(value: str | Column, as_of: Column) -> Column:
    """Days before the usual window or after ``as_of``; zero inside."""
    return F.greatest(F.datediff(usual_start(as_of), col(value)), F.datediff(col(value), as_of), F.lit(0))


def years_outside_usual(value: str | Column, as_of: Column) -> Column:
    return F.floor(days_outside_usual(value, as_of) / 365).cast("int")


def full_year(year: str | Column, as_of: Column) -> Column:
    """Two digits as a year of this century; null outside the window."""
    y = F.when(col(year) < 100, col(year) + 2000).otherwise(col(year))
    return F.when(year_is_possible(y, as_of), y)


def checked_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """A calendar date or null."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", col(year).cast("int"), col(month).cast("int"), col(day).cast("int")), "yyyy-MM-dd")


def month_number(c: str | Column) -> Column:
    """A month from its number or exact name; null otherwise."""
    raw = F.upper(F.trim(col(c)))
    out = F.when(raw.rlike("^[0-9]{1,2}$") & raw.try_cast("int").between(1, 12), raw.try_cast("int"))
    for name, n in MONTHS.items():
        out = out.when(raw == name, n)
    return out


def any_date(c: str | Column, as_of: Column) -> Column:
    """A date in one of several forms: day and month name, day first, or month first."""
    raw = F.upper(F.trim(col(c)))
    named = rf"([0-9]{{1,2}})\s*({'|'.join(MONTHS)})[A-Z]*\s*([0-9]{{2,4}})"
    plain = r"([0-9]{1,2})\s*[/\-\s]\s*([0-9]{1,2})\s*[/\-\s]\s*([0-9]{2,4})"
    part = lambda p, k: F.regexp_extract(raw, p, k)
    number = lambda p, k: part(p, k).try_cast("int")
    by_name = checked_date(full_year(number(named, 3), as_of), month_number(part(named, 2)), number(named, 1))
    year = full_year(number(plain, 3), as_of)
    return F.coalesce(by_name, checked_date(year, number(plain, 2), number(plain, 1)), checked_date(year, number(plain, 1), number(plain, 2)))


def reformat(c: str | Column, given: str, wanted: str) -> Column:
    """A date text in another form; null if it isn't a date."""
    return F.date_format(F.try_to_date(col(c), given), wanted)


def month_key(value: str | Column, none: str = "sin_fecha") -> Column:
    return F.coalesce(F.date_format(col(value), "yyyy-MM"), F.lit(none))


def remaining_seconds(total: Column, done: Column, elapsed: Column, cached_ms: Column, warm_up: int = 20) -> Column:
    """Seconds left, from a cached pace and the observed one: the observed one weighs up to nine tenths as rows get done."""
    observed = F.try_divide(elapsed * 1000, done)
    weight = F.least(F.lit(0.9), done / warm_up)
    pace = F.coalesce(observed * weight + cached_ms * (1 - weight), observed, cached_ms)
    return F.greatest(total - done, F.lit(0)) * pace / 1000
