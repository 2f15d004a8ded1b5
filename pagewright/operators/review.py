"""What goes to review: index readiness, discrepancy classes, date windows, trusted readings and guards, as native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.dates import date_is_possible, review_start
from pagewright.operators.status import LOG_NUMBER, REGISTRATION, legible

#: Sources that are no reading of the page itself, and the votes that an inferred registration needs.
DERIVED = ("inferred", "book_correction")
INFERRED_REGISTRATION = ("book_correction", "fleet_validation", "inferred")
LEAST_VOTES = 2
#: Notes that make a reading no anchor, the least confidences, and how a month is read from its cells.
UNSURE_NOTES = ("fuzzy", "numeric handwritten month", "low confidence", "conflicts with", "regression")
UNSURE_CELLS = ("fuzzy", "numeric handwritten month", "conflict")
DIRECT, POSITIONAL = 0.5, 0.35
CELL_METHODS = ("ranuras", "date_cells")
#: The signatures that each kind of page needs.
MAINTENANCE, FLIGHT = ("pilot", "technician", "technician_license"), ("pilot", "captain", "captain_license")
OWN_REASONS = ("old date", "future year", "future date")


def field(fields: str, field_id: str) -> Column:
    return F.get(F.filter(fields, lambda f: f.field_id == field_id), F.lit(0))


def ready_for_index(fields: str, blank: Column, date_review: Column) -> Column:
    """Whether a page needs no hand: both identifiers legible and OK, and an inferred registration has votes enough."""
    reg, log = field(fields, "matricula"), field(fields, "log_number")
    votes = F.coalesce(reg.votes >= LEAST_VOTES, ~F.coalesce(reg.source.isin(*INFERRED_REGISTRATION), F.lit(False)))
    ok = legible(fields, "matricula", REGISTRATION) & (reg.status == "OK") & votes & legible(fields, "log_number", LOG_NUMBER) & (log.status == "OK")
    return ~blank & ~date_review & F.coalesce(ok, F.lit(False))


def needs_review(fields: str, blank: Column, *flags: Column) -> Column:
    """Whether a page goes to a person: blank, flagged, or without a legible identifier."""
    out = blank | ~legible(fields, "matricula", REGISTRATION) | ~legible(fields, "log_number", LOG_NUMBER)
    for flag in flags:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def discrepancy(present: Mapping[str, Column], void: Column, selected: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The signatures that a page lacks: a struct of kind, category, fields and by_correction; null if it lacks none.

    ``present`` says of each signature, the technician's licence and the correction block whether it is there (null:
    unclear). ``selected`` keeps, for each kind, only the named fields; pages of unclear kind are not filtered.
    """
    p, yes, no = present, lambda c: F.coalesce(c, F.lit(False)), lambda c: F.coalesce(~c, F.lit(False))
    unused = no(p["technician_license"]) & no(p["captain"]) & no(p["captain_license"]) & no(p["pilot"]) & ~yes(p["correction"])
    maintenance = yes(p["technician_license"]) | yes(p["correction"])
    by_correction = yes(p["correction"]) & ~yes(p["technician_license"])
    flight = no(p["technician_license"]) & (yes(p["captain"]) | yes(p["captain_license"]) | yes(p["pilot"]))
    kind = F.when(maintenance, F.when(by_correction, "correction").otherwise("maintenance")).when(flight, "flight").otherwise("unclear")
    lack = lambda n, sure=True: F.when(p[n].isNull(), F.struct(F.lit(n).alias("field"), F.lit("uncertain").alias("category"))).when(F.lit(sure) & ~p[n], F.struct(F.lit(n).alias("field"), F.lit("missing").alias("category")))

    def affected(names: Sequence[str], name: str) -> Column:
        kept = [n for n in names if selected is None or n in selected.get(name, names)]
        return F.array_compact(F.array(*map(lack, kept))) if kept else F.array().cast("array<struct<field:string,category:string>>")

    unclear = F.array_compact(F.array(lack("technician_license", False), lack("captain", False), lack("captain_license", False), lack("pilot")))
    fields = F.when(kind == "maintenance", affected(MAINTENANCE, "maintenance")).when(kind == "correction", affected(MAINTENANCE, "correction")).when(kind == "flight", affected(FLIGHT, "flight")).otherwise(unclear)
    category = F.when(F.exists(fields, lambda f: f.category == "missing"), "missing").otherwise("uncertain")
    out = F.struct(kind.alias("kind"), category.alias("category"), fields.alias("fields"), by_correction.alias("by_correction"))
    return F.when(~void & ~unused & ((kind == "unclear") | (F.size(fields) > 0)), out)


def date_window_issue(date: Column, year: Column, month: Column, day: Column, month_end: Column, as_of: Column, supported: Column) -> Column:
    """Why a date can't be taken as it is; empty if it can. Without a date its parts are tried, a missing day as the first.

    ``supported`` are the years that the page's book has read itself: an old date of one of them is no issue.
    """
    y = F.coalesce(F.year(date), year)
    value = F.coalesce(date, F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, F.coalesce(day, F.lit(1))), "yyyy-MM-dd"))
    late = (value > as_of) & ~F.when(month_end, date_is_possible(value, as_of, True)).otherwise(date_is_possible(value, as_of))
    old = (value < review_start(as_of)) & ~F.coalesce(F.array_contains(supported, F.year(value)), F.lit(False))
    text = F.date_format(value, "yyyy/MM/dd")
    reason = F.when(y > F.year(as_of), F.concat(F.lit("future year "), y.cast("string"))).when(late, F.concat(F.lit("future date "), text)).when(old, F.concat(F.lit("old date "), text))
    return F.coalesce(reason, F.lit(""))


def with_own_reason(comment: Column, issue: Column) -> Column:
    """A comment's reasons with the window's own one taken out and ``issue`` put at its end."""
    parts = F.filter(F.split(F.coalesce(comment, F.lit("")), r" \| "), lambda x: (x != "") & ~F.exists(F.array(*map(F.lit, OWN_REASONS)), lambda o: x.startswith(o)))
    return F.array_join(F.when(issue != "", F.array_append(parts, issue)).otherwise(parts), " | ")


def is_direct_anchor(part: Column, value: Column) -> Column:
    """A reading to be trusted: the page's own, OK, confident, without alternatives or doubtful notes. ``part``: a field struct."""
    doubtful = F.exists(F.array(*map(F.lit, UNSURE_NOTES)), lambda t: F.lower(F.coalesce(part.comment, F.lit(""))).contains(t))
    ok = value.isNotNull() & ~F.coalesce(part.source.isin(*DERIVED), F.lit(False)) & (part.status == "OK") & (part.confidence >= DIRECT) & (F.size(part.alternatives) == 0) & ~doubtful
    return F.coalesce(ok, F.lit(False))


def is_positional_month(part: Column, value: Column) -> Column:
    """A month put together from its cells, trusted although it is a warning."""
    doubtful = F.exists(F.array(*map(F.lit, UNSURE_CELLS)), lambda t: F.lower(F.coalesce(part.comment, F.lit(""))).contains(t))
    ok = value.isNotNull() & (part.status == "WARNING") & (part.confidence >= POSITIONAL) & part.inference_method.isin(*CELL_METHODS) & ~F.coalesce(part.source.isin(*DERIVED), F.lit(False)) & (F.size(part.alternatives) == 0) & ~doubtful
    return F.coalesce(ok, F.lit(False))


def book_anchor(part: Column, value: Column, aligned: Column, is_month: bool = False) -> Column:
    """Whether a reading may stand for its book."""
    direct = is_direct_anchor(part, value)
    return F.coalesce(aligned, F.lit(False)) & ((direct | is_positional_month(part, value)) if is_month else direct)


def confirmed_date(day: Column, month: Column, year: Column, anchors: Column, as_of: Column) -> Column:
    """A page's date if all its parts are anchors and it is possible."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    return F.when(anchors & date_is_possible(date, as_of), date)


def out_of_window(year: Column, month: Column, day: Column, as_of: Column) -> Column:
    """The part of a reading that lies after ``as_of``: ``year``, ``month`` or ``day``; null if none does."""
    late_month = (year == F.year(as_of)) & (month > F.month(as_of))
    late_day = (year == F.year(as_of)) & (month == F.month(as_of)) & (day > F.dayofmonth(as_of))
    return F.when(year > F.year(as_of), "year").when(late_month, "month").when(late_day, "day")


def unresolved_parts(day: Column, month: Column, year: Column) -> Column:
    """The parts of a date that can't be read; ``calendar`` if all can but make no date."""
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in (("day", day), ("month", month), ("year", year))]))
    wrong = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").isNull()
    return F.when(F.size(missing) > 0, missing).when(wrong, F.array(F.lit("calendar"))).otherwise(F.array().cast("array<string>"))


def repeated_numbers(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key an earlier row has, and that first row's place."""
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("first_place"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, F.col(key) == F.col("_key")).where(F.col(order) > F.col("first_place")).drop("_key")


def against_registry(rows: DataFrame, registry: DataFrame, book: str, value: str) -> DataFrame:
    """Rows with another value than the registry has for their book, and that value as ``expected``."""
    known = registry.select(F.col(book).alias("_book"), F.col(value).alias("expected"))
    return rows.join(known, F.col(book) == F.col("_book")).where((F.col(value) != "") & (F.col(value) != F.col("expected"))).drop("_book")


def count_verdict(expected: Column, found: Column, removed: Column) -> Column:
    """Whether a batch holds the pages it should: all, or all but the separators that were removed."""
    return F.when((found == expected) | ((removed > 0) & (found == expected - removed)), "ok").when(found <= 0, "unknown").when(found < expected, "missing").otherwise("extra")
