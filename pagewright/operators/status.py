"""Page status, review and rule predicates over arrays of field structs (field_id, value, status, confidence, source, votes)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that never decide a page's status, and what legible identifiers and parts of dates look like.
NEVER_DECIDE = r"signature|_cell|^(day|month|year)_[0-9]$|^flight_number$"
LOG_NUMBER, REGISTRATION, DATE = "^[0-9]{7}$", "^HP-[0-9]{4}(CMP|WWP)$", "^[0-9]{4}/[0-9]{2}/[0-9]{2}$"
DATE_PARTS = {"day": "^(0?[1-9]|[12][0-9]|3[01])$", "month": "^([A-Z]{3}|[0-9]{1,2})$", "year": "^[0-9]{2}([0-9]{2})?$"}


def decisive(fields: str) -> Column:
    return F.filter(fields, lambda f: ~f.field_id.rlike(NEVER_DECIDE))


def value_of(fields: str, field_id: str) -> Column:
    return F.element_at(F.filter(fields, lambda f: f.field_id == field_id), 1).value


def has(fields: str, field_id: str) -> Column:
    return F.exists(fields, lambda f: f.field_id == field_id)


def legible(fields: str, field_id: str, pattern: str) -> Column:
    """Whether the first such field's value, without white space around it, is of a form."""
    value = F.get(F.filter(fields, lambda f: f.field_id == field_id), F.lit(0)).value
    return F.coalesce(F.regexp_replace(value, r"^\s+|\s+$", "").rlike(pattern), F.lit(False))


def has_date(fields: str, date: Column) -> Column:
    """Whether the page has a date: the whole one, or else all of day, month and year that it has fields for, one at least."""
    upper = F.transform(fields, lambda f: F.struct(f.field_id.alias("field_id"), F.upper(f.value).alias("value")))
    parts = [(has(fields, k), legible(upper, k, p)) for k, p in DATE_PARTS.items()]
    anything, whole = F.lit(False), F.lit(True)
    for there, good in parts:
        anything, whole = anything | there, whole & (~there | good)
    return F.coalesce(date.rlike(DATE), F.lit(False)) | (anything & whole)


def page_status(fields: str, blank: Column, date_review: Column, keep: Column, date: Column | None = None) -> Column:
    """ERROR for blank pages and those of which no identifier is legible; WARNING if one isn't or a decisive field isn't OK; else OK.

    Only identifiers that the page has fields for are asked for (a date by its parts; ``date`` is the page's whole one); a page
    that has none of them is judged by its fields, and a page without fields keeps its status.
    """
    date = F.lit(None).cast("string") if date is None else date
    dated = F.exists(fields, lambda f: f.field_id.isin(*DATE_PARTS))
    asked = has(fields, "log_number").cast("int") + has(fields, "matricula").cast("int") + dated.cast("int")
    read = legible(fields, "log_number", LOG_NUMBER).cast("int") + legible(fields, "matricula", REGISTRATION).cast("int") + (dated & has_date(fields, date)).cast("int")
    flawed = F.exists(decisive(fields), lambda f: f.status != "OK")
    return F.when(blank, "ERROR").when(F.size(fields) == 0, keep).when((asked > 0) & (read == 0), "ERROR").when(read < asked, "WARNING").when(date_review | flawed, "WARNING").otherwise("OK")


def first_failed_rule(value: Column, rule: Column, confidence: Column, least: float, signature: Column | None = None) -> Column:
    """The first rule that a value breaks (rule: required, regex, min_length, max_length); null if none.

    White space alone is no value. A pattern must match the whole value. Signatures may be unsure.
    """
    empty = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", "") == ""
    whole = F.regexp_like(value, F.concat(F.lit(r"\A(?:"), rule.regex, F.lit(r")\z")))
    unsure = (confidence < least) & (F.lit(True) if signature is None else ~signature)
    return F.coalesce(
        F.when(empty, F.when(rule.required, "required").otherwise("optional_empty")),
        F.when(rule.regex.isNotNull() & ~whole, "regex"),
        F.when(F.length(value) < rule.min_length, "too_short"),
        F.when(F.length(value) > rule.max_length, "too_long"),
        F.when(unsure, "low_confidence"),
    )


def rule_status(broken: Column) -> Column:
    """The status that the first broken rule gives: an empty optional field and a low confidence only warn."""
    return F.when(broken.isNull(), "OK").when(broken.isin("optional_empty", "low_confidence"), "WARNING").otherwise("ERROR")


def presence(value: Column, confidence: Column, sure: float = 0.8, clear: float = 0.2) -> Column:
    """True, false or null (unclear) from a value and its confidence."""
    return F.when((value == "true") & (confidence >= sure), True).when((value == "false") & (confidence >= clear), False)


def reason(messages: Column, rules: Mapping[str, str], default: str) -> Column:
    """The answer of the first rule (in order) whose text the message contains."""
    out = F.lit(default)
    for text, answer in reversed(rules.items()):
        out = F.when(F.contains(F.lower(messages), F.lit(text)), answer).otherwise(out)
    return out


def by_priority(found: Column, priority: Sequence[str]) -> Column:
    """The first name of ``priority`` that the array holds."""
    return F.get(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(found, p)), F.lit(0))


def missing_required(values: Mapping[str, Column]) -> Column:
    """The names whose value is null or empty, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(n)) for n, c in values.items()])))


def date_policy(day: Column, month_end_only: bool, as_of: Column) -> tuple[Column, Column]:
    """The date to deliver and why: a valid read day, or its month's end; none for months that are not possible."""
    possible = (day >= F.make_date(F.lit(2000), F.lit(1), F.lit(1))) & (F.trunc(day, "MM") <= F.trunc(as_of, "MM"))
    exact = possible & (day <= as_of) & F.lit(not month_end_only)
    return F.when(exact, day).when(possible, F.last_day(day)), F.when(exact, "specific_day").when(possible, "month_end").otherwise("none")


def upload_decision(found: Column, missed: Column, share: int = 90, enough: int = 10, few: int = 4) -> Column:
    """Skip what was mostly found before, upload what was mostly missed, else wait for more samples."""
    total = found + missed
    return F.when((found >= enough) & (found * 100 >= total * share), "skip").when(missed >= few, "upload").otherwise("wait")
