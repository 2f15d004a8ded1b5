"""Smaller normalisers and candidate lists of noisy records, as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.dates import MONTHS, year_is_possible
from pagewright.functions.text import col, first_char, log_number, only_digits, squeeze, upper_trim

#: Accented letters without their accents; reasons of missing signatures by field, in order of priority.
ACCENTS, PLAIN = "ÁÉÍÓÚÜÑáéíóúüñ", "AEIOUUNaeiouun"
REASONS = {"captain_signature": "CAPTAIN", "captain_license": "CAPTAIN", "pilot_signature": "PILOT", "technician_signature": "TECHNICIAN", "technician_license": "LICENSE"}
#: Letters that handwriting returns for each place of a month's name, and their weight.
ALIKE = ({"J": "3I/"}, {"U": "0V", "O": "0"}, {"L": "1IC2"})
ALIKE_WEIGHT, EMPTY, WRONG, MARGIN, DECISIVE = 0.85, 0.05, 0.03, 1.5, 0.35
#: Sources whose readings have no alternatives of their own.
DERIVED = ("inferred", "book_correction")


def two_digit_year(c: str | Column, as_of: Column) -> Column:
    """The last two digits of a year of two or four digits that is possible; null otherwise."""
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    year = F.when(digits.rlike("^[0-9]{2}$"), digits.try_cast("int") + 2000).when(digits.rlike("^[0-9]{4}$"), digits.try_cast("int"))
    return F.when(year_is_possible(year, as_of), F.lpad((year % 100).cast("string"), 2, "0"))


def two_digit_day(c: str | Column) -> Column:
    day = F.regexp_replace(col(c), "[^0-9]", "").try_cast("int")
    return F.when(day.between(1, 31), F.lpad(day.cast("string"), 2, "0"))


def month_name(value: str | Column, none: str = "sf") -> Column:
    """A date's year and the short name of its month."""
    spanish = dict(reversed([(n, name) for name, n in MONTHS.items()]))
    names = F.array(*[F.lit(spanish[n]) for n in range(1, 13)])
    return F.coalesce(F.concat(F.year(col(value)).cast("string"), F.lit("-"), F.get(names, F.month(col(value)) - 1)), F.lit(none))


def any_timestamp(c: str | Column, forms: Sequence[str]) -> Column:
    """The first of several forms that a text has."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in forms])


def deadline(pages: str | Column, least: int = 120, each: int = 60) -> Column:
    """Seconds that a batch may take."""
    return F.greatest(F.lit(least), col(pages) * each)


def usable_id(c: str | Column) -> Column:
    """An id that says something; empty otherwise."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("", "0", "none", "null"), "").otherwise(text)


def aliased(c: str | Column, alias: Mapping[str, str]) -> Column:
    """A registration in capitals without signs, by its alias if it has one."""
    key = F.regexp_replace(F.upper(F.trim(col(c))), "[^A-Z0-9]", "")
    out = key
    for name, value in alias.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def title_without_batch(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"-batch[0-9]*$", "")


def file_title(number: str | Column, registration: str | Column, fallback: str | Column) -> Column:
    """A page's file name from its number and registration, or from its place."""
    named = F.concat_ws("_", F.nullif(col(number), F.lit("")), F.nullif(col(registration), F.lit("")))
    return F.concat(F.when(named != "", named).otherwise(F.concat(F.lit("page_"), col(fallback).cast("string"))), F.lit(".pdf"))


def plane_key(c: str | Column, pattern: str) -> Column:
    return F.when(col(c).rlike(pattern), col(c)).otherwise("sin_matricula")


def reason_fields(sentence: str | Column, names: Mapping[str, str]) -> Column:
    """The fields that a sentence of the form ``missing a, b and c`` names; empty if any part isn't known."""
    text = F.lower(F.trim(F.translate(col(sentence), ACCENTS, PLAIN)))
    text = F.regexp_replace(text, r" \((maintenance|correction)\)", "")
    parts = F.split(F.regexp_extract(text, r"^missing (.+)$", 1), r", | and ")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    fields = F.transform(parts, lambda p: F.element_at(table, p))
    return F.when(F.forall(fields, lambda f: f.isNotNull()), fields).otherwise(F.array().cast("array<string>"))


def canonical_reason(sentence: str | Column, names: Mapping[str, str], prefix: str = "DISCREPANCY NOTE: ") -> Column:
    """A formal reason without its prefix, or that of the first field (by priority) that the sentence names; empty without one."""
    formal = F.regexp_replace(F.upper(F.trim(col(sentence))), f"^{prefix}", "")
    fields = reason_fields(sentence, names)
    out = F.lit("")
    for field, reason in reversed(REASONS.items()):
        out = F.when(F.array_contains(fields, field), reason).otherwise(out)
    return F.when(formal.isin(*set(REASONS.values())), formal).otherwise(out)


def keep_remote(values: Column, remote: Column, primary: str, secondary: Sequence[str]) -> Column:
    """Values to write without the secondary keys; the primary one keeps what is there already."""
    left = F.map_filter(values, lambda k, v: ~k.isin(*secondary))
    there = F.trim(F.coalesce(F.element_at(remote, primary), F.lit("")))
    return F.transform_values(left, lambda k, v: F.when((k == primary) & (v != "") & (there != ""), there).otherwise(v))


def component_candidates(value: Column, alternatives: Column, source: Column, normal) -> Column:
    """A part's distinct normalised readings, the chosen one first; a derived value has no alternatives. ``normal`` maps a text column."""
    others = F.when(F.coalesce(source.isin(*DERIVED), F.lit(False)), F.array().cast("array<string>")).otherwise(F.coalesce(alternatives, F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(F.transform(F.concat(F.array(value), others), normal)))


def day_candidates(current: Column, alternatives: Column) -> Column:
    """Days that a reading allows beside the chosen one: its alternatives (no single digit for two), and the tens that one digit may have lost."""
    others = F.filter(F.array_distinct(F.array_compact(F.transform(alternatives, lambda a: F.regexp_replace(a, "[^0-9]", "").try_cast("int")))), lambda d: d.between(1, 31) & ~((d < 10) & (current >= 10)))
    tens = F.when(current < 10, F.array(current + 10, current + 20, current + 30)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.concat(others, tens), lambda d: d != current)


def day_strength(confidence: Column, day: Column, direct: Column) -> Column:
    """What it costs to change a day: its confidence, and one more for a trusted reading of two digits."""
    return confidence + F.when(direct & (day >= 10), 1.0).otherwise(0.0)


def letter_weight(observed: Column, expected: str, place: int) -> Column:
    """How well a sign stands for a letter of a month's name."""
    sign = F.upper(observed)
    return F.when(F.length(sign) != 1, 0.0).when(sign == expected, 1.0).when(sign.isin(*ALIKE[place].get(expected, "")) if ALIKE[place].get(expected) else F.lit(False), ALIKE_WEIGHT).otherwise(0.0)


def month_slots(signs: Sequence[Column], confidences: Sequence[Column]) -> Column:
    """The months that three signs may stand for, best first: structs of score, month and strengths; a month needs two signs."""
    months = []
    for name, n in MONTHS.items():
        strengths = [c * letter_weight(s, name[k], k) for k, (s, c) in enumerate(zip(signs, confidences, strict=True))]
        met = sum(((x > 0).cast("int") for x in strengths), F.lit(0))
        score = F.lit(1.0)
        for x, s in zip(strengths, signs, strict=True):
            score = score * F.when(x > 0, F.greatest(F.lit(EMPTY), x)).otherwise(F.when(s != "", WRONG).otherwise(EMPTY))
        months.append(F.when(met >= 2, F.struct((-score).alias("rank"), F.lit(n).alias("month"), score.alias("score"))))
    found = F.array_sort(F.array_compact(F.array(*months)))
    return F.filter(found, lambda m: ~F.exists(found, lambda o: (o.month == m.month) & (o.rank < m.rank)))


def decided_month(slots: Column) -> Column:
    """The first month of ``month_slots`` if it beats the second clearly; null otherwise."""
    first, second = F.get(slots, F.lit(0)), F.get(slots, F.lit(1))
    return F.when(second.isNull() | (first.score >= second.score * MARGIN), first.month)


def unwrapped(json: str | Column, envelopes: Sequence[str] = ("rows", "data", "results")) -> Column:
    """The rows of a JSON text, itself an array or in an envelope; null if it has none."""
    return F.coalesce(F.from_json(col(json), "array<string>"), *[F.from_json(F.get_json_object(col(json), f"$.{e}"), "array<string>") for e in envelopes])


def holds_value(leaves: Column, value: str | Column) -> Column:
    """Whether a value is one of a JSON text's leaves."""
    return F.array_contains(leaves, col(value).cast("string"))


def number_ranges(numbers: Column, most: int) -> Column:
    """Sorted numbers as text, runs as ``a-b``; after ``most`` pieces the count of what is left."""
    ordered = F.array_sort(F.array_distinct(numbers))
    starts = F.filter(ordered, lambda n: ~F.array_contains(ordered, n - 1))
    ends = F.filter(ordered, lambda n: ~F.array_contains(ordered, n + 1))
    pieces = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    left = F.aggregate(F.zip_with(F.slice(starts, most + 1, 1 << 20), F.slice(ends, most + 1, 1 << 20), lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    text = F.array_join(F.slice(pieces, 1, most), ", ")
    return F.when(F.size(pieces) > most, F.concat(text, F.lit(" and "), left.cast("string"), F.lit(" more"))).otherwise(text)


def job_state(stage: Column, errors: Column, sent: Column, pages: Column) -> Column:
    """What to show for a job: failed, done, sending, waiting or new."""
    return F.when(errors > 0, "failed").when((sent >= pages) & (pages > 0), "done").when(sent > 0, "sending").when(stage == "ready", "waiting").otherwise("new")


#: How each field's reading is normalised, by the name of its rule.
RULES = {"digits": only_digits, "upper": upper_trim, "log_number": log_number, "first_char": first_char, "squeeze": squeeze, "day": two_digit_day}


def postprocessed(value: str | Column, rule: str) -> tuple[Column, Column]:
    """A reading by its rule, and a note where that changed it; an unknown rule leaves it."""
    raw = F.coalesce(col(value), F.lit(""))
    out = F.coalesce(RULES[rule](raw), F.lit("")) if rule in RULES else raw
    return out, F.when(out != raw, F.concat(F.lit("changed by "), F.lit(rule))).otherwise("")


def content_fingerprint(endpoint: str, content: str | Column) -> Column:
    """The hash that names a content sent to a place."""
    return F.sha2(F.concat(F.lit(endpoint).cast("binary"), F.coalesce(col(content).cast("binary"), F.lit(b""))), 256)


def unread_fields(fields: str | Column) -> Column:
    """The names of the fields without a value or in error."""
    return F.transform(F.filter(fields, lambda f: (F.coalesce(f.value, F.lit("")) == "") | (f.status == "ERROR")), lambda f: f.field_id)


def is_blank_row(values: Sequence[Column]) -> Column:
    """Whether a row has no value at all."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values]).isNull()


def may_overwrite(state: Column, valid: int, asked: bool) -> Column:
    """Whether a page may be written: a valid one only when asked."""
    return F.lit(asked) | ~F.coalesce(state == valid, F.lit(False))
