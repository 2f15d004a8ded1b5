"""Typed index records from a run's report rows, and the verdicts of field rules that are data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import dates, details, text
from pagewright.operators import status

CSV_DATE = r"\A[0-9]{4}/[0-9]{2}/[0-9]{2}\z"
#: Columns of a report that a record is made from; those that a report lacks are empty.
REPORT = ("file", "page", "matricula", "log_number", "flight_number", "date", "dup", "disc", "disc_reason")


def index_records(
    rows: DataFrame, seq: str, fleet: DataFrame, inferred: DataFrame, as_of: Column, pattern: str, alias: Mapping[str, str], prefixes: Mapping[str, str], default: str, names: Mapping[str, str], month_end: bool = False, doubtful: str | None = None
) -> DataFrame:
    """One record for each row of a report whose columns are texts, by ``seq``.

    ``fleet`` (matricula, fleet, lessor; one row each) resolves a registration, else the first of ``prefixes`` it has, else
    ``default``, as inferred. ``inferred`` (file, page, day, method; one row each) gives the date of rows without a possible one
    of their own; a doubtful date (``doubtful`` is a boolean column) is dropped and not inferred. With ``month_end`` every date
    becomes its month's last day, and one of a month to come none. Registrations that don't have the ``pattern`` whole, and
    numbers of other than seven digits, are empty, as is what nulls make. A page that is no number is page 0.
    """
    have = {c.lower() for c in rows.columns}
    cell = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("") for c in REPORT}
    plane = F.regexp_replace(F.upper(cell["matricula"]), " ", "")
    plane = F.when(plane.rlike(rf"\A(?:{pattern})\z"), plane).otherwise("")
    renamed = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair]) if alias else F.create_map().cast("map<string,string>")
    read = F.when(cell["date"].rlike(CSV_DATE), F.try_to_date(cell["date"], "yyyy/MM/dd"))
    own = F.when(dates.date_is_possible(read, as_of, allow_month_end=True), read)
    unsure = F.coalesce(F.col(doubtful), F.lit(False)) if doubtful else F.lit(False)
    typed = rows.select(
        F.col(seq).alias("seq"), cell["file"].alias("file"), F.coalesce(cell["page"].try_cast("int"), F.lit(0)).alias("page"), F.coalesce(renamed[plane], plane).alias("matricula"), F.coalesce(text.log_number(cell["log_number"]), F.lit("")).alias("log_number"),
        F.upper(cell["flight_number"]).alias("flight_number"), own.alias("_own"), unsure.alias("doubtful"), (F.lower(cell["dup"]) == "true").alias("duplicate"), (F.lower(cell["disc"]) == "true").alias("discrepancy"),
        details.reason_fields(cell["disc_reason"], names).alias("fields"), F.coalesce(details.canonical_reason(cell["disc_reason"], names), F.lit("")).alias("reason"),
    )
    known = fleet.select(F.col("matricula"), F.col("fleet").alias("_fleet"), F.col("lessor").alias("_lessor")).where("_fleet <> ''")
    by_prefix = F.lit(default)
    for prefix, value in reversed(prefixes.items()):
        by_prefix = F.when(F.col("matricula").startswith(prefix), value).otherwise(by_prefix)
    met = typed.join(known, "matricula", "left").join(inferred.select("file", "page", F.col("day").alias("_day"), F.col("method").alias("_method")), ["file", "page"], "left")
    takes = ~F.col("doubtful") & F.col("_own").isNull()
    day = F.when(takes, F.col("_day")).when(~F.col("doubtful"), F.col("_own"))
    day = dates.month_end(day, as_of) if month_end else day
    there = F.col("matricula") != ""
    return met.select(
        "seq", "file", "page", "matricula", "log_number", "flight_number", F.coalesce(F.date_format(day, "yyyy/MM/dd"), F.lit("")).alias("date"), "doubtful", F.when(takes, F.coalesce("_method", F.lit(""))).otherwise("").alias("inferred"),
        F.when(there, F.coalesce("_fleet", by_prefix)).otherwise("").alias("fleet"), F.coalesce("_lessor", F.lit("")).alias("lessor"), (there & F.col("_fleet").isNull()).alias("fleet_inferred"), "duplicate", "discrepancy", "fields", "reason",
    )


def ruled(fields: DataFrame, template: DataFrame, least: float, keys: Sequence[str]) -> DataFrame:
    """keys, field_id, ``broken`` and ``status`` of fields (field_id, value, confidence) by the rules of their template's rows.

    A field that the template doesn't have only warns (``unknown``). The template is a form's fields, of a size that Spark
    broadcasts by itself.
    """
    rules = template.select(F.col("id").alias("field_id"), (F.col("type") == "signature").alias("_signature"), F.struct("required", "regex", "min_length", "max_length").alias("_rule"))
    met = fields.join(rules, "field_id", "left")
    known = F.col("_rule").isNotNull()
    broken = F.when(known, status.first_failed_rule(F.col("value"), F.col("_rule"), F.col("confidence"), least, F.col("_signature"))).otherwise("unknown")
    said = met.withColumn("broken", broken)
    return said.select(*keys, "field_id", "broken", F.when(F.col("broken") == "unknown", "WARNING").otherwise(status.rule_status(F.col("broken"))).alias("status"))
