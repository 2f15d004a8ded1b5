"""Run reports as CSV: strings only, fixed column order, wide and narrow forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A header's older name, what the columns of one field add to its name, columns that belong to no field, and the fields a summary shows without a template.
LEGACY = {"discrepancia": "disc_reason"}
SUFFIXES = ("_conf", "_status", "_comment", "_source")
ALWAYS, FLAGS = ("file", "page"), ("review", "dup", "disc", "disc_reason")
OF_NO_FIELD = (*ALWAYS, *FLAGS, "date", "time_ms")
DATE_PARTS = ("day", "month", "year")
MAIN_FIELDS = ("log_number", "matricula", "flight_number", "captain_license")


def read_run(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A run's report: every column a string, empty cells empty, older headers renamed. A byte-order mark is taken off."""
    df = spark.read.option("nullValue", "\x00").option("emptyValue", "").csv(path, header=True, inferSchema=False, encoding="UTF-8")
    return df.withColumnsRenamed({old: new for old, new in LEGACY.items() if old in df.columns}).fillna("")


def write_run(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Writes a report; whole or not at all, by Spark's commit. ``one_file`` is for deliveries of a known small size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, emptyValue="")


def wide_columns(fields: Sequence[str], signatures: Sequence[str] = ()) -> list[str]:
    """The wide form's columns: file, page, each field with its metadata behind it, the page's flags after the number (without one, after all fields), date, time_ms."""
    out = [*ALWAYS]
    for f in fields:
        out += [f, *(FLAGS if f == "log_number" else ())]
        out += [f + s for s in SUFFIXES if not (f in signatures and s in ("_status", "_comment"))]
    return [*out, *(() if "log_number" in fields else FLAGS), "date", "time_ms"]


def wide_form(rows: DataFrame, fields: Sequence[str], signatures: Sequence[str] = ()) -> DataFrame:
    """The wide form of pages with their fields' columns: all columns in order as text, those that are not there empty."""
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in wide_columns(fields, signatures)])


def minimal_columns(columns: Sequence[str], selected: Sequence[str] | None = None) -> list[str]:
    """The selected columns in the source's order, file and page always; by default all that are no metadata."""
    wanted = {c for c in columns if not c.endswith(SUFFIXES)} if selected is None else set(selected)
    return [c for c in columns if c in wanted or c in ALWAYS]


def column_field(column: str, columns: Sequence[str]) -> str | None:
    """The field that a column shows: its own name, or without a metadata suffix if there is such a column; None for the page's own columns."""
    if column in OF_NO_FIELD:
        return None
    return next((column.removesuffix(s) for s in SUFFIXES if column.endswith(s) and column.removesuffix(s) in columns), column)


def pivot_fields(fields: DataFrame, keys: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Long rows (field_id, value, confidence, status) as one wide row per page; ``known`` fixes the columns."""
    pick = lambda f, c: F.max(F.when(F.col("field_id") == f, F.col(c)))
    return fields.groupBy(*keys).agg(*[pick(f, c).alias(f + s) for f in known for c, s in (("value", ""), ("confidence", "_conf"), ("status", "_status"))])


def preferred_files(spark: SparkSession, root: str, ending: str = "_completo.csv") -> DataFrame:
    """The CSV files below a root, newest first; of a complete report and its narrow sibling only the complete one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "modificationTime", "length")
    base = F.regexp_replace("path", f"({ending.replace('.', '[.]')}|[.]csv)$", "")
    order = Window.partitionBy("base").orderBy(F.desc(F.col("path").endswith(ending).cast("int")), "path")
    return files.withColumn("base", base).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "base").orderBy(F.desc("modificationTime"), "path")


def slice_files(files: DataFrame, order: str, count: str, first: int, last: int) -> DataFrame:
    """The part of each file in a range of pages counted over all files: from and to, both from 1. Pages are not read. A file with pages takes up one at least, so those that reach into the range are among the first ``last`` of them."""
    files = files.where(F.col(count) > 0).orderBy(order).limit(last)
    before = F.coalesce(F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("before", before).withColumns({"page_from": F.greatest(F.lit(first) - F.col("before"), F.lit(1)), "page_to": F.least(F.lit(last) - F.col("before"), F.col(count))})
    return rows.where("page_from <= page_to").drop("before")


def parse_range(text: str, count: int) -> tuple[int, int]:
    """``N``, ``N-M``, ``N-`` or ``-M`` (a colon or long dash will do) as a range from 1, its end clipped to ``count``.

    A range beyond the pages is empty: its end lies before its start. Without pages it is 1 to 0. Anything else is an error.
    """
    raw = text.strip().replace(":", "-").replace("\u2013", "-")
    first, dash, last = (x.strip() for x in raw.partition("-"))
    if not raw or not all(x == "" or (x.isdecimal() and int(x) > 0) for x in (first, last)):
        raise ValueError(f"no page range: {text!r}")
    low = int(first) if first else 1
    high = (int(last) if last else None) if dash else low
    if high is not None and high < low:
        raise ValueError(f"no page range: {text!r}")
    return (1, 0) if count <= 0 else (low, count if high is None else min(high, count))


def template_fields(selected: Sequence[str], known: Sequence[str], columns: Sequence[str] = ()) -> list[str]:
    """The fields of a template that selected columns show, in the template's order; ``date`` shows day, month and year."""
    shown = {f for c in selected for f in (DATE_PARTS if c == "date" else (column_field(c, columns or selected),))}
    return [f for f in known if f in shown]


def important_fields(columns: Sequence[str]) -> list[str]:
    """Without a template: the main fields, signatures, and the parts of the date unless there is a whole one."""
    values = [c for c in columns if c not in OF_NO_FIELD and not c.endswith(SUFFIXES)]
    return [c for c in values if c in MAIN_FIELDS or c.endswith("_signature") or (c in DATE_PARTS and "date" not in columns)]


def important_columns(columns: Sequence[str], fields: Sequence[str] = ()) -> list[str]:
    """The summary's columns in the report's order: the page's own and the fields (by default the important ones); no parts of a date beside the whole one."""
    wanted = set(fields or important_fields(columns)) - set(DATE_PARTS if "date" in columns else ())
    return [c for c in columns if c in OF_NO_FIELD or c in wanted]
