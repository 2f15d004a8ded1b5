"""Nested run reports and registries as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "struct<field_id:string,value:string,confidence:double,status:string,source:string,votes:int>"
PAGE = f"struct<page_number:int,status:string,blank:boolean,fields:array<{FIELD}>>"
RUN = f"corrida string, generado string, total_bitacoras int, reportes array<struct<pdf_path:string,pages:array<{PAGE}>>>"


def read_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Consolidated runs as one row per page with its place; unreadable files (or lines) give no rows."""
    runs = spark.read.schema(RUN).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE").json(path)
    reports = runs.select("corrida", F.posexplode("reportes").alias("report_no", "r"))
    return reports.select("corrida", "report_no", "r.pdf_path", F.posexplode("r.pages").alias("position", "p")).select("corrida", "report_no", "pdf_path", "position", "p.*")


def consolidated(pages: DataFrame, run: str, report: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One JSON text per run and report, with the run's count of pages beside it; the pages are in order. A report holds the pages of one file, so no row grows with its run."""
    page = F.struct(*order, *[c for c in columns if c not in order])
    reports = pages.groupBy(run, report).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    totals = pages.groupBy(F.col(run).alias("_run")).agg(F.count("*").alias("total_bitacoras"))
    texts = reports.select(run, F.col(report).alias("pdf_path"), F.to_json(F.struct(F.col(report).alias("pdf_path"), "pages")).alias("json"))
    return texts.join(totals, F.col(run).eqNullSafe(F.col("_run"))).select(run, "pdf_path", "total_bitacoras", "json")


def registry_json(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """A registry as compact JSON maps, one entry a row: no row grows with the registry, and a reader takes one map or many."""
    value = F.col(value) if isinstance(value, str) else value
    return df.where(F.col(key).isNotNull()).select(F.to_json(F.create_map(F.col(key), value)).alias("json"))


def registry_rows(df: DataFrame, json: str, key_pattern: str, value_pattern: str) -> DataFrame:
    """A registry's entries; keys or values of another form are dropped, an unreadable text gives no rows."""
    entries = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
    return entries.where(F.col("key").rlike(key_pattern) & F.col("value").rlike(value_pattern))


def date_registry_rows(df: DataFrame, json: str, as_of: Column, most: int = 2) -> DataFrame:
    """Book, number and date of a nested registry; a book with more than ``most`` anchors, falling or future dates is dropped whole."""
    books = df.select(F.explode(F.from_json(json, "map<string,map<string,string>>")).alias("book", "anchors"))
    parsed = F.transform(F.array_sort(F.map_entries("anchors")), lambda e: F.struct(e.key.try_cast("int").alias("number"), F.try_to_date(e.value, "yyyy-MM-dd").alias("day")))
    books = books.withColumn("a", F.array_sort(parsed))
    fits = lambda a: a.number.isNotNull() & a.day.isNotNull() & (a.day <= as_of) & ((a.number < 50) == F.col("book").endswith("A"))
    rising = (F.size("a") < 2) | (F.get("a", F.lit(0)).day <= F.get("a", F.size("a") - 1).day)
    return books.where((F.size("a") <= most) & F.forall("a", fits) & rising).select("book", F.inline("a"))


def page_index(df: DataFrame, json: str, *keys: str) -> DataFrame:
    """Part, place and page of a delivery's page index, in either of its versions; ``keys`` are columns to keep."""
    parsed = F.from_json(json, "partes array<struct<pdf:string,paginas:array<int>>>, pdf string, paginas array<int>")
    parts = F.coalesce(parsed.partes, F.array(F.struct(parsed.pdf.alias("pdf"), parsed.paginas.alias("paginas"))))
    rows = df.select(*keys, F.posexplode(parts).alias("part", "p"))
    return rows.select(*keys, "part", "p.pdf", F.posexplode("p.paginas").alias("place", "page"))


def append_audit(df: DataFrame, path: str, content: str) -> None:
    """Appends rows as JSON lines, each with the hash that names its content."""
    df.withColumn("content_id", F.sha2(F.col(content), 256)).write.mode("append").json(path)


def write_reports(pages: DataFrame, path: str, run: str, report: str, page: Column, order: str) -> None:
    """Runs as JSON lines, one report a line, in the form that ``read_reports`` takes; a run's lines hold its count of pages."""
    reports = pages.groupBy(run, report).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), page.alias("p")))).alias("own"))
    totals = pages.groupBy(F.col(run).alias("_run")).agg(F.count("*").cast("int").alias("total_bitacoras"))
    own = F.array(F.struct(F.col(report).alias("pdf_path"), F.transform("own", lambda x: x.p).alias("pages")))
    rows = reports.join(totals, F.col(run).eqNullSafe(F.col("_run"))).select(F.col(run).alias("corrida"), "total_bitacoras", own.alias("reportes"))
    rows.write.mode("overwrite").json(path)


def relocated(rows: DataFrame, moved: DataFrame, path: str) -> DataFrame:
    """Rows with the new places of files that were moved (``moved``: path, new_path)."""
    return rows.join(moved.select(F.col(path).alias("_p"), "new_path"), F.col(path) == F.col("_p"), "left").withColumn(path, F.coalesce("new_path", path)).drop("_p", "new_path")


def date_registry_json(rows: DataFrame, book: str, number: str, day: str) -> DataFrame:
    """Books' date anchors as compact JSON maps, one book a row (a book keeps two)."""
    anchors = rows.groupBy(book).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lpad(F.col(number).cast("string"), 2, "0"), F.date_format(day, "yyyy-MM-dd"))))).alias("a"))
    return anchors.select(F.to_json(F.create_map(book, "a")).alias("json"))


def page_index_json(parts: DataFrame, delivery: str, part: str, pdf: str, page: str, order: str) -> DataFrame:
    """Each delivery's parts with their pages in order, as one JSON text a delivery."""
    pages = parts.groupBy(delivery, part, pdf).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, page))), lambda x: x[page]).alias("paginas"))
    whole = pages.groupBy(delivery).agg(F.transform(F.array_sort(F.collect_list(F.struct(part, pdf, "paginas"))), lambda x: F.struct(x[pdf].alias("pdf"), x.paginas.alias("paginas"))).alias("partes"))
    return whole.select(delivery, F.to_json(F.struct("partes")).alias("json"))


def read_with_quarantine(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The readable rows of JSON lines, and the lines that aren't."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("_x", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_x._bad IS NULL").select("_x.*").drop("_bad"), parsed.where("_x._bad IS NOT NULL").select("value")


def load_list(spark: SparkSession, path: str, normal) -> DataFrame:
    """A dimension kept as JSON lines of text arrays: distinct normalised values. ``normal`` maps a column."""
    texts = spark.read.text(path).select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    return texts.select(normal(F.col("v")).alias("value")).where("value <> ''").distinct()


def merged_manifest(old: DataFrame, new: DataFrame, key: str, confirmed: str) -> DataFrame:
    """A rewritten manifest: new rows, with the confirmations that earlier ones of the same key had."""
    kept = old.where(confirmed).select(F.col(key).alias("_k")).distinct()
    return new.join(kept, F.col(key) == F.col("_k"), "left").withColumn(confirmed, F.col(confirmed) | F.col("_k").isNotNull()).drop("_k")
