"""Reports, registries and page ranges, through their JSON and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import book_key
from pagewright.plans.registry import AS_OF, query, table
from pagewright.session import shared_folder
from pagewright.sources import csv_runs, json_runs
from pagewright.streaming import incremental


@query("""
    SELECT l_returnflag, count(*) AS total, count(DISTINCT l_suppkey) AS reports, count(*) AS pages FROM lineitem GROUP BY 1
""")
def consolidated_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON, and counted from it."""
    return _report_counts(table(spark, d, "lineitem"))


def _report_counts(lines: DataFrame) -> DataFrame:
    pages = lines.withColumn("pdf", F.format_string("%06d.pdf", "l_suppkey"))
    texts = json_runs.consolidated(pages, "l_returnflag", "pdf", ["l_orderkey", "l_linenumber"], ["l_quantity"])
    rows = texts.select("l_returnflag", "total_bitacoras", F.from_json("json", "pdf_path string, pages array<struct<l_orderkey:long>>").alias("r"))
    return rows.groupBy("l_returnflag").agg(F.max("total_bitacoras").alias("total"), F.count("*").alias("reports"), F.sum(F.size("r.pages")).alias("pages"))


@query("""
    SELECT key, min(value) AS value FROM (SELECT lpad((o_orderkey // 100)::VARCHAR, 5, '0') || CASE WHEN o_orderkey % 100 < 50 THEN 'A' ELSE 'B' END AS key, 'HP-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || 'CMP' AS value FROM orders WHERE o_custkey % 7 <> 0) GROUP BY key
""")
def registry_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One JSON entry a row; entries of another form, every seventh customer's and some without a key, are dropped on reading."""
    number = F.concat(F.lit("HP-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("CMP"))
    value = F.when(F.col("o_custkey") % 7 == 0, F.when(F.col("o_custkey") % 2 == 0, "x").otherwise(F.concat(F.lit("#"), number))).otherwise(number)
    rows = table(spark, d, "orders").select(book_key(F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("key"), value.alias("value"))
    more = rows.select(F.concat(F.lit("?"), "key").alias("key"), "value")
    read = json_runs.registry_rows(json_runs.registry_json(rows.unionByName(more), "key", "value"), "json", "^[0-9]{5}[AB]$", "^HP-[0-9]{4}(CMP|WWP)$")
    return read.groupBy("key").agg(F.min("value").alias("value"))


@query("""
    WITH f AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM f)
    SELECT l_suppkey, n, greatest(100 - before, 1) AS page_from, least(3000 - before, n) AS page_to FROM b WHERE greatest(100 - before, 1) <= least(3000 - before, n)
""")
def page_slices(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return csv_runs.slice_files(files, "l_suppkey", "n", 100, 3000).select("l_suppkey", "n", F.col("page_from").cast("long").alias("page_from"), F.col("page_to").cast("long").alias("page_to"))


@query("""
    SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS log_number, max(CASE WHEN l_linenumber = 1 THEN l_discount END) AS log_number_conf, max(CASE WHEN l_linenumber = 1 THEN l_linestatus END) AS log_number_status,
           max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS matricula, max(CASE WHEN l_linenumber = 2 THEN l_discount END) AS matricula_conf, max(CASE WHEN l_linenumber = 2 THEN l_linestatus END) AS matricula_status FROM lineitem GROUP BY 1
""")
def wide_report(spark: SparkSession, d: str) -> DataFrame:
    field = F.when(F.col("l_linenumber") == 1, "log_number").when(F.col("l_linenumber") == 2, "matricula")
    rows = table(spark, d, "lineitem").select("l_orderkey", field.alias("field_id"), F.col("l_returnflag").alias("value"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("status"))
    return csv_runs.pivot_fields(rows, ["l_orderkey"], ["log_number", "matricula"])


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, max(l_discount) AS conf, max(l_linestatus) AS status, max(l_suppkey) AS supplier FROM lineitem GROUP BY ALL),
    w AS (SELECT l_orderkey::VARCHAR AS page, (max(CASE WHEN l_linenumber = 1 THEN supplier END) % 9)::VARCHAR AS file, {0} FROM p GROUP BY l_orderkey)
    SELECT coalesce(file, '') AS file, page, {1}, '' AS review, '' AS dup, '' AS disc, '' AS disc_reason, '' AS date, '' AS time_ms FROM w
""".format(
    ", ".join(f"max(CASE WHEN l_linenumber = {k} THEN {v} END) AS {n}{s}" for k, n in enumerate(("log_number", "matricula", "captain_signature"), 1) for v, s in (("flag", ""), ("conf", "_conf"), ("status", "_status")) if (n, s) != ("captain_signature", "_status")),
    ", ".join(f"coalesce({n}{s}::VARCHAR, '') AS {n}{s}" if s in ("", "_conf", "_status") else f"'' AS {n}{s}" for n in ("log_number", "matricula", "captain_signature") for s in ("", *csv_runs.SUFFIXES) if not (n == "captain_signature" and s in ("_status", "_comment"))),
))
def wide_form(spark: SparkSession, d: str) -> DataFrame:
    """The wide form of pages with three fields, one of them a signature, written as CSV and read again."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("value"), F.max("l_discount").alias("confidence"), F.max("l_linestatus").alias("status"), F.max("l_suppkey").alias("supplier"))
    names = ("log_number", "matricula", "captain_signature")
    field = F.when(F.col("l_linenumber") == 1, names[0]).when(F.col("l_linenumber") == 2, names[1]).when(F.col("l_linenumber") == 3, names[2])
    pages = csv_runs.pivot_fields(lines.withColumn("field_id", field), ["l_orderkey"], names)
    files = lines.where("l_linenumber = 1").select("l_orderkey", (F.col("supplier") % 9).alias("file"))
    rows = pages.join(files, "l_orderkey", "left").withColumnRenamed("l_orderkey", "page")
    path = shared_folder(spark, "wide")
    csv_runs.write_run(csv_runs.wide_form(rows, names, names[2:]), path)
    return csv_runs.read_run(spark, path)


@query(f"""
    SELECT user_id, max(ts)::TIMESTAMP AS last_seen, epoch(TIMESTAMP '{AS_OF} 00:00:00' - max(ts)) > 86400 AS stalled FROM events GROUP BY 1
""")
def stalled_users(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_seen"))
    return incremental.stalled(last, "last_seen", F.to_timestamp(F.lit(f"{AS_OF} 00:00:00")), 86400)


@query("""
    SELECT l_suppkey::VARCHAR AS file, l_orderkey::VARCHAR AS page, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE lpad(l_orderkey::VARCHAR, 7, '0') END AS log_number, CASE WHEN min(l_returnflag) = 'A' THEN 'a, "quoted"' ELSE min(l_returnflag) END AS matricula FROM lineitem GROUP BY l_suppkey, l_orderkey
""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A wide report written as CSV, read again, and cut to its minimal columns."""
    flag = F.min("l_returnflag")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("file"), F.col("l_orderkey").cast("string").alias("page")).agg(F.when(flag == "A", 'a, "quoted"').otherwise(flag).alias("matricula"))
    wide = rows.withColumns({"log_number": F.when(F.col("page").cast("long") % 5 == 0, "").otherwise(F.lpad("page", 7, "0")), "log_number_conf": F.lit("0.5"), "matricula_status": F.lit("OK")})
    path = shared_folder(spark, "csv")
    csv_runs.write_run(wide, path)
    read = csv_runs.read_run(spark, path)
    return read.select(csv_runs.important_columns(csv_runs.minimal_columns(read.columns), csv_runs.important_fields(read.columns)))


@query("""
    WITH p AS (SELECT l_returnflag AS corrida, CASE WHEN l_suppkey % 3 = 0 THEN 'moved/' ELSE '' END || l_suppkey || '.pdf' AS pdf_path, l_orderkey * 10 + l_linenumber AS page_number, CASE WHEN l_quantity > 45 THEN 'ERROR' ELSE 'OK' END AS status FROM lineitem)
    SELECT corrida, pdf_path, page_number, status, count(*) AS n FROM p GROUP BY ALL
""")
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested reports written as JSON lines and read as pages; every third file was moved meanwhile."""
    lines = table(spark, d, "lineitem").select("l_returnflag", F.concat(F.col("l_suppkey").cast("string"), F.lit(".pdf")).alias("pdf"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("n"), F.when(F.col("l_quantity") > 45, "ERROR").otherwise("OK").alias("status"))
    page = F.struct(F.col("n").alias("page_number"), "status", F.lit(False).alias("blank"))
    path = shared_folder(spark, "reports")
    json_runs.write_reports(lines, path, "l_returnflag", "pdf", page, "n")
    moved = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("pdf_path")).withColumn("new_path", F.concat(F.lit("moved/"), "pdf_path"))
    pages = json_runs.relocated(json_runs.read_reports(spark, path, multi_line=False), moved, "pdf_path")
    return pages.groupBy("corrida", "pdf_path", F.col("page_number").cast("long").alias("page_number"), "status").agg(F.count("*").alias("n"))


@query(f"""
    WITH b AS (SELECT lpad((o_orderkey // 100)::VARCHAR, 5, '0') || CASE WHEN o_orderkey % 100 < 50 THEN 'A' ELSE 'B' END AS book, (o_orderkey % 100)::INT AS number, o_orderdate::DATE AS day FROM orders),
    e AS (SELECT book, min(number) AS a, max(number) AS b FROM b GROUP BY 1), x AS (SELECT b.* FROM b JOIN e ON b.book = e.book AND number IN (a, e.b)),
    k AS (SELECT book, bool_and(day <= DATE '{AS_OF}') AND arg_min(day, number) <= arg_max(day, number) AS ok FROM x GROUP BY 1)
    SELECT x.book, number, day FROM x JOIN k USING (book) WHERE ok
""")
def date_registry_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Books' first and last dates, written and read; books with falling or future dates are dropped."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(book_key(F.lpad(k.cast("string"), 7, "0")).alias("book"), (k % 100).cast("int").alias("number"), F.to_date("o_orderdate").alias("day"))
    ends = rows.groupBy("book").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    kept = rows.join(ends, "book").where("number IN (a, b)").select("book", "number", "day")
    path = shared_folder(spark, "dates")
    json_runs.date_registry_json(kept, "book", "number", "day").write.text(path)
    return json_runs.date_registry_rows(spark.read.text(path), "value", F.to_date(F.lit(AS_OF)))


@query("""
    WITH p AS (SELECT l_suppkey AS delivery, l_linenumber AS part, (row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) - 1)::INT AS place, l_orderkey::INT AS page FROM lineitem)
    SELECT delivery, (dense_rank() OVER (PARTITION BY delivery ORDER BY part) - 1)::INT AS part, 'part ' || part || '.pdf' AS pdf, place, page FROM p
""")
def page_index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries' page indices, written and read."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("delivery"), F.col("l_linenumber").alias("part"), F.format_string("part %d.pdf", "l_linenumber").alias("pdf"), F.col("l_orderkey").cast("int").alias("page"), F.struct("l_orderkey", "l_partkey").alias("o"))
    path = shared_folder(spark, "index")
    json_runs.page_index_json(rows, "delivery", "part", "pdf", "page", "o").write.json(path)
    index = spark.read.schema("delivery long, json string").json(path)
    return json_runs.page_index(index, "json", "delivery")


@query("""
    SELECT c_mktsegment, count(*) AS entries, count(DISTINCT c_name) AS contents FROM customer GROUP BY 1
""")
def audit_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """An audit log appended in two runs, read whole."""
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), shared_folder(spark, "audit")
    for k in (0, 1):
        json_runs.append_audit(rows.where(F.col("c_custkey") % 2 == k), path, "c_name")
    return spark.read.json(path).groupBy("c_mktsegment").agg(F.count("*").alias("entries"), F.count_distinct("content_id").alias("contents"))


@query("""
    SELECT o_orderkey AS k, o_orderstatus AS s, false AS bad FROM orders WHERE o_orderkey % 10 > 0 UNION ALL SELECT NULL, NULL, true FROM orders WHERE o_orderkey % 10 = 0
""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which every tenth is broken."""
    k, path = F.col("o_orderkey"), shared_folder(spark, "lines")
    line = F.to_json(F.struct(k.alias("k"), F.col("o_orderstatus").alias("s")))
    table(spark, d, "orders").select(F.when(k % 10 == 0, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)).write.text(path)
    good, bad = json_runs.read_with_quarantine(spark, path, "k long, s string")
    return good.select("k", "s", F.lit(False).alias("bad")).unionByName(bad.select(F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("s"), F.lit(True).alias("bad")))


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS v, o_orderkey % 3 = 0 AS confirmed FROM orders) SELECT k, v + 1 AS v, confirmed OR k % 5 = 0 AS confirmed FROM o WHERE k % 7 > 0
""")
def manifest_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A job's manifest written, read, and written anew without losing its confirmations."""
    k, path = F.col("k"), shared_folder(spark, "manifest")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), (F.col("o_orderkey") % 3 == 0).alias("confirmed")).write.json(path)
    old = spark.read.schema("k long, v long, confirmed boolean").json(path)
    new = old.where(k % 7 > 0).select("k", (F.col("v") + 1).alias("v"), (k % 5 == 0).alias("confirmed"))
    return json_runs.merged_manifest(old, new, "k", "confirmed")


@query("SELECT DISTINCT 'HP' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') || 'CMP' AS value FROM supplier")
def fleet_file(spark: SparkSession, d: str) -> DataFrame:
    """A fleet list kept as JSON with noise around its names."""
    path = shared_folder(spark, "fleet")
    name = F.concat(F.lit(" hp-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("cmp"))
    table(spark, d, "supplier").select(F.to_json(F.array(name, name, F.lit("")))).write.text(path)
    return json_runs.load_list(spark, path, lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""))
