"""Flight numbers, review predicates, discrepancy classes, date windows, anchors and guards on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.flights import with_flight_number
from pagewright.operators import review
from pagewright.plans.registry import AS_OF, query, table


def now():
    return F.to_date(F.lit(AS_OF))


@query("""
    WITH r AS (SELECT o_orderkey, o_orderkey % 9 AS k, lpad((o_custkey % 1000)::VARCHAR, 3, '0') AS n FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN n = '000' THEN '' ELSE n END WHEN 1 THEN 'CM' || n WHEN 2 THEN 'TCK' WHEN 3 THEN 'SVC' || substr(n, 1, 1) WHEN 4 THEN 'SPV' WHEN 5 THEN 'A' || n WHEN 6 THEN '' WHEN 7 THEN 'TCK' ELSE 'SUP' || substr(n, 3, 1) END AS flight FROM r
""")
def flight_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Plain and prefixed numbers with misread digits, words with noise around them, words a stroke away, and noise."""
    n, k = F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.col("o_orderkey") % 9
    reading = (
        F.when(k == 0, n).when(k == 1, F.concat(F.lit("Flight no. cm"), F.translate(n, "150", "ISO"))).when(k == 2, "x tck visit").when(k == 3, F.concat(F.lit("SVC "), n)).when(k == 4, "s9v")
        .when(k == 5, F.concat(F.lit("a-"), n)).when(k == 6, "XYZW").when(k == 7, "jck").otherwise(F.concat(F.lit("5UP"), F.substring(n, 3, 1)))
    )
    return with_flight_number(table(spark, d, "orders").select("o_orderkey", reading.alias("reading")), "reading", "flight").drop("reading")


PAGE_SQL = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'HP-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || 'CMP' END AS reg, CASE WHEN o_orderkey % 4 = 0 THEN 'WARNING' ELSE 'OK' END AS reg_status, CASE o_orderkey % 5 WHEN 0 THEN 'book_correction' WHEN 1 THEN 'direct' END AS source,
           CASE o_orderkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS votes, CASE WHEN o_orderkey % 11 = 0 THEN '12' ELSE lpad(o_orderkey::VARCHAR, 7, '0') END AS log, CASE WHEN o_orderkey % 13 = 0 THEN 'ERROR' ELSE 'OK' END AS log_status,
           o_orderkey % 17 = 0 AS blank, o_orderstatus = 'P' AS date_review, o_orderkey % 19 = 0 AS flagged FROM orders
"""


def review_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    reg = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("HP-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("CMP")))
    part = lambda name, value, status, source, votes: F.struct(F.lit(name).alias("field_id"), value.alias("value"), status.alias("status"), source.alias("source"), votes.alias("votes"))
    none, ok = F.lit(None).cast("string"), lambda hit, bad: F.when(hit, bad).otherwise("OK")
    fields = F.array(
        part("matricula", reg, ok(k % 4 == 0, "WARNING"), F.when(k % 5 == 0, "book_correction").when(k % 5 == 1, "direct"), F.when(k % 3 == 1, 1).when(k % 3 == 2, 2)),
        part("log_number", F.when(k % 11 == 0, "12").otherwise(F.lpad(k.cast("string"), 7, "0")), ok(k % 13 == 0, "ERROR"), none, F.lit(None).cast("int")),
    )
    return table(spark, d, "orders").select("o_orderkey", fields.alias("fields"), (k % 17 == 0).alias("blank"), (F.col("o_orderstatus") == "P").alias("date_review"), (k % 19 == 0).alias("flagged"))


@query(f"""
    SELECT o_orderkey, NOT blank AND NOT date_review AND reg <> '' AND reg_status = 'OK' AND coalesce(votes >= 2, coalesce(source <> 'book_correction', true)) AND log <> '12' AND log_status = 'OK' AS ready,
           blank OR date_review OR flagged OR reg = '' OR log = '12' AS review FROM ({PAGE_SQL})
""")
def index_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Which pages need no hand, and which go to review."""
    p = review_pages(spark, d)
    ready, reviewed = review.ready_for_index("fields", F.col("blank"), F.col("date_review")), review.needs_review("fields", F.col("blank"), F.col("date_review"), F.col("flagged"))
    return p.select("o_orderkey", ready.alias("ready"), reviewed.alias("review"))


SIGNS = {"pilot": 3, "captain": 5, "captain_license": 7, "technician": 4, "technician_license": 6, "correction": 8}
_SIGN = ", ".join(f"CASE o_orderkey // {n} % 3 WHEN 0 THEN true WHEN 1 THEN false END AS {name}" for name, n in SIGNS.items())


def _lack(names: str, sure: str) -> str:
    return ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}:uncertain' WHEN {s} AND NOT {n} THEN '{n}:missing' END" for n, s in zip(names.split(), sure.split(), strict=True))


@query(f"""
    WITH s AS (SELECT o_orderkey, o_orderkey % 23 = 0 AS void, {_SIGN} FROM orders),
    k AS (SELECT *, CASE WHEN technician_license OR correction THEN CASE WHEN correction AND technician_license IS NOT true THEN 'correction' ELSE 'maintenance' END WHEN technician_license = false AND (captain OR captain_license OR pilot) THEN 'flight' ELSE 'unclear' END AS kind,
                 technician_license = false AND captain = false AND captain_license = false AND pilot = false AND correction IS NOT true AS unused FROM s),
    f AS (SELECT *, list_filter(CASE kind WHEN 'maintenance' THEN [{_lack("pilot technician technician_license", "true true true")}] WHEN 'correction' THEN [{_lack("pilot technician", "true true")}]
                    WHEN 'flight' THEN [{_lack("pilot captain captain_license", "true true true")}] ELSE [{_lack("technician_license captain captain_license pilot", "false false false true")}] END, lambda x: x IS NOT NULL) AS lacks FROM k)
    SELECT o_orderkey, kind, CASE WHEN len(list_filter(lacks, lambda x: contains(x, ':missing'))) > 0 THEN 'missing' ELSE 'uncertain' END AS category, coalesce(array_to_string(lacks, ','), '') AS lacks, len(list_filter(lacks, lambda x: contains(x, ':missing'))) > 0 AS confirmed
    FROM f WHERE NOT void AND unused IS NOT true AND (kind = 'unclear' OR len(lacks) > 0)
""")
def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    """Signatures that pages lack by the kind of entry; written corrections don't ask for the technician's licence."""
    k = F.col("o_orderkey")
    present = {name: F.when(F.floor(k / n) % 3 == 0, True).when(F.floor(k / n) % 3 == 1, False) for name, n in SIGNS.items()}
    rows = table(spark, d, "orders").withColumns(present | {"void": k % 23 == 0})
    found = rows.select("o_orderkey", review.discrepancy({n: F.col(n) for n in SIGNS}, F.col("void"), {"correction": ("pilot", "technician")}).alias("x")).where("x IS NOT NULL")
    lacks = F.array_join(F.transform("x.fields", lambda f: F.concat(f.field, F.lit(":"), f.category)), ",")
    return found.select("o_orderkey", "x.kind", "x.category", lacks.alias("lacks"), (F.col("x.category") == "missing").alias("confirmed"))


@query(f"""
    WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS date, CASE WHEN o_orderkey % 7 = 0 THEN 2000 ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 10 <> 5 THEN month(o_orderdate) END AS m, CASE WHEN o_orderkey % 4 > 0 THEN day(o_orderdate) END AS d FROM orders),
    v AS (SELECT *, coalesce(year(date), y) AS yy, coalesce(date, try_strptime(printf('%04d-%02d-%02d', y, m, coalesce(d, 1)), '%Y-%m-%d')::DATE) AS value FROM r),
    i AS (SELECT o_orderkey, CASE WHEN yy > 1998 THEN 'future year ' || yy WHEN value > DATE '{AS_OF}' THEN 'future date ' || strftime(value, '%Y/%m/%d') WHEN value < DATE '1998-01-01' AND year(value) NOT IN (1996, 1997) THEN 'old date ' || strftime(value, '%Y/%m/%d') ELSE '' END AS issue FROM v)
    SELECT o_orderkey, issue, concat_ws(' | ', 'seen', nullif(issue, '')) AS comment FROM i
""")
def date_window_review(spark: SparkSession, d: str) -> DataFrame:
    """Dates that can't be taken as they are; 1996 and 1997 are years of their books. An older reason of the window's gives way to the new one."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 > 0, day).alias("date"), F.when(k % 7 == 0, 2000).otherwise(F.year(day)).alias("y"), F.when(k % 10 != 5, F.month(day)).alias("m"), F.when(k % 4 > 0, F.dayofmonth(day)).alias("d")
    )
    issue = review.date_window_issue(F.col("date"), F.col("y"), F.col("m"), F.col("d"), F.lit(False), now(), F.array(F.lit(1996), F.lit(1997)))
    return rows.select("o_orderkey", issue.alias("issue")).withColumn("comment", review.with_own_reason(F.lit("old date 1990/01/01 | seen"), F.col("issue")))


@query(f"""
    WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS date, CASE o_orderkey % 6 WHEN 0 THEN 'WARNING' ELSE 'OK' END AS status, (o_orderkey % 100) / 100 AS conf, CASE o_orderkey % 7 WHEN 0 THEN 'inferred' ELSE 'direct' END AS source, o_orderkey % 8 = 0 AS other, CASE o_orderkey % 9 WHEN 0 THEN 'Fuzzy match' ELSE '' END AS note, o_orderkey % 10 <> 0 AS aligned FROM orders),
    a AS (SELECT *, status = 'OK' AND conf >= 0.5 AND source = 'direct' AND NOT other AND note = '' AS direct, status = 'WARNING' AND conf >= 0.35 AND source = 'direct' AND NOT other AND note = '' AS cells FROM r)
    SELECT o_orderkey, direct, aligned AND (direct OR cells) AS month_anchor, CASE WHEN direct AND aligned AND date <= DATE '{AS_OF}' AND year(date) >= 2000 THEN date END AS confirmed,
           CASE WHEN year(date) > 1998 THEN 'year' WHEN year(date) = 1998 AND month(date) > 8 THEN 'month' WHEN year(date) = 1998 AND month(date) = 8 AND day(date) > 2 THEN 'day' END AS after_run FROM a
""")
def trusted_readings(spark: SparkSession, d: str) -> DataFrame:
    """Which readings may stand for their book, dates confirmed by them, and parts that lie after the run."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    part = F.struct(
        F.when(k % 6 == 0, "WARNING").otherwise("OK").alias("status"), (k % 100 / 100).alias("confidence"), F.when(k % 7 == 0, "inferred").otherwise("direct").alias("source"), F.lit("date_cells").alias("inference_method"),
        F.when(k % 8 == 0, F.array(F.lit("3"))).otherwise(F.array().cast("array<string>")).alias("alternatives"), F.when(k % 9 == 0, "Fuzzy match").otherwise("").alias("comment"),
    )
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("day"), part.alias("p"), (k % 10 != 0).alias("aligned"))
    p, value = F.col("p"), F.dayofmonth("day")
    direct = review.is_direct_anchor(p, value)
    confirmed = review.confirmed_date(value, F.month("day"), F.year("day"), direct & F.col("aligned"), now())
    return rows.select("o_orderkey", direct.alias("direct"), review.book_anchor(p, value, F.col("aligned"), True).alias("month_anchor"), confirmed.alias("confirmed"), review.out_of_window(F.year("day"), F.month("day"), value, now()).alias("after_run"))


@query("""
    WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 31 + 1)::INT END AS d, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 12 + 1)::INT END AS m, CASE WHEN o_orderkey % 11 > 0 THEN 1997 END AS y FROM orders)
    SELECT o_orderkey, CASE WHEN d IS NULL OR m IS NULL OR y IS NULL THEN concat_ws(',', CASE WHEN d IS NULL THEN 'day' END, CASE WHEN m IS NULL THEN 'month' END, CASE WHEN y IS NULL THEN 'year' END)
                            WHEN d > day(last_day(make_date(y, m, 1))) THEN 'calendar' ELSE '' END AS unresolved FROM r
""")
def unresolved_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = F.when(k % 5 > 0, (k % 31 + 1).cast("int")), F.when(k % 7 > 0, (k % 12 + 1).cast("int")), F.when(k % 11 > 0, 1997)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(review.unresolved_parts(*parts), ",").alias("unresolved"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, first_place FROM (SELECT *, min(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey) AS first_place FROM lineitem) WHERE l_orderkey > first_place")
def repeated_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose part and supplier stood in an earlier order, with the first one."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws("-", "l_partkey", "l_suppkey").alias("key"))
    return review.repeated_numbers(rows, "key", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "first_place")


@query("""
    WITH b AS (SELECT o_orderkey // 100 AS book, min(o_orderpriority) AS expected FROM orders WHERE o_orderkey // 100 % 3 > 0 GROUP BY 1)
    SELECT o_orderkey, book, o_orderpriority AS value, expected FROM orders JOIN b ON o_orderkey // 100 = book WHERE o_orderpriority <> expected
""")
def registry_mismatches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 100).alias("book"), F.col("o_orderpriority").alias("value"))
    return review.against_registry(rows, rows.where("book % 3 > 0").groupBy("book").agg(F.min("value").alias("value")), "book", "value").select("o_orderkey", "book", "value", "expected")


@query("""
    WITH c AS (SELECT o_orderkey, o_custkey % 8 AS expected, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_custkey % 8 - o_orderkey % 3 + 1 END AS found, o_orderkey % 2 AS removed FROM orders)
    SELECT o_orderkey, CASE WHEN found = expected OR (removed > 0 AND found = expected - removed) THEN 'ok' WHEN found <= 0 THEN 'unknown' WHEN found < expected THEN 'missing' ELSE 'extra' END AS verdict FROM c
""")
def count_guards(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 8
    return table(spark, d, "orders").select("o_orderkey", review.count_verdict(n, F.when(k % 6 == 0, 0).otherwise(n - k % 3 + 1), k % 2).alias("verdict"))
