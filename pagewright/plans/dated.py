"""The date pass's steps over books of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import datepass
from pagewright.plans.grouped import BOOK_SQL, with_book
from pagewright.plans.ordered import BOOK
from pagewright.plans.registry import AS_OF, query, table

def key():
    return F.col("o_orderkey")


def now():
    return F.to_date(F.lit(AS_OF))


def pages(spark: SparkSession, d: str, day=None, month=None, year=None) -> DataFrame:
    """Orders as pages: unread parts and doubtful readings by their number."""
    date = F.to_date("o_orderdate")
    values = {"day": F.dayofmonth(date) if day is None else day, "month": F.month(date) if month is None else month, "year": F.year(date) if year is None else year}
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey")
    none = F.array().cast("array<int>")
    parts = {n: c.cast("int") for n, c in values.items()}
    rows = rows.withColumns(parts).withColumns({"number": key(), "page": F.lit(1), "blank": F.lit(False), "aligned": key() % 17 != 0, "strength": (key() % 10 / 10)})
    rows = rows.withColumns({f"{p}_ok": F.col(p).isNotNull() & (key() % 6 != k) for k, p in enumerate(datepass.PARTS)} | {f"{p}_alts": none for p in datepass.PARTS})
    return rows.withColumns({f"{p}_how": F.when(F.col(p).isNotNull(), "read").otherwise("none") for p in datepass.PARTS})


YEARS = f"SELECT o_orderkey, series, half, (CASE WHEN o_orderkey % 7 = 0 THEN year(o_orderdate) ELSE 1997 END)::INT AS y FROM (SELECT *, {BOOK_SQL} FROM orders)"


def _years(extra: str, keep: str) -> str:
    return f"""
    WITH r AS ({YEARS}), c AS (SELECT series, half, y, count(*) AS n FROM r GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY series, half ORDER BY n DESC, y DESC) AS rn, lead(n) OVER (PARTITION BY series, half ORDER BY n DESC, y DESC) AS second, sum(n) OVER (PARTITION BY series, half) AS total FROM c),
    m AS (SELECT series, half, y AS major FROM k WHERE rn = 1 AND n >= 2 AND n > coalesce(second, 0) AND n * 5 >= total * 3 {extra}),
    p AS (SELECT r.*, major, c.n, min(CASE WHEN r.y = major THEN o_orderkey END) OVER (PARTITION BY r.series, r.half) AS first, max(CASE WHEN r.y = major THEN o_orderkey END) OVER (PARTITION BY r.series, r.half) AS last FROM r JOIN c ON r.series = c.series AND r.half = c.half AND r.y = c.y LEFT JOIN m ON r.series = m.series AND r.half = m.half)
    SELECT o_orderkey, y AS read, CASE WHEN major IS NOT NULL AND y <> major {keep} AND NOT ((y - major = -1 AND o_orderkey < first) OR (y - major = 1 AND o_orderkey > last)) THEN major ELSE y END AS year FROM p
    """


def _year_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d, year=F.when(key() % 7 == 0, F.year("o_orderdate")).otherwise(1997)).withColumn("read", F.col("year"))


@query(_years("AND total >= 3", ""))
def year_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Years that a book's strict majority rules out."""
    return datepass.year_consensus(_year_pages(spark, d), BOOK).select("o_orderkey", "read", "year")


@query(_years("", "AND n < 2"))
def year_outliers(spark: SparkSession, d: str) -> DataFrame:
    """The same at the end of the pass: a year that a book has twice stays."""
    return datepass.year_consensus(_year_pages(spark, d), BOOK, outliers=True).select("o_orderkey", "read", "year")


MONTHS = f"SELECT o_orderkey, series, half, (CASE WHEN o_orderkey % 5 <> 2 THEN o_orderkey // 9 % 3 + 4 END)::INT AS m, o_orderkey % 6 <> 1 AND o_orderkey % 17 <> 0 AS trusted, o_orderkey % 17 <> 0 AS aligned FROM (SELECT *, {BOOK_SQL} FROM orders)"


def _month_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d, month=F.when(key() % 5 != 2, F.floor(key() / 9) % 3 + 4), year=F.lit(1997)).withColumn("read", F.col("month"))


@query(f"""
    WITH r AS (SELECT *, CASE WHEN trusted THEN m END AS t FROM ({MONTHS})),
    n AS (SELECT *, last_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM r WINDOW w AS (PARTITION BY series, half ORDER BY o_orderkey))
    SELECT o_orderkey, m AS read, CASE WHEN aligned AND a = b AND m IS DISTINCT FROM a THEN a ELSE m END AS month, CASE WHEN aligned AND a = b AND m IS DISTINCT FROM a THEN 'interval' WHEN m IS NULL THEN 'none' ELSE 'read' END AS how FROM n
""")
def months_between(spark: SparkSession, d: str) -> DataFrame:
    """Months between two equal trusted ones."""
    return datepass.between_anchors(_month_pages(spark, d), BOOK, "month").select("o_orderkey", "read", "month", F.col("month_how").alias("how"))


@query(f"""
    WITH r AS ({MONTHS}), a AS (SELECT series, half, list({{'k': o_orderkey, 'm': m}} ORDER BY o_orderkey) AS a FROM r WHERE trusted AND m IS NOT NULL GROUP BY ALL),
    j AS (SELECT r.*, CASE WHEN len(a) > 1 THEN a END AS a FROM r LEFT JOIN a USING (series, half)),
    e AS (SELECT *, CASE WHEN o_orderkey < a[1].k AND a[1].m = a[2].m AND a[1].k - o_orderkey <= 10 AND (m IS NULL OR m > a[1].m) THEN a[1].m WHEN o_orderkey > a[-1].k AND a[-1].m = a[-2].m AND o_orderkey - a[-1].k <= 10 AND (m IS NULL OR m < a[-1].m) THEN a[-1].m END AS edge FROM j)
    SELECT o_orderkey, m AS read, CASE WHEN aligned AND edge IS NOT NULL THEN edge ELSE m END AS month FROM e
""")
def months_beyond(spark: SparkSession, d: str) -> DataFrame:
    """Months ahead of a book's first trusted ones and behind its last, unread or impossible there."""
    return datepass.beyond_anchors(_month_pages(spark, d), BOOK, "month").select("o_orderkey", "read", "month")


@query(f"""
    WITH r AS (SELECT o_orderkey, series, half, o_orderdate::DATE AS day, (o_orderkey % 100)::INT AS n, CASE WHEN o_orderkey % 4 > 0 THEN 1997 END AS y, CASE WHEN o_orderkey % 3 > 0 THEN (CASE WHEN series % 3 = 0 AND o_orderkey % 40 = 13 THEN 9 ELSE 5 END)::INT END AS m, o_orderkey % 17 <> 0 AND o_orderkey % 6 > 2 AS trusted FROM (SELECT *, {BOOK_SQL} FROM orders)),
    g AS (SELECT *, n BETWEEN 10 AND 90 AND series % 2 = 0 AS inside, trusted AND y IS NOT NULL AND m IS NOT NULL AND NOT (make_date(y, m, 15) BETWEEN DATE '1997-05-02' AND DATE '1997-05-28') AS wrong FROM r),
    v AS (SELECT *, inside AND NOT bool_or(inside AND wrong) OVER (PARTITION BY series, half) AS fill FROM g)
    SELECT o_orderkey, CASE WHEN fill AND y IS NULL THEN 1997 ELSE y END AS year, CASE WHEN fill AND m IS NULL THEN 5 ELSE m END AS month FROM v
""")
def registry_fill(spark: SparkSession, d: str) -> DataFrame:
    """Unread months and years between two stored dates; books with a trusted date outside them are left alone."""
    month = F.when(key() % 3 > 0, F.when((F.floor(key() / 100) % 3 == 0) & (key() % 40 == 13), 9).otherwise(5))
    rows = pages(spark, d, day=F.lit(15), month=month, year=F.when(key() % 4 > 0, 1997)).withColumns({f"{p}_ok": F.col(f"{p}_ok") & (key() % 6 > 2) for p in datepass.PARTS}).withColumn("number", key() % 100)
    day = lambda n: F.to_date(F.lit(f"1997-05-{n:02d}"))
    stored = rows.where("series % 2 = 0").select(*BOOK).distinct().select(*BOOK, F.lit(10).alias("first_number"), day(2).alias("first_date"), F.lit(90).alias("last_number"), day(28).alias("last_date"))
    return datepass.fill_from_registry(rows, BOOK, stored).select("o_orderkey", "year", "month")


@query()
def date_pass(spark: SparkSession, d: str) -> DataFrame:
    """The whole pass: books that rise by a day a number, with unread, misread and impossible parts. Its steps have SQL or plain versions of their own."""
    true = F.date_add(F.to_date(F.lit("1997-03-01")), (key() % 100).cast("int"))
    day = F.when(key() % 5 != 3, F.when(key() % 11 == 0, F.dayofmonth(true) % 10).otherwise(F.dayofmonth(true)))
    rows = pages(spark, d, day=day, month=F.when(key() % 7 != 2, F.month(true)), year=F.when(key() % 13 != 4, F.when(key() % 23 == 0, 1999).otherwise(F.year(true))))
    got = datepass.date_pass(rows.drop(*[f"{p}_how" for p in datepass.PARTS]), BOOK, now())
    return got.select("o_orderkey", "date", "day_how", "month_how", "year_how", "regressed", "unresolved")
