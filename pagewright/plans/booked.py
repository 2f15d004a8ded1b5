"""Registrations and dates of whole books, and the registries that books are kept in, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import groups, registrations, registry
from pagewright.plans.grouped import BOOK_SQL, registration_pages, with_book
from pagewright.plans.joined import COST
from pagewright.plans.registry import query, table

PAGES = """
    SELECT DISTINCT ON (log, page) *, CASE WHEN factor = 1 THEN 'OK' ELSE 'WARNING' END AS status
    FROM (SELECT (l_orderkey // 50)::BIGINT AS book, l_orderkey AS log, printf('%03d-%09d-%06d', l_linenumber, l_partkey, l_suppkey) AS page, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE lpad((l_suppkey % 7 + 1710)::VARCHAR, 4, '0') END AS number,
                 floor(l_quantity) / 50 AS confidence, CASE WHEN l_linenumber < 3 THEN 1.0::DOUBLE WHEN l_linenumber < 5 THEN 0.8::DOUBLE ELSE 0.25::DOUBLE END AS factor FROM lineitem)
"""


@query(f"""
    WITH p AS ({PAGES}),
    e AS (SELECT * FROM (SELECT *, round_even(greatest(confidence, 0.05) * factor * 1000000, 0)::BIGINT AS weight, row_number() OVER (PARTITION BY book, log ORDER BY round_even(greatest(confidence, 0.05) * factor * 1000000, 0)::BIGINT DESC, page) AS rn FROM p WHERE number <> '') WHERE rn = 1),
    g AS (SELECT book, number, sum(weight)::BIGINT AS w, count(*) AS n, round_even(avg(weight) / 1000000, 3) AS c FROM e GROUP BY ALL),
    digits AS (SELECT book, k AS place, substr(number, k::INT, 1) AS digit, sum(w) AS w FROM g, range(1, 5) t(k) GROUP BY ALL),
    voted AS (SELECT book, string_agg(digit, '' ORDER BY place) AS voted FROM (SELECT *, row_number() OVER (PARTITION BY book, place ORDER BY w DESC, digit) AS rn FROM digits) WHERE rn = 1 GROUP BY book),
    heavy AS (SELECT book, number AS heaviest FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY w DESC, number) AS rn FROM g) WHERE rn = 1),
    won AS (SELECT v.book, CASE WHEN EXISTS (SELECT 1 FROM g r WHERE r.book = v.book AND r.number = v.voted) THEN v.voted ELSE h.heaviest END AS winner FROM voted v JOIN heavy h USING (book)),
    s AS (SELECT w.book, w.winner, g.n AS support, g.n >= 2 AND g.c >= 0.5 AS strong FROM won w JOIN g ON g.book = w.book AND g.number = w.winner),
    reg AS (SELECT DISTINCT book, CASE WHEN book % 4 = 0 THEN '9' || lpad((book % 1000)::VARCHAR, 3, '0') ELSE '1712' END AS stored FROM p WHERE book % 2 = 0),
    plan AS (SELECT book, winner, support, coalesce(strong, false) AS strong, stored FROM s FULL JOIN reg USING (book)),
    claims AS (SELECT claimed, count(DISTINCT book) AS claimants, min(book) AS claimant FROM (SELECT book, stored AS claimed FROM plan UNION ALL SELECT book, winner FROM plan WHERE strong) WHERE claimed IS NOT NULL GROUP BY 1),
    r AS (SELECT p.*, winner, support, coalesce(strong, false) AS strong, stored, number <> '' AS canonical, coalesce(claimants > 1 OR claimant <> p.book, false) AS elsewhere, coalesce(stored IS NOT NULL AND winner <> stored AND strong, false) AS against
          FROM p LEFT JOIN plan USING (book) LEFT JOIN claims ON number = claimed),
    v AS (SELECT *, stored IS NOT NULL AND NOT against AS by_registry, CASE WHEN stored IS NOT NULL AND NOT against THEN stored ELSE winner END AS val FROM r),
    w AS (SELECT *, canonical AND number <> val AS differs, NOT elsewhere AND list_sum([(substr(number, k, 1) <> substr(val, k, 1))::INT FOR k IN [1, 2, 3, 4]]) <= 1 AS near FROM v)
    SELECT log, page, coalesce(val, number) AS value,
           CASE WHEN val IS NULL THEN status WHEN against THEN 'WARNING' WHEN by_registry THEN CASE WHEN differs THEN 'WARNING' ELSE 'OK' END WHEN number = val THEN CASE WHEN strong THEN 'OK' ELSE status END WHEN NOT canonical AND strong THEN 'OK' ELSE 'WARNING' END AS new_status,
           CASE WHEN val IS NULL THEN 'no_vote' WHEN by_registry THEN 'stored' WHEN number = val THEN CASE WHEN status <> 'OK' AND strong THEN 'confirmed' ELSE 'kept' END ELSE 'digit_vote' END AS method,
           (CASE WHEN by_registry THEN 2 WHEN val IS NOT NULL AND (number <> val OR (status <> 'OK' AND strong)) THEN support END)::INT AS votes,
           coalesce(against OR (differs AND NOT (near AND (by_registry OR strong))), false) AS conflict FROM w
""")
def registration_pass(spark: SparkSession, d: str) -> DataFrame:
    """Books' registrations from their votes and a registry that knows every second book, one of two with another number."""
    pages = registration_pages(spark, d).withColumn("status", F.when(F.col("quality") == "clean", "OK").otherwise("WARNING"))
    books = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 50).cast("long").alias("book"))
    stored = books.where("book % 2 = 0").distinct().withColumn("stored", F.when(F.col("book") % 4 == 0, F.concat(F.lit("9"), F.lpad((F.col("book") % 1000).cast("string"), 3, "0"))).otherwise("1712"))
    return registrations.correct_by_book(pages, "book", "log", "page", "number", "confidence", "quality", "status", stored).select("log", "page", "value", "new_status", "method", "votes", "conflict")


READ_COST = COST.replace("a.n", "t.text").replace("b.m", "o.m")


@query(f"""
    WITH p AS (SELECT o_orderkey, o_orderkey // 50 AS book, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS n, lpad(((o_custkey + o_orderkey % 3) % 10000)::VARCHAR, 4, '0') AS text FROM orders),
    f AS (SELECT DISTINCT lpad((s_suppkey * 37 % 10000)::VARCHAR, 4, '0') AS m FROM supplier),
    a AS (SELECT DISTINCT n FROM p WHERE n NOT IN (SELECT m FROM f)),
    c AS (SELECT n, m, {COST}::INT AS cost FROM a, f b), r AS (SELECT *, min(cost) OVER (PARTITION BY n) AS least FROM c),
    t AS (SELECT n, m FROM r WHERE cost = least), k AS (SELECT n, count(*) AS ties, min(m) AS near FROM t GROUP BY n),
    q AS (SELECT x.book, x.n, o.m, sum({READ_COST})::BIGINT AS cost FROM (SELECT DISTINCT book, n FROM p) x JOIN k ON x.n = k.n AND k.ties > 1 JOIN t o ON x.n = o.n JOIN p t ON x.book = t.book GROUP BY ALL),
    b AS (SELECT book, n, min(m) AS chosen FROM (SELECT *, min(cost) OVER (PARTITION BY book, n) AS least FROM q) WHERE cost = least GROUP BY ALL HAVING count(*) = 1)
    SELECT o_orderkey, CASE WHEN k.n IS NULL THEN p.n WHEN ties = 1 THEN near ELSE chosen END AS fleet_value, CASE WHEN k.n IS NULL THEN 'known' WHEN ties = 1 THEN 'nearest' WHEN chosen IS NOT NULL THEN 'by_readings' ELSE 'unconfirmed' END AS fleet_method
    FROM p LEFT JOIN k USING (n) LEFT JOIN b ON p.book = b.book AND p.n = b.n
""")
def fleet_check(spark: SparkSession, d: str) -> DataFrame:
    """Numbers outside the fleet become the nearest of it; ties are left to what the book's pages read."""
    pad = lambda c: F.lpad((c % 10000).cast("string"), 4, "0")
    pages = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 50).alias("book"), pad(F.col("o_custkey")).alias("n"), pad(F.col("o_custkey") + F.col("o_orderkey") % 3).alias("text"))
    fleet = table(spark, d, "supplier").select(pad(F.col("s_suppkey") * 37).alias("number"))
    return registrations.against_fleet(pages, "book", "n", "text", fleet, "number").select("o_orderkey", "fleet_value", "fleet_method")


ANCHORS_SQL = "SELECT series || half AS book, o_orderkey // 2 AS log, (o_orderkey % 100 // 2)::INT AS number, CASE WHEN o_orderkey % 16 = 5 AND o_orderkey // 100 % 2 = 0 THEN o_orderdate::DATE ELSE DATE '1996-01-01' + (o_orderkey % 100)::INT // 2 END AS day FROM (SELECT *, {0} FROM orders)".format(BOOK_SQL)
FALLS = "list_bool_or([{0}[k].day < {0}[k - 1].day FOR k IN range(2, len({0}) + 1)])"
EXTREMES = "CASE WHEN len({0}) > 1 THEN [{0}[1], {0}[-1]] ELSE {0} END"


def _anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    half = F.floor(k % 100 / 2).cast("int")
    day = F.when((k % 16 == 5) & (F.floor(k / 100) % 2 == 0), F.to_date("o_orderdate")).otherwise(F.date_add(F.to_date(F.lit("1996-01-01")), half))
    return rows.select(F.concat(F.col("series").cast("string"), "half").alias("book"), F.floor(k / 2).alias("log"), half.alias("number"), day.alias("day"))


@query(f"""
    WITH one AS (SELECT book, log, min(number) AS number, min(day) AS day, count(DISTINCT day) AS kinds FROM ({ANCHORS_SQL}) GROUP BY ALL),
    o AS (SELECT book, list({{'number': number, 'day': day}} ORDER BY number, day) AS a, max(kinds) AS kinds FROM one GROUP BY book),
    p AS (SELECT book, a, CASE WHEN kinds > 1 THEN 'two dates' WHEN {FALLS.format("a")} THEN 'falling dates' END AS problem FROM o),
    s AS (SELECT book, CASE hash4 WHEN 0 THEN [{{'number': 0, 'day': DATE '1996-01-01'}}, {{'number': 24, 'day': DATE '1996-01-25'}}] WHEN 1 THEN [{{'number': 3, 'day': DATE '1996-01-04'}}] WHEN 2 THEN [{{'number': 3, 'day': DATE '1997-01-04'}}] END AS b
          FROM (SELECT book, substr(book, 1, length(book) - 1)::INT // 2 % 4 AS hash4 FROM p)),
    m AS (SELECT p.*, b, coalesce(b, []) AS st, list_sort(list_concat(list_filter(coalesce(b, []), lambda x: NOT list_contains(list_transform(a, lambda y: y.number), x.number)), a)) AS joint,
                 len(list_filter(coalesce(b, []), lambda x: len(list_filter(a, lambda y: y.number = x.number AND y.day <> x.day)) > 0)) > 0 AS differs FROM p LEFT JOIN s USING (book)),
    x AS (SELECT *, {EXTREMES.format("joint")} AS kept, differs OR coalesce({FALLS.format("joint")}, false) AS against FROM m)
    SELECT book, CASE WHEN problem IS NOT NULL THEN 'conflict' WHEN against THEN CASE WHEN len(a) < 2 THEN 'conflict' ELSE 'corrected' END WHEN st = kept THEN 'confirmed' WHEN len(st) > 0 THEN 'extended' ELSE 'new' END AS action,
           array_to_string(list_transform(CASE WHEN problem IS NOT NULL THEN b WHEN against THEN CASE WHEN len(a) < 2 THEN st ELSE {EXTREMES.format("a")} END ELSE kept END, lambda e: e.number || '=' || e.day), ',') AS anchors FROM x
""")
def date_registry_audit(spark: SparkSession, d: str) -> DataFrame:
    """Books' date anchors against a registry that holds the same, fewer, other or none."""
    observed = registry.observed_anchors(_anchor_rows(spark, d), "book", "log", "number", "day")
    mark = F.floor(F.expr("substring(book, 1, length(book) - 1)").cast("int") / 2) % 4
    entry = lambda *pairs: F.array(*[F.struct(F.lit(n).alias("number"), F.to_date(F.lit(v)).alias("day")) for n, v in pairs])
    anchors = F.when(mark == 0, entry((0, "1996-01-01"), (24, "1996-01-25"))).when(mark == 1, entry((3, "1996-01-04"))).when(mark == 2, entry((3, "1997-01-04")))
    stored = observed.select("book", anchors.alias("anchors")).where("anchors IS NOT NULL")
    got = registry.audit_dates(observed, stored, "book")
    return got.select("book", "action", F.array_join(F.transform("anchors", lambda a: F.concat_ws("=", a.number.cast("string"), a.day.cast("string"))), ",").alias("anchors"))


@query("""
    WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), st AS (SELECT k, n FROM c WHERE k % 3 <> 0), gone AS (SELECT k FROM st WHERE n NOT IN (SELECT s_nationkey FROM supplier) AND k NOT IN (SELECT k FROM c WHERE k % 5 = 0))
    SELECT k, CASE WHEN k % 7 = 0 THEN -1 ELSE n END AS n FROM c WHERE (k % 3 <> 0 AND k NOT IN (SELECT k FROM gone)) OR k % 7 = 0
""")
def registry_apply(spark: SparkSession, d: str) -> DataFrame:
    """A registry without entries that neither the fleet nor the run knows, and with the run's changes."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    stored, fleet = c.where("k % 3 <> 0"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))
    gone = registry.not_in_fleet(stored, fleet, c.where("k % 5 = 0"), "k", "n")
    return registry.applied(stored, gone, c.where("k % 7 = 0").withColumn("n", F.lit(-1)), "k").select("k", "n")


@query("""
    WITH a AS (SELECT c_custkey AS k, (c_custkey % 4)::INT AS x, DATE '1997-01-01' + (c_custkey % 4)::INT AS dx, (c_custkey % 6)::INT AS y, DATE '1997-01-01' + (CASE WHEN c_custkey % 5 = 0 THEN 40 ELSE (c_custkey % 6)::INT END) AS dy FROM customer)
    SELECT k, CASE WHEN x = y THEN CASE WHEN dx = dy THEN x || '=' || dx END WHEN x < y THEN CASE WHEN dy >= dx THEN x || '=' || dx || ',' || y || '=' || dy END ELSE CASE WHEN dx >= dy THEN y || '=' || dy || ',' || x || '=' || dx END END AS united FROM a
""")
def united_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Two copies' anchors in one entry, unless they contradict each other."""
    k, day = F.col("c_custkey"), lambda n: F.date_add(F.to_date(F.lit("1997-01-01")), n)
    one = lambda n, v: F.array(F.struct(n.alias("number"), v.alias("day")))
    x, y = (k % 4).cast("int"), (k % 6).cast("int")
    both = registry.united_anchors(one(x, day(x)), one(y, day(F.when(k % 5 == 0, 40).otherwise(y))))
    text = F.array_join(F.transform(both, lambda a: F.concat_ws("=", a.number.cast("string"), a.day.cast("string"))), ",")
    return table(spark, d, "customer").select(k.alias("k"), text.alias("united"))


@query("""
    WITH c AS (SELECT s_nationkey AS number, min(s_name) AS name FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) = 1) SELECT number, name FROM c
""")
def fleet_by_number(spark: SparkSession, d: str) -> DataFrame:
    return registry.fleet_by_number(table(spark, d, "supplier").select(F.col("s_nationkey").alias("number"), F.col("s_name").alias("name")), "number", "name")


@query("SELECT doc_id, coalesce(starts_with(source || '/' || lang, 'src1/') OR source = 'src2', false) AS gone FROM documents")
def forgotten_folders(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a folder, or of folders below one, that are forgotten; the rest stays."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "src2", F.col("source")).otherwise(F.concat_ws("/", "source", "lang")).alias("folder"))
    stays, gone = registry.forgotten(rows, "folder", ["src1", "src2"], below=True)
    return stays.select("doc_id", F.lit(False).alias("gone")).unionByName(gone.select("doc_id", F.lit(True).alias("gone")))


@query("""
    WITH v AS (SELECT o_custkey % 50 AS book, year(o_orderdate)::INT AS year FROM orders), w AS (SELECT CASE WHEN o.book % 10 > 0 THEN 1997 ELSE year END AS year, book FROM v o),
    g AS (SELECT year, count(*) AS votes, count(DISTINCT book) AS books FROM w GROUP BY 1), t AS (SELECT *, (sum(votes) OVER ())::BIGINT AS readings, row_number() OVER (ORDER BY votes DESC, year) AS rn, lead(votes) OVER (ORDER BY votes DESC, year) AS second FROM g)
    SELECT year, votes, books, readings FROM t WHERE rn = 1 AND votes >= 12 AND books >= 3 AND votes * 10 >= readings * 9 AND votes > coalesce(second, 0)
""")
def run_year_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The year that nearly all readings of a run agree on, across books."""
    book = F.col("o_custkey") % 50
    rows = table(spark, d, "orders").select(book.alias("book"), F.when(book % 10 > 0, 1997).otherwise(F.year("o_orderdate")).alias("year"))
    return groups.run_consensus(rows, "book", "year")
