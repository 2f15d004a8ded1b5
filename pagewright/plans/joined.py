"""Nearest, as-of, fallback, interval and merge joins on the supplied tables, and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import joins
from pagewright.plans.grouped import BOOK_SQL, with_book
from pagewright.plans.ordered import BOOK, MASKED, masked
from pagewright.plans.registry import query, table

COST = """list_sum([CASE WHEN substr(a.n, k, 1) = substr(b.m, k, 1) THEN 0 WHEN least(substr(a.n, k, 1), substr(b.m, k, 1)) || greatest(substr(a.n, k, 1), substr(b.m, k, 1)) IN ('17', '27', '12', '14', '47', '49', '07', '38', '35', '58', '56', '68', '08', '06', '09') THEN 6 ELSE 10 END FOR k IN [1, 2, 3, 4]])"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("reading"))


def fleet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.lpad((F.col("s_suppkey") * 37 % 10000).cast("string"), 4, "0").alias("number"))


@query(f"""
    WITH r AS (SELECT *, max(day) OVER (PARTITION BY series, half, o_orderkey) AS same,
                      last_value(CASE WHEN day IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln, last_value(day IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ld,
                      first_value(CASE WHEN day IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rn, first_value(day IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rd
               FROM {MASKED} WINDOW w AS (PARTITION BY series, half ORDER BY o_orderkey))
    SELECT o_orderkey, coalesce(day, same, CASE WHEN ln IS NOT NULL AND rn IS NOT NULL THEN CASE WHEN o_orderkey - ln < rn - o_orderkey THEN ld ELSE rd END WHEN ln IS NOT NULL THEN last_day(ld) ELSE rd END) AS dated,
           CASE WHEN day IS NOT NULL THEN 'read' WHEN same IS NOT NULL THEN 'same_number' WHEN ln IS NOT NULL AND rn IS NOT NULL THEN 'between' WHEN ln IS NOT NULL THEN 'month_end' WHEN rn IS NOT NULL THEN 'between' ELSE 'none' END AS method FROM r
""")
def asof_date(spark: SparkSession, d: str) -> DataFrame:
    return joins.asof_nearest(masked(spark, d), BOOK, "o_orderkey", "day").select("o_orderkey", "dated", "method")


@query(f"""
    WITH a AS (SELECT DISTINCT lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS n FROM orders), b AS (SELECT DISTINCT lpad((s_suppkey * 37 % 10000)::VARCHAR, 4, '0') AS m FROM supplier),
    c AS (SELECT n, m, {COST}::INT AS cost FROM a, b), r AS (SELECT *, rank() OVER (PARTITION BY n ORDER BY cost) AS k, row_number() OVER (PARTITION BY n ORDER BY cost, m) AS rn FROM c)
    SELECT n AS reading, max(m) FILTER (rn = 1) AS number, max(cost) FILTER (rn = 1) AS cost, count(*)::INT AS ties FROM r WHERE k = 1 GROUP BY n
""")
def nearest_dim(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_numbers(readings(spark, d), "reading", fleet(spark, d), "number")


@query(f"""
    WITH a AS (SELECT DISTINCT lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS n FROM orders), b AS (SELECT DISTINCT lpad((s_suppkey * 37 % 10000)::VARCHAR, 4, '0') AS m FROM supplier),
    c AS (SELECT n, m, {COST}::INT AS cost FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cost, m) AS rn FROM c),
    p AS (SELECT n, max(m) FILTER (rn = 1) AS m, max(cost) FILTER (rn = 1) AS c1, max(cost) FILTER (rn = 2) AS c2 FROM r GROUP BY n)
    SELECT 'HP-' || n AS reading, CASE WHEN c1 <= 9 AND coalesce(c2 - c1 >= 3, true) THEN m END AS match, CASE WHEN c1 <= 9 AND coalesce(c2 - c1 >= 3, true) THEN c1 END AS match_cost FROM p
""")
def confident_dim(spark: SparkSession, d: str) -> DataFrame:
    """Readings without their prefix, so that the one window of four characters is the number."""
    got = joins.confident_match(readings(spark, d), "reading", fleet(spark, d), "number")
    return got.select(F.concat(F.lit("HP-"), "reading").alias("reading"), "match", "match_cost")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber + 10 ELSE l_linenumber END AS page FROM lineitem),
    e AS (SELECT l_orderkey AS f, l_linenumber AS p, min(l_quantity) AS q FROM lineitem GROUP BY ALL HAVING count(*) = 1), o AS (SELECT l_orderkey AS f, min(l_quantity) AS q FROM lineitem GROUP BY ALL HAVING count(*) = 1)
    SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, coalesce(e.q, o.q) AS l_quantity, CASE WHEN e.q IS NOT NULL THEN 'exact' WHEN o.q IS NOT NULL THEN 'only_row' ELSE 'missing' END AS matched_by
    FROM r LEFT JOIN e ON r.l_orderkey = e.f AND r.page = e.p LEFT JOIN o ON r.l_orderkey = o.f
""")
def fallback_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    left = lines.drop("l_quantity").withColumn("page", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_linenumber") + 10).otherwise(F.col("l_linenumber")))
    right = lines.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("number"), "l_quantity")
    return joins.fallback_join(left, right, [("exact", [("l_orderkey", "file"), ("page", "number")]), ("only_row", [("l_orderkey", "file")])], "l_quantity").drop("page")


@query("""
    WITH s AS (SELECT l_suppkey AS k, l_linenumber AS v, min(l_orderkey) AS lo, min(l_orderkey) + 3000 AS hi FROM lineitem GROUP BY ALL), r AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS n FROM lineitem),
    m AS (SELECT r.k, r.n, count(*) AS c, min(v) AS v FROM r JOIN s ON r.k = s.k AND r.n BETWEEN lo AND hi GROUP BY ALL HAVING count(*) = 1)
    SELECT r.k AS key, r.n AS number, m.v AS value FROM r LEFT JOIN m USING (k, n)
""")
def interval_values(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    spans = lines.groupBy(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("value")).agg(F.min("l_orderkey").alias("low")).withColumn("high", F.col("low") + 3000)
    return joins.interval_lookup(lines.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("number")).distinct(), "key", "number", spans, "low", "high", "value").select("key", "number", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = l.l_partkey AND x.l_returnflag = 'A' AND x.l_suppkey <> l.l_suppkey)")
def semi_repeats(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return joins.semi_repeats(lines, lines.where("l_returnflag = 'A'"), "l_partkey", "l_suppkey", "l_suppkey").drop("l_returnflag")


@query("""
    SELECT o_orderkey, coalesce(n, 0) AS owners, CASE WHEN coalesce(n, 0) = 0 THEN 'gap' WHEN n = 1 THEN 'covered' ELSE 'repeated' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) ON o_orderkey = l_orderkey
""")
def coverage_states(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.coverage(table(spark, d, "orders").select("o_orderkey"), owners, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def anti_gaps(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("""
    WITH a AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 = 0)
    SELECT c_custkey, a.v AS observed, b.v AS stored, CASE WHEN b.v IS NULL THEN 'learn' WHEN a.v IS NULL THEN 'keep' WHEN a.v = b.v THEN 'confirm' ELSE 'conflict' END AS action FROM a FULL JOIN b USING (c_custkey)
""")
def registry_audit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    stored = c.where("c_custkey % 4 <> 0 OR c_custkey % 3 = 0").withColumn("v", F.when(F.col("c_custkey") % 5 == 0, "OTHER").otherwise(F.col("v")))
    return joins.full_compare(c.where("c_custkey % 3 <> 0"), stored, "c_custkey", "v")


@query("""
    WITH b AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 35 = 0), l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'L' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0),
    s AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'S' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0),
    j AS (SELECT c_custkey, l.v AS l, s.v AS s, b.v AS b FROM l FULL JOIN s USING (c_custkey) FULL JOIN b USING (c_custkey)),
    k AS (SELECT *, CASE WHEN l IS NOT NULL AND s IS NULL THEN 'push' WHEN l IS NULL AND s IS NOT NULL AND b IS NOT NULL AND s = b THEN 'skip' WHEN l IS NULL AND s IS NOT NULL THEN 'pull' WHEN l IS NULL AND s IS NULL THEN 'gone'
                            WHEN l = s THEN 'same' WHEN l IS NOT DISTINCT FROM b THEN 'server' WHEN s IS NOT DISTINCT FROM b THEN 'local' ELSE 'server_wins' END AS decision FROM j)
    SELECT c_custkey, CASE WHEN decision IN ('push', 'local', 'same') THEN l WHEN decision IN ('pull', 'server', 'server_wins') THEN s END AS merged, decision FROM k
""")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    changed = lambda n, mark: F.when(F.col("c_custkey") % n == 0, mark).otherwise(F.col("v"))
    local, server = c.where("c_custkey % 5 <> 0").withColumn("v", changed(4, "L")), c.where("c_custkey % 7 <> 0").withColumn("v", changed(6, "S"))
    return joins.three_way_merge(c.where("c_custkey % 11 <> 0 OR c_custkey % 35 = 0"), local, server, "c_custkey", "v")


@query("SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 3 <> 0")
def insert_only_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    return joins.insert_only(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0 OR c_custkey % 3 <> 0").withColumn("v", F.lit("NEW")), "c_custkey")


@query("SELECT user_id, event_type, bool_or(value > 90) AS done, min(ts) AS at, count(*) AS events FROM events GROUP BY ALL")
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", (F.col("value") > 90).alias("done"), F.col("ts").alias("at"))
    return joins.upsert_ledger(rows, ["user_id", "event_type"], "done", "at")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber = 1 AS header, EXISTS (SELECT 1 FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey = l_orderkey + l_linenumber) AS done FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, bool_or(NOT done AND NOT header) OVER (PARTITION BY l_orderkey) AS open FROM r) WHERE (NOT done AND NOT header) OR (header AND open)
""")
def pending_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") + F.col("l_linenumber")).alias("key"))
    done = table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("key"))
    return joins.pending_with_headers(rows, done, "key", "l_orderkey", F.col("l_linenumber") == 1).drop("key")


@query("""
    WITH h AS (SELECT l_suppkey AS batch, l_orderkey::VARCHAR = '101' AS exact, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE contains(l_orderkey::VARCHAR, '101'))
    SELECT batch, l_orderkey, l_linenumber, l_partkey, exact FROM h WHERE exact OR NOT EXISTS (SELECT 1 FROM h WHERE exact)
""")
def queue_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all batches: the exact ones, or the partial ones if no batch has an exact one."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("batch"), "l_orderkey", "l_linenumber", "l_partkey")
    return joins.exact_or_partial(rows, F.col("l_orderkey").cast("string"), "101")


@query("""
    WITH c AS (SELECT doc_id, lower(trim(lang, E' \\t\\n\\r')) AS lang, lower(trim(source, E' \\t\\n\\r')) AS source, lower(trim(text, E' \\t\\n\\r')) AS text FROM documents),
    r AS (SELECT doc_id, CASE WHEN contains(lang, 'de') THEN (lang <> 'de')::INT WHEN contains(source, 'de') THEN (source <> 'de')::INT WHEN contains(text, 'de') THEN (text <> 'de')::INT END AS rank, CASE WHEN contains(lang, 'de') THEN 'lang' WHEN contains(source, 'de') THEN 'source' ELSE 'text' END AS found FROM c)
    SELECT doc_id, rank, found FROM r WHERE rank IS NOT NULL
""")
def text_search_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matches: the first column that has the text says whether the cell is it (0) or holds it (1); exact ones first, then in the table's order."""
    match = F.lit(None)
    for c in ["text", "source", "lang"]:
        cell = F.lower(F.trim(c, F.lit(" \t\n\r")))
        match = F.when(cell.contains("de"), F.struct((cell != "de").cast("int").alias("rank"), F.lit(c).alias("found"))).otherwise(match)
    rows = table(spark, d, "documents").select("doc_id", match.alias("m")).where("m IS NOT NULL")
    return rows.select("doc_id", "m.rank", "m.found").orderBy("rank", "doc_id")


@query(f"""
    WITH b AS (SELECT series, half, max(o_custkey) AS control, count(DISTINCT o_orderstatus) AS kinds FROM (SELECT o_custkey, o_orderstatus, {BOOK_SQL} FROM orders) GROUP BY ALL)
    SELECT series, half, control, kinds = 1 AS agreed, CASE WHEN kinds = 1 THEN 'confirm' WHEN control % 2 = 0 THEN 'wait' ELSE 'conflict' END AS verdict FROM b
""")
def book_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey").groupBy(*BOOK).agg(F.max("o_custkey").alias("control"), F.count_distinct("o_orderstatus").alias("kinds"))
    return rows.select(*BOOK, "control", (F.col("kinds") == 1).alias("agreed"), F.when(F.col("kinds") == 1, "confirm").when(F.col("control") % 2 == 0, "wait").otherwise("conflict").alias("verdict"))


@query("""
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_nationkey END AS n, c_custkey % 8 = 0 AS valid FROM customer WHERE c_custkey % 9 <> 0),
    j AS (SELECT c.c_custkey, r.c_custkey IS NULL AS missing, r.s IS DISTINCT FROM c.c_mktsegment AS ds, r.n IS DISTINCT FROM c.c_nationkey AS dn, valid FROM customer c LEFT JOIN r USING (c_custkey))
    SELECT c_custkey, CASE WHEN missing THEN 'missing' WHEN NOT ds AND NOT dn THEN 'same' WHEN valid THEN 'skip' ELSE 'write' END AS action, CASE WHEN missing THEN '' ELSE concat_ws(',', CASE WHEN ds THEN 'c_mktsegment' END, CASE WHEN dn THEN 'c_nationkey' END) END AS changed FROM j
""")
def remote_plan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changed = lambda n, column, x: F.when(F.col("c_custkey") % n == 0, x).otherwise(F.col(column))
    remote = c.where("c_custkey % 9 <> 0").withColumns({"c_mktsegment": changed(4, "c_mktsegment", "X"), "c_nationkey": changed(6, "c_nationkey", -1), "valid": F.col("c_custkey") % 8 == 0})
    return joins.remote_plan(c, remote, "c_custkey", ["c_mktsegment", "c_nationkey"], "valid").select("c_custkey", "action", "changed")


@query("""
    WITH k AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS n, bool_or(l_returnflag = 'A') AS misfiled FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN n > 1 THEN 'delete' WHEN misfiled THEN 'reindex' ELSE 'none' END AS action, (CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS rows FROM k
""")
def correction_plan(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "duplicate").when(F.col("l_returnflag") == "A", "misfiled").otherwise("other")
    return joins.correction_plan(table(spark, d, "lineitem").select("l_orderkey", kind.alias("kind"), "l_linenumber"), "l_orderkey", "kind", "l_linenumber")


@query("""
    WITH a AS (SELECT l_suppkey, l_linenumber, min(l_returnflag) AS v FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_suppkey, l_linenumber, min(l_returnflag) AS v FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL),
    c AS (SELECT l_suppkey, count(*) FILTER (a.v = b.v) AS agree, count(*) FILTER (a.v <> b.v) AS differ FROM a JOIN b USING (l_suppkey, l_linenumber) GROUP BY 1)
    SELECT *, CASE WHEN agree >= 2 AND differ = 0 THEN 'same' WHEN differ > agree THEN 'other' ELSE 'unclear' END AS verdict FROM c
""")
def content_verdicts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    side = lambda k: lines.where(F.col("l_orderkey") % 2 == k).groupBy("l_suppkey", "l_linenumber").agg(F.min("l_returnflag").alias("v"))
    return joins.same_content(side(0), side(1), "l_suppkey", "l_linenumber", "v")
