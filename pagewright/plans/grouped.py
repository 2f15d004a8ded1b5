"""Duplicates, votes, consensus and statistics on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import book_of
from pagewright.operators import evaluate, groups, registrations
from pagewright.plans.registry import query, table

LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
BOOK_SQL = "(o_orderkey // 100)::BIGINT AS series, CASE WHEN o_orderkey % 100 < 50 THEN 'A' ELSE 'B' END AS half"


def with_book(df: DataFrame, key: str) -> DataFrame:
    series, half = book_of(key)
    return df.withColumns({"series": series, "half": half})


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey) > 1 AS is_duplicate,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1 AS is_first FROM lineitem
""")
def dup_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", *LINE)
    return groups.flag_duplicates(rows, ["l_orderkey"], LINE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_duplicate", "is_first")


@query("""
    WITH r AS (SELECT *, l_returnflag <> 'N' AS chosen, bool_and(l_returnflag <> 'N') OVER (PARTITION BY l_orderkey) AS whole,
                      row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linestatus = 'F')::INT, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE NOT chosen OR (whole AND rn = 1)
""")
def purge_survivors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", *LINE, "l_returnflag", "l_linestatus")
    return groups.survivors(rows, ["l_orderkey"], LINE, F.col("l_returnflag") != "N", F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
    SELECT count(*) AS n_rows, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (l_quantity > 45) AS blanks, count(*) FILTER (n > 1 OR l_quantity > 45) AS either
    FROM (SELECT l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
""")
def purge_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = groups.flag_duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber"], ["l_partkey"])
    blank = F.col("l_quantity") > 45
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(blank).alias("blanks"), F.count_if(F.col("is_duplicate") | blank).alias("either"))


@query(f"""
    SELECT series || half AS book, count(*) AS n_rows, min(o_orderkey) AS first_number, max(o_orderkey) AS last_number, string_agg(o_orderstatus, ',' ORDER BY o_orderkey, o_orderstatus) AS in_order
    FROM (SELECT *, {BOOK_SQL} FROM orders) GROUP BY 1
""")
def book_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select(F.concat(F.col("series").cast("string"), "half").alias("book"), "o_orderkey", "o_orderstatus")
    return groups.group_books(rows, "book", "o_orderkey", "o_orderstatus")


@query(f"""
    SELECT series, half, o_orderpriority, votes FROM (
        SELECT *, row_number() OVER (PARTITION BY series, half ORDER BY votes DESC, o_orderpriority) AS rn
        FROM (SELECT series, half, o_orderpriority, count(*) AS votes FROM (SELECT o_orderpriority, {BOOK_SQL} FROM orders) GROUP BY ALL)) WHERE rn = 1
""")
def book_mode_vote(spark: SparkSession, d: str) -> DataFrame:
    return groups.mode_by(with_book(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey"), ["series", "half"], "o_orderpriority")


@query("""
    WITH rows AS (SELECT (l_orderkey // 100)::BIGINT AS book, lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS number, sum(l_quantity::BIGINT)::BIGINT AS w, count(*) AS n FROM lineitem GROUP BY ALL),
    digits AS (SELECT book, k AS place, substr(number, k::INT, 1) AS digit, sum(w) AS w FROM rows, range(1, 5) t(k) GROUP BY ALL),
    best AS (SELECT book, place, digit FROM (SELECT *, row_number() OVER (PARTITION BY book, place ORDER BY w DESC, digit) AS rn FROM digits) WHERE rn = 1),
    voted AS (SELECT book, string_agg(digit, '' ORDER BY place) AS voted FROM best GROUP BY book),
    heavy AS (SELECT book, number AS heaviest FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY w DESC, number) AS rn FROM rows) WHERE rn = 1),
    won AS (SELECT v.book, CASE WHEN EXISTS (SELECT 1 FROM rows r WHERE r.book = v.book AND r.number = v.voted) THEN v.voted ELSE h.heaviest END AS winner FROM voted v JOIN heavy h USING (book))
    SELECT w.book, w.winner, r.n AS support FROM won w JOIN rows r ON r.book = w.book AND r.number = w.winner
""")
def digit_weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("book"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0").alias("number"), F.col("l_quantity").cast("long").alias("weight"))
    return groups.digit_vote(rows, "book", "number", "weight", 4)


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def book_unanimous(spark: SparkSession, d: str) -> DataFrame:
    return groups.unanimous(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")


@query("""
    WITH c AS (SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS votes FROM orders GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, year) AS rn, (sum(votes) OVER (PARTITION BY o_custkey))::BIGINT AS readings FROM c)
    SELECT o_custkey, year, votes, readings FROM m WHERE rn = 1 AND readings >= 3 AND votes >= 2 AND votes * 5 >= readings * 3
""")
def year_consensus(spark: SparkSession, d: str) -> DataFrame:
    return groups.consensus(table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")), ["o_custkey"], "year")


@query(f"""
    SELECT series, half, year, count(DISTINCT o_custkey) AS support FROM (SELECT o_custkey, year(o_orderdate)::INT AS year, {BOOK_SQL} FROM orders) GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 2
""")
def book_years(spark: SparkSession, d: str) -> DataFrame:
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), "o_orderkey")
    return groups.supported_values(rows, ["series", "half"], "year", "o_custkey")


@query("""
    SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, grouping(l_returnflag, strftime(l_shipdate, '%Y-%m'))::INT AS level, count(*) AS n
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, strftime(l_shipdate, '%Y-%m')), (l_returnflag), (strftime(l_shipdate, '%Y-%m')), ())
""")
def rollup_stats(spark: SparkSession, d: str) -> DataFrame:
    return groups.rollup_counts(table(spark, d, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month")), "l_returnflag", "month")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity < 10) AS small FROM lineitem GROUP BY ALL
""")
def separation_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    return groups.distinct_summary(rows, ["l_returnflag", "l_linestatus"], {"discounted": F.col("l_discount") > 0.05, "small": F.col("l_quantity") < 10})


@query("""
    WITH e AS (SELECT user_id, CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) // 1000000 END AS started, (event_id % 60)::BIGINT AS seconds FROM events),
    w AS (SELECT user_id, (CASE WHEN count(started) = count(*) THEN max(started + seconds) - min(started) ELSE sum(seconds) END)::BIGINT AS wall, sum(seconds)::BIGINT AS measured FROM e GROUP BY user_id)
    SELECT user_id, wall, measured, CASE WHEN measured <> 0 THEN wall / measured END AS factor FROM w
""")
def wall_clock_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 17 != 0, F.unix_timestamp("ts")).alias("started"), (F.col("event_id") % 60).alias("seconds"))
    return groups.run_wall(rows, ["user_id"], "started", "seconds")


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey % 40 AS g, CASE WHEN o_orderkey % 7 <> 3 AND o_custkey % 40 <> 5 THEN o_orderdate::DATE END AS day FROM orders),
    gm AS (SELECT g, m FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, m DESC) AS rn FROM (SELECT g, date_trunc('month', day)::DATE AS m, count(*) AS n FROM o WHERE day IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
    rm AS (SELECT m FROM (SELECT date_trunc('month', day)::DATE AS m, count(*) AS n FROM o WHERE day IS NOT NULL GROUP BY ALL) ORDER BY n DESC, m DESC LIMIT 1)
    SELECT o_orderkey, coalesce(day, last_day(gm.m), last_day(rm.m)) AS filled, CASE WHEN day IS NOT NULL THEN 'read' WHEN gm.m IS NOT NULL THEN 'group_month' ELSE 'run_month' END AS method FROM o LEFT JOIN gm USING (g), rm
""")
def mode_month_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("g"), F.when((F.col("o_orderkey") % 7 != 3) & (F.col("o_custkey") % 40 != 5), F.to_date("o_orderdate")).alias("day"))
    return groups.dominant_month_cascade(rows, ["g"], "day").select("o_orderkey", "filled", "method")


@query("""
    SELECT l_orderkey, count(*) AS n_lines, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS qty_a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qty_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS qty_r FROM lineitem GROUP BY 1
""")
def wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0)).alias(f"qty_{x.lower()}")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), *map(flag, "ANR"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""
    WITH g AS (SELECT a::DOUBLE AS absent, p::DOUBLE AS present FROM (VALUES (0.02), (0.04)) t(a), (VALUES (0.04), (0.06), (0.08)) u(p) WHERE a < p),
    r AS (SELECT l_discount, (l_returnflag = 'R')::INT AS label FROM lineitem),
    s AS (SELECT absent, present, label, CASE WHEN l_discount >= present THEN 'present' WHEN l_discount <= absent THEN 'absent' ELSE 'unsure' END AS said FROM r, g),
    t AS (SELECT absent, present, count(*) FILTER (said = 'present' AND label = 0) AS false_present, count(*) FILTER (said = 'absent' AND label = 1) AS false_absent, count(*) FILTER (said = 'unsure') AS unsure, count(*) AS n FROM s GROUP BY ALL)
    SELECT absent, present, false_present, false_absent, unsure, (false_present * 5 + false_absent * 2 + unsure) / n AS cost FROM t
""")
def cost_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return evaluate.cost_grid(rows, "l_discount", "label", [0.02, 0.04], [0.04, 0.06, 0.08], 5, 2, 1)


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.stratified_folds(table(spark, d, "labels"), ["quality", "toxic"], ["doc_id"], 5).select("doc_id", "fold")


@query("""
    SELECT count(*) AS n_rows, count(*) FILTER (year(l_shipdate) = year(o_orderdate) AND month(l_shipdate) = month(o_orderdate)) AS exact, count(*) FILTER (year(l_shipdate) = year(o_orderdate)) AS same_year, count(*) FILTER (month(l_shipdate) = month(o_orderdate)) AS same_month
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def component_matches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("ly"), F.month("l_shipdate").alias("lm")).join(o, "l_orderkey")
    return evaluate.component_matches(rows, {"same_year": ("y", "ly"), "same_month": ("m", "lm")})


def registration_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages, partitioned by book as numbers, so that their texts are made where they are used and don't move."""
    raw = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 50).cast("long").alias("book"), *raw, "l_quantity").repartition("book").dropDuplicates(["book", *raw])
    number = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.lpad((F.col("l_suppkey") % 7 + 1710).cast("string"), 4, "0"))
    quality = F.when(F.col("l_linenumber") < 3, "clean").when(F.col("l_linenumber") < 5, "ambiguous").otherwise("weak")
    return rows.select(
        "book", F.col("l_orderkey").alias("log"), F.format_string("%03d-%09d-%06d", "l_linenumber", "l_partkey", "l_suppkey").alias("page"), number.alias("number"), (F.floor("l_quantity") / 50).alias("confidence"), quality.alias("quality")
    )


@query("""
    WITH p AS (SELECT DISTINCT ON (log, page) * FROM (SELECT (l_orderkey // 50)::BIGINT AS book, l_orderkey AS log, printf('%03d-%09d-%06d', l_linenumber, l_partkey, l_suppkey) AS page, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE lpad((l_suppkey % 7 + 1710)::VARCHAR, 4, '0') END AS number,
                    floor(l_quantity) / 50 AS confidence, CASE WHEN l_linenumber < 3 THEN 1.0::DOUBLE WHEN l_linenumber < 5 THEN 0.8::DOUBLE ELSE 0.25::DOUBLE END AS factor FROM lineitem)),
    e AS (SELECT * FROM (SELECT *, round_even(greatest(confidence, 0.05) * factor * 1000000, 0)::BIGINT AS weight, row_number() OVER (PARTITION BY book, log ORDER BY round_even(greatest(confidence, 0.05) * factor * 1000000, 0)::BIGINT DESC, page) AS rn FROM p WHERE number <> '') WHERE rn = 1),
    g AS (SELECT book, number, sum(weight)::BIGINT AS w, count(*) AS n FROM e GROUP BY ALL),
    digits AS (SELECT book, k AS place, substr(number, k::INT, 1) AS digit, sum(w) AS w FROM g, range(1, 5) t(k) GROUP BY ALL),
    voted AS (SELECT book, string_agg(digit, '' ORDER BY place) AS voted FROM (SELECT *, row_number() OVER (PARTITION BY book, place ORDER BY w DESC, digit) AS rn FROM digits) WHERE rn = 1 GROUP BY book),
    heavy AS (SELECT book, number AS heaviest FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY w DESC, number) AS rn FROM g) WHERE rn = 1),
    won AS (SELECT v.book, CASE WHEN EXISTS (SELECT 1 FROM g r WHERE r.book = v.book AND r.number = v.voted) THEN v.voted ELSE h.heaviest END AS winner FROM voted v JOIN heavy h USING (book)),
    s AS (SELECT w.book, w.winner, g.n AS support FROM won w JOIN g ON g.book = w.book AND g.number = w.winner)
    SELECT log, page, coalesce(winner, number) AS value, CASE WHEN winner IS NULL THEN 'no_vote' WHEN number = '' THEN 'filled' WHEN number = winner AND support >= 2 AND confidence >= 0.5 THEN 'confirmed' WHEN number = winner THEN 'kept' ELSE 'overwritten' END AS method FROM p LEFT JOIN s USING (book)
""")
def book_registrations(spark: SparkSession, d: str) -> DataFrame:
    pages = registration_pages(spark, d)
    winners = registrations.book_winners(registrations.unique_evidence(pages, "book", "log", "number", "confidence", "quality", "page"), "book", "number")
    return registrations.impose(pages, winners, "book", "number", "confidence").select("log", "page", "value", "method")


@query("""
    WITH n AS (SELECT c_name AS name, c_custkey // 3 AS base, c_custkey % 2 AS size FROM customer),
    w AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_name || '-2' END AS wanted, c_custkey // 3 AS base, c_custkey // 2 % 2 AS size FROM customer),
    m AS (SELECT w.wanted, w.size, n.name, 2 * (n.name <> w.wanted)::INT + (n.size <> w.size)::INT AS rank FROM w LEFT JOIN n USING (base)),
    b AS (SELECT wanted, size, rank, count(name) AS n, min(name) AS found FROM m GROUP BY ALL)
    SELECT wanted, CASE WHEN n = 1 THEN found END AS found FROM (SELECT *, row_number() OVER (PARTITION BY wanted, size ORDER BY rank) AS rn FROM b) WHERE rn = 1
""")
def ranked_name_match(spark: SparkSession, d: str) -> DataFrame:
    """All names looked up; three of four are copies, and three customers share a base name."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.floor(F.col("c_custkey") / 3).alias("base"), (F.col("c_custkey") % 2).alias("size"), "c_custkey")
    wanted = c.select(F.when(F.col("c_custkey") % 4 == 0, F.col("name")).otherwise(F.concat("name", F.lit("-2"))).alias("name"), "base", (F.floor(F.col("c_custkey") / 2) % 2).alias("size"))
    return registrations.ranked_names(wanted, c, "name", "base", "size")
