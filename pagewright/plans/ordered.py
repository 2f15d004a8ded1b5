"""Windows, fills, islands, samples and per-book kernels on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.dates import years_outside_usual
from pagewright.operators import order, sequences
from pagewright.plans.grouped import BOOK_SQL, with_book
from pagewright.plans.registry import AS_OF, query, table

BOOK = ["series", "half"]


def masked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 2, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 7 != 3, F.to_date("o_orderdate")).alias("day"))
    return with_book(rows, "o_orderkey")


MASKED = f"(SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 2 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 <> 3 THEN o_orderdate::DATE END AS day, {BOOK_SQL} FROM orders)"


@query(f"""
    WITH r AS (SELECT *, lag(o_orderstatus) OVER w AS a, lead(o_orderstatus) OVER w AS b FROM (SELECT o_orderkey, o_orderstatus, {BOOK_SQL} FROM orders) WINDOW w AS (PARTITION BY series, half ORDER BY o_orderkey))
    SELECT o_orderkey, CASE WHEN a = b AND o_orderstatus <> a THEN a ELSE o_orderstatus END AS corrected, coalesce(a = b AND o_orderstatus <> a, false) AS was_corrected FROM r
""")
def lag_lead_bracket(spark: SparkSession, d: str) -> DataFrame:
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return order.bracket(rows, BOOK, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "corrected", "was_corrected")


@query(f"""
    WITH r AS (SELECT *, last_value(status IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(status IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM {MASKED} WINDOW w AS (PARTITION BY series, half ORDER BY o_orderkey))
    SELECT o_orderkey, CASE WHEN status IS NOT NULL THEN status WHEN a = b THEN a END AS filled, CASE WHEN status IS NOT NULL THEN 'read' WHEN a = b THEN 'between' ELSE 'none' END AS method FROM r
""")
def fill_between(spark: SparkSession, d: str) -> DataFrame:
    return order.fill_between(masked(spark, d), BOOK, "o_orderkey", "status").select("o_orderkey", "filled", "method")


@query(f"""
    WITH m AS (SELECT o_orderkey, series, half, CASE WHEN o_orderkey % 50 BETWEEN 8 AND 42 THEN status END AS status FROM {MASKED}),
    k AS (SELECT *, row_number() OVER (PARTITION BY series, half ORDER BY o_orderkey) AS up, row_number() OVER (PARTITION BY series, half ORDER BY o_orderkey DESC) AS down FROM m WHERE status IS NOT NULL),
    e AS (SELECT series, half, max(o_orderkey) FILTER (up = 1) AS fn, max(status) FILTER (up = 1) AS fv, max(status) FILTER (up = 2) AS fv2, max(o_orderkey) FILTER (down = 1) AS ln, max(status) FILTER (down = 1) AS lv, max(status) FILTER (down = 2) AS lv2 FROM k GROUP BY ALL)
    SELECT o_orderkey, coalesce(status, CASE WHEN o_orderkey < fn AND fn - o_orderkey <= 10 AND fv = fv2 THEN fv WHEN o_orderkey > ln AND o_orderkey - ln <= 10 AND lv = lv2 THEN lv END) AS filled FROM m LEFT JOIN e USING (series, half)
""")
def edge_extrapolate(spark: SparkSession, d: str) -> DataFrame:
    rows = masked(spark, d).withColumn("status", F.when((F.col("o_orderkey") % 50).between(8, 42), F.col("status")))
    return order.extrapolate_edges(rows, BOOK, "o_orderkey", "status").select("o_orderkey", "filled")


@query(f"""
    WITH r AS (SELECT *, last_value(day IGNORE NULLS) OVER (PARTITION BY series, half ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {MASKED})
    SELECT o_orderkey, day, before, coalesce(day < before, false) AS regressed FROM r
""")
def regressions(spark: SparkSession, d: str) -> DataFrame:
    return order.regressions(masked(spark, d), BOOK, ["o_orderkey"], "day").select("o_orderkey", "day", "before", "regressed")


@query("""
    WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey // 4 AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS island FROM r)
    SELECT l_suppkey, min(n)::BIGINT AS first_number, max(n)::BIGINT AS last_number, count(*) AS size FROM i GROUP BY l_suppkey, island
""")
def number_islands(spark: SparkSession, d: str) -> DataFrame:
    return order.islands(table(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_orderkey") / 4).cast("long").alias("n")), ["l_suppkey"], "n")


@query("""
    WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey AS n FROM lineitem), g AS (SELECT *, lead(n) OVER (PARTITION BY l_suppkey ORDER BY n) AS nx FROM r)
    SELECT l_suppkey, n + 1 AS gap_from, nx - 1 AS gap_to FROM g WHERE nx > n + 1
""")
def number_gaps(spark: SparkSession, d: str) -> DataFrame:
    return order.gaps(table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("n")), ["l_suppkey"], "n")


@query("SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS rolling_median FROM events")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return order.rolling_median(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "rolling_median")


@query(f"SELECT o_orderkey, last_value(status IGNORE NULLS) OVER (PARTITION BY series, half ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS status_filled, last_value(day IGNORE NULLS) OVER (PARTITION BY series, half ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS day_filled FROM {MASKED}")
def forward_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return order.forward_fill(masked(spark, d), BOOK, ["o_orderkey"], ["status", "day"]).select("o_orderkey", "status_filled", "day_filled")


@query("""
    SELECT event_id, (sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS section, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8)::INT AS chunk, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 8 + 1)::INT AS place FROM events
""")
def sections_and_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    rows = order.sections(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")
    return order.chunks(rows, ["user_id"], ["ts", "event_id"], 8).select("event_id", "section", "chunk", "place")


@query(f"""
    WITH r AS (SELECT o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series, half) AS n FROM (SELECT o_orderkey, {BOOK_SQL} FROM orders) WINDOW w AS (PARTITION BY series, half ORDER BY o_orderkey))
    SELECT o_orderkey FROM r WHERE n <= 7 OR i IN (SELECT round_even(j * (n - 1) / 6.0, 0)::BIGINT FROM range(7) t(j))
""")
def spread_sample(spark: SparkSession, d: str) -> DataFrame:
    return order.spread_sample(with_book(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), BOOK, ["o_orderkey"], 7).select("o_orderkey")


@query("""
    WITH v AS (SELECT l_suppkey, trim(CASE WHEN l_linenumber = 7 THEN ' ' WHEN l_linenumber = 6 THEN NULL ELSE ' ' || (l_partkey % 40) END) AS seen, min((l_orderkey, l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM v WHERE seen <> '')
    SELECT l_suppkey, seen FROM r WHERE n <= 5 OR i IN (SELECT round_even(j * (n - 1) / 4.0, 0)::BIGINT FROM range(5) t(j))
""")
def spread_values(spark: SparkSession, d: str) -> DataFrame:
    """Five different values of each supplier, spread over their first places."""
    seen = F.when(F.col("l_linenumber") == 7, " ").when(F.col("l_linenumber") != 6, F.concat(F.lit(" "), (F.col("l_partkey") % 40).cast("string")))
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", seen.alias("seen"))
    return order.spread_values(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "seen", 5)


@query("""
    WITH r AS (SELECT event_id, user_id AS g, CASE WHEN event_id % 9 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN event_type ELSE (event_id % 37)::VARCHAR END AS t FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY g ORDER BY (trim(t) = '')::INT, try_cast(t AS DOUBLE) IS NULL, coalesce(try_cast(t AS DOUBLE), 0), CASE WHEN try_cast(t AS DOUBLE) IS NULL THEN lower(trim(t)) ELSE '' END, event_id)::INT AS place FROM r
""")
def numeric_text_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 == 0, " ").when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("event_id") % 37).cast("string"))
    return order.numeric_text_rank(table(spark, d, "events").select("event_id", F.col("user_id").alias("g"), text.alias("t")), ["g"], "t", "event_id").select("event_id", "place")


@query(f"SELECT series, half, arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value FROM (SELECT o_orderkey, o_totalprice, {BOOK_SQL} FROM orders) GROUP BY ALL")
def book_extremes(spark: SparkSession, d: str) -> DataFrame:
    return order.first_last(with_book(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), BOOK, "o_orderkey", "o_totalprice")


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 23 <> 1 THEN o_orderdate::DATE END AS day FROM orders)
    SELECT o_orderkey, bool_and(day IS NOT NULL) OVER (PARTITION BY o_custkey) AND row_number() OVER (PARTITION BY o_custkey ORDER BY day NULLS FIRST, o_orderkey) <> 1 AS deletable FROM o
""")
def keep_oldest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 23 != 1, F.to_date("o_orderdate")).alias("day"))
    return order.keep_oldest(rows, ["o_custkey"], "day", "o_orderkey").select("o_orderkey", "deletable")


@query(f"""
    WITH r AS (SELECT o_orderkey, day(o_orderdate)::INT AS dd, lag(day(o_orderdate)::INT) OVER w AS a, lead(day(o_orderdate)::INT) OVER w AS b FROM (SELECT *, {BOOK_SQL} FROM orders) WINDOW w AS (PARTITION BY series, half ORDER BY o_orderkey)),
    c AS (SELECT o_orderkey, arg_min(x, (abs(x * 2 - a - b), x)) AS x FROM (SELECT *, dd + t AS x FROM r, (VALUES (0), (10), (20), (30)) v(t)) WHERE x BETWEEN a AND b AND x <= 31 GROUP BY 1)
    SELECT r.o_orderkey, dd, CASE WHEN dd < 10 AND abs(dd - a) > 7 AND abs(dd - b) > 7 AND a <= b AND c.x IS NOT NULL THEN c.x ELSE dd END AS completed FROM r LEFT JOIN c USING (o_orderkey)
""")
def lost_tens(spark: SparkSession, d: str) -> DataFrame:
    rows = with_book(table(spark, d, "orders").select("o_orderkey", F.dayofmonth("o_orderdate").alias("dd")), "o_orderkey")
    return order.lost_tens(rows, BOOK, ["o_orderkey"], "dd").select("o_orderkey", "dd", "completed")


SAME = "{0}.series = {1}.series AND {0}.half = {1}.half"


@query(f"""
    WITH RECURSIVE r AS (
        SELECT o_orderkey, series, half, row_number() OVER (PARTITION BY series, half ORDER BY o_orderkey) AS i, day(o_orderdate)::INT AS dd, date_trunc('month', o_orderdate)::DATE AS first, o_orderkey % 28 + 1 AS other, o_orderkey % 10 * 100000 AS strength
        FROM (SELECT *, {BOOK_SQL} FROM orders)),
    o AS MATERIALIZED (
        SELECT series, half, i, first + (d - 1)::INT AS v, CASE WHEN d = dd THEN 0 ELSE strength + 10000 * abs(d - dd) + CASE WHEN d = other OR (dd < 10 AND d IN (dd + 10, dd + 20, dd + 30)) THEN 0 ELSE 500000 END END AS cost
        FROM r, range(1, 32) t(d) WHERE d <= day(last_day(first))),
    dp AS (
        SELECT series, half, i, v, cost::HUGEINT AS total, NULL::DATE AS back FROM o WHERE i = 1
        UNION ALL
        SELECT series, half, i, v, CASE WHEN fits THEN cost + least ELSE cost END, CASE WHEN fits THEN back END
        FROM (SELECT *, bool_or(least IS NOT NULL) OVER (PARTITION BY series, half) AS fits
              FROM (SELECT o.series, o.half, o.i, o.v, o.cost, min(dp.total) FILTER (dp.v <= o.v) AS least, arg_min(dp.v, dp.total * 100000 + (dp.v - DATE '1970-01-01')) FILTER (dp.v <= o.v) AS back
                    FROM dp JOIN o ON {SAME.format("o", "dp")} AND o.i = dp.i + 1 GROUP BY ALL))
        WHERE NOT fits OR least IS NOT NULL),
    best AS MATERIALIZED (SELECT series, half, i, arg_min(v, total * 100000 + (v - DATE '1970-01-01')) AS v FROM dp GROUP BY ALL),
    chosen AS (
        SELECT b.* FROM best b JOIN (SELECT series, half, max(i) AS i FROM r GROUP BY ALL) e ON {SAME.format("b", "e")} AND b.i = e.i
        UNION ALL
        SELECT c.series, c.half, c.i - 1, coalesce(d.back, b.v) FROM chosen c JOIN dp d ON {SAME.format("c", "d")} AND c.i = d.i AND c.v = d.v JOIN best b ON {SAME.format("c", "b")} AND b.i = c.i - 1)
    SELECT o_orderkey, dd AS day, day(c.v)::INT AS repaired_day FROM r JOIN chosen c ON {SAME.format("r", "c")} AND r.i = c.i
""")
def day_repair_dp(spark: SparkSession, d: str) -> DataFrame:
    """Dates that fall within a book repaired at the least cost; a row names one other day, and its day's tens if it has one digit."""
    day = F.dayofmonth("day")
    named = F.array_union(F.array((F.col("o_orderkey") % 28 + 1).cast("int")), F.when(day < 10, F.array(day + 10, day + 20, day + 30)).otherwise(F.array().cast("array<int>")))
    rows = with_book(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 10 / 10).alias("strength")), "o_orderkey").withColumn("named", named)
    return sequences.repair_days_by_book(rows, BOOK, ["o_orderkey"], "day", "strength", "named").select("o_orderkey", day.alias("day"), "repaired_day")


@query(f"""
    WITH RECURSIVE r AS (
        SELECT o_orderkey, series, half, row_number() OVER (PARTITION BY series, half ORDER BY o_orderkey) AS i, o_orderdate::DATE AS day FROM (SELECT *, {BOOK_SQL} FROM orders)),
    x AS MATERIALIZED (
        SELECT series, half, i, k, v, c, greatest(DATE '1998-07-01' - v, v - DATE '{AS_OF}', 0) // 365 AS o
        FROM (SELECT series, half, i, 0 AS k, day AS v, 0 AS c FROM r
              UNION ALL SELECT series, half, i, 1, make_date(year(day), day(day), month(day)), 2 FROM r WHERE day(day) <= 12 AND day(day) <> month(day)
              UNION ALL SELECT series, half, i, 2, make_date(year(day) - 1, month(day), day(day)), 1 FROM r WHERE o_orderkey % 3 = 0 AND strftime(day, '%m%d') <> '0229')),
    dp AS (
        SELECT series, half, i, k, v, [o, 0, c, 0, -1]::BIGINT[] AS m FROM x WHERE i = 1
        UNION ALL
        SELECT x.series, x.half, x.i, x.k, x.v, min([dp.m[1] + x.o, dp.m[2] + (x.v < dp.v)::INT, dp.m[3] + x.c, dp.m[4] + abs(x.v - dp.v), dp.k]::BIGINT[]) FROM dp JOIN x ON {SAME.format("x", "dp")} AND x.i = dp.i + 1 GROUP BY ALL),
    read AS (SELECT series, half, count(*) AS n, sum(fall) AS falls, sum(o) AS outside FROM (SELECT *, (v < lag(v) OVER (PARTITION BY series, half ORDER BY i))::INT AS fall FROM x WHERE k = 0) GROUP BY ALL),
    won AS (SELECT series, half, i, min([m[1], m[2], m[3], m[4], k]::BIGINT[]) AS m FROM dp GROUP BY ALL),
    chosen AS (
        SELECT w.series, w.half, w.i, w.m[5] AS k FROM won w JOIN read ON {SAME.format("w", "read")} AND w.i = read.n WHERE falls > 0 AND w.m[2] < falls AND (w.m[1] < outside OR (w.m[1] = outside AND w.m[2] < falls))
        UNION ALL
        SELECT c.series, c.half, c.i - 1, dp.m[5] FROM chosen c JOIN dp ON {SAME.format("c", "dp")} AND c.i = dp.i AND c.k = dp.k WHERE c.i > 1),
    named AS (SELECT *, row_number() OVER (PARTITION BY series, half, i ORDER BY k) - 1 AS place FROM x)
    SELECT o_orderkey, r.day, coalesce(x.v, r.day) AS chosen_day, coalesce(x.place, 0)::INT AS chosen FROM r LEFT JOIN chosen c ON {SAME.format("r", "c")} AND r.i = c.i LEFT JOIN named x ON {SAME.format("c", "x")} AND c.i = x.i AND c.k = x.k
""")
def sequence_dp(spark: SparkSession, d: str) -> DataFrame:
    """A book's dates chosen among each row's readings: day and month the other way round, or the year before."""
    day, as_of = F.col("day"), F.to_date(F.lit(AS_OF))
    swapped = F.when((F.dayofmonth(day) <= 12) & (F.dayofmonth(day) != F.month(day)), F.make_date(F.year(day), F.dayofmonth(day), F.month(day)))
    year_before = F.when((F.col("o_orderkey") % 3 == 0) & (F.date_format(day, "MMdd") != "0229"), F.add_months(day, -12))
    options = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(c).alias("c"))) for v, c in ((day, 0), (swapped, 2), (year_before, 1))]))
    rows = with_book(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey").withColumn("x", options)
    rows = rows.select("o_orderkey", *BOOK, "day", F.col("x.v").alias("options"), F.col("x.c").alias("changes"), F.transform("x.v", lambda v: years_outside_usual(v, as_of)).alias("outside"))
    got = sequences.best_dates_by_book(rows, BOOK, ["o_orderkey"], "options", "changes", "outside")
    return got.select("o_orderkey", "day", F.get("options", F.col("chosen")).alias("chosen_day"), "chosen")


@query(f"""
    WITH r AS (SELECT o_orderkey, series, half, date_trunc('month', CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END)::DATE AS m, CASE WHEN o_orderkey % 4 <> 1 THEN day(o_orderdate)::INT END AS d, o_orderkey // 3 AS n FROM (SELECT *, {BOOK_SQL} FROM orders)),
    s AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY series, half ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT * REPLACE (make_date(1997, (1 + n % 12)::INT, 1) AS m) FROM r WHERE m IS NOT NULL UNION ALL SELECT * FROM r WHERE m IS NULL)),
    t AS (SELECT *, sum((m IS NOT NULL AND m IS DISTINCT FROM p)::INT) OVER (PARTITION BY series, half ORDER BY o_orderkey) AS run,
                 first_value(CASE WHEN m IS NOT NULL AND d IS NOT NULL THEN {{'m': m, 'd': d}} END IGNORE NULLS) OVER (PARTITION BY series, half ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM s),
    u AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN d END IGNORE NULLS) OVER (PARTITION BY series, half, run ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t)
    SELECT o_orderkey, d AS day, CASE WHEN d IS NOT NULL OR m IS NULL THEN d ELSE least(day(last_day(m)), greatest(least(day(last_day(m)), CASE WHEN a.m = m THEN a.d ELSE 31 END), coalesce(b, 0)))::INT END AS filled_day FROM u
""")
def month_end_days(spark: SparkSession, d: str) -> DataFrame:
    """Unread days filled with the last one that fits; three numbers in a row share a month."""
    month = F.when(F.col("o_orderkey") % 13 != 0, F.make_date(F.lit(1997), (1 + F.floor(F.col("o_orderkey") / 3) % 12).cast("int"), F.lit(1)))
    rows = with_book(table(spark, d, "orders").select("o_orderkey", month.alias("month"), F.when(F.col("o_orderkey") % 4 != 1, F.dayofmonth("o_orderdate")).alias("day")), "o_orderkey")
    return order.fill_days_to_month_end(rows, BOOK, ["o_orderkey"], "month", "day").select("o_orderkey", "day", "filled_day")


@query("""
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY series, half ORDER BY l_orderkey) AS i FROM (SELECT l_orderkey // 100 AS series, CASE WHEN l_orderkey % 100 < 50 THEN 'A' ELSE 'B' END AS half, l_orderkey, count(*) AS n_pages FROM lineitem GROUP BY ALL)),
    p AS (
        SELECT series, half, l_orderkey, i, 0::BIGINT AS part, n_pages // 20 AS after, CASE WHEN n_pages >= 20 THEN 0 ELSE n_pages END AS used FROM (SELECT * REPLACE (CASE WHEN n_pages >= 20 THEN n_pages + 19 ELSE n_pages END AS n_pages) FROM s) WHERE i = 1
        UNION ALL
        SELECT series, half, l_orderkey, i, part, CASE WHEN filled >= 20 THEN part + (filled + 19) // 20 ELSE part END, CASE WHEN filled >= 20 THEN 0 ELSE filled END
        FROM (SELECT s.series, s.half, s.l_orderkey, s.i, p.after + (p.used > 0 AND p.used + s.n_pages > 20)::INT AS part, CASE WHEN p.used > 0 AND p.used + s.n_pages > 20 THEN 0 ELSE p.used END + s.n_pages AS filled
              FROM p JOIN s ON p.series = s.series AND p.half = s.half AND s.i = p.i + 1))
    SELECT p.series, p.half, p.l_orderkey, s.n_pages, part::INT AS part FROM p JOIN s USING (series, half, i)
""")
def pack_next_fit(spark: SparkSession, d: str) -> DataFrame:
    """The sections of a book packed in order into parts of twenty pages."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_pages"))
    return sequences.pack_sections(with_book(rows, "l_orderkey").select(*BOOK, "l_orderkey", "n_pages"), BOOK, ["l_orderkey"], "n_pages", 20)


@query("""
    WITH r AS (SELECT o_orderkey // 200 AS file, o_orderkey + 3 * (o_orderkey // 20) AS page, o_orderkey % 11 = 0 AS blank,
                      CASE WHEN o_orderkey % 6 > 1 AND o_orderkey % 11 <> 0 THEN o_orderkey - CASE WHEN o_orderkey % 400 >= 350 THEN 200 ELSE 0 END END AS number, CASE WHEN o_orderkey % 35 = 6 THEN '9999999' WHEN o_orderkey % 2 = 0 THEN '12' END AS reading,
                      o_orderkey % 53 = 9 AND o_orderkey % 6 <= 1 AND o_orderkey % 11 <> 0 AS fieldless FROM orders),
    s AS (SELECT *, sum((page <> p + 1 OR fieldless OR f)::INT) OVER (PARTITION BY file ORDER BY page) AS seg FROM (SELECT *, lag(page) OVER (PARTITION BY file ORDER BY page) AS p, lag(fieldless) OVER (PARTITION BY file ORDER BY page) AS f FROM r)),
    g AS (SELECT *, count(number) OVER (PARTITION BY file, seg ORDER BY page) AS grp FROM s WHERE NOT blank),
    t AS (SELECT *, max(number) OVER (PARTITION BY file, seg, grp) AS before, max(CASE WHEN number IS NOT NULL THEN page END) OVER (PARTITION BY file, seg, grp) AS at_page, count(*) FILTER (number IS NULL) OVER (PARTITION BY file, seg, grp) AS n,
                 row_number() OVER (PARTITION BY file, seg, grp ORDER BY page) - 1 AS k FROM g),
    u AS (SELECT t.*, before + k AS new, first_value(number IGNORE NULLS) OVER (PARTITION BY file, seg ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM t),
    v AS (SELECT *, bool_and(new NOT IN (SELECT number FROM r WHERE number IS NOT NULL) AND coalesce(reading, '') <> '9999999') OVER (PARTITION BY file, at_page) AS ok FROM u WHERE number IS NULL AND before IS NOT NULL AND after - before = n + 1 AND before // 50 = after // 50),
    w AS (SELECT *, dense_rank() OVER (PARTITION BY before ORDER BY file, at_page) AS first FROM v WHERE ok)
    SELECT r.file, r.page, coalesce(r.number, w.new) AS filled FROM r LEFT JOIN w ON r.file = w.file AND r.page = w.page AND w.first = 1
""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Unread numbers between read ones: with blank pages, pages without the field, jumps, numbers that other files have, and readings of sevenfold nines that fit no number."""
    n = F.col("o_orderkey")
    number = F.when((n % 6 > 1) & (n % 11 != 0), n - F.when(n % 400 >= 350, 200).otherwise(0))
    reading = F.when(n % 35 == 6, "9999999").when(n % 2 == 0, "12")
    rows = table(spark, d, "orders").select(F.floor(n / 200).cast("long").alias("file"), (n + 3 * F.floor(n / 20)).cast("long").alias("page"), (n % 11 == 0).alias("blank"), number.alias("number"), reading.alias("reading"), (n % 53 != 9).alias("field"))
    return sequences.fill_gaps(rows, ["file"], "page", "number", "reading", "blank", "field").select("file", "page", "filled")


@query("""
    SELECT user_id, list_reduce(list(value::DOUBLE ORDER BY event_id), lambda a, x: CASE WHEN x < a THEN x * 0.8::DOUBLE + a * (1 - 0.8::DOUBLE) ELSE x * 0.5::DOUBLE + a * (1 - 0.5::DOUBLE) END) AS pace FROM events WHERE value IS NOT NULL GROUP BY user_id
""")
def smoothed_pace(spark: SparkSession, d: str) -> DataFrame:
    return sequences.smoothed_pace(table(spark, d, "events").select("user_id", "event_id", "value").where("value IS NOT NULL"), ["user_id"], "event_id", "value")


@query("""
    WITH e AS (SELECT event_id, user_id, ts, event_type = 'view' AS pending FROM events)
    SELECT event_id, pending AND coalesce(max(ts) FILTER (NOT pending) OVER (PARTITION BY user_id) > ts, false) AS overtaken FROM e
""")
def overtaken_events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.overtaken(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], "ts", F.col("event_type") == "view").select("event_id", "overtaken")


@query("""
    WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, ceil(count(*) OVER (PARTITION BY user_id) / 8.0)::BIGINT AS n FROM events)
    SELECT event_id, (i % n)::INT AS batch FROM r
""")
def strided_batches(spark: SparkSession, d: str) -> DataFrame:
    return order.strided_batches(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"]).select("event_id", "batch")


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P')::INT, CASE WHEN o_orderkey % 6 = 0 THEN 1073741824 ELSE o_orderkey END, o_orderkey)::INT AS place, CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'main' END AS section FROM orders
""")
def delivery_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey")).alias("number"))
    return order.delivery_order(rows, ["o_custkey"], "number", "o_orderkey", F.col("o_orderstatus") == "P").select("o_orderkey", "place", "section")
