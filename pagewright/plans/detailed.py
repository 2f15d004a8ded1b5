"""Smaller normalisers, candidates, month evidence, JSON look-ups, batch matching and job state on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import details as fd
from pagewright.operators import jobs
from pagewright.plans.registry import query, table


@query("""
    WITH r AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_custkey FROM orders)
    SELECT k, CASE WHEN year(d) >= 2000 THEN strftime(d, '%y') END AS year_2, CASE WHEN k % 40 BETWEEN 1 AND 31 THEN lpad((k % 40)::VARCHAR, 2, '0') END AS day_2,
           CASE WHEN k % 7 = 0 THEN 'sf' ELSE year(d) || '-' || ['ENE', 'FEB', 'MAR', 'ABR', 'MAY', 'JUN', 'JUL', 'AGO', 'SEP', 'OCT', 'NOV', 'DIC'][month(d)] END AS month, (CASE WHEN k % 3 < 2 THEN d END)::TIMESTAMP AS stamp, greatest(120, k % 5 * 60) AS deadline,
           CASE WHEN k % 4 = 0 THEN '' ELSE k::VARCHAR END AS id, CASE WHEN k % 5 = 0 THEN 'HP-1717CMP' ELSE 'HP' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || 'CMP' END AS alias, 'Title ' || k AS title, CASE WHEN k % 6 = 0 THEN 'page_' || k WHEN k % 6 = 1 THEN 'HP-1' ELSE k || '_HP-1' END || '.pdf' AS file,
           CASE WHEN k % 2 = 0 THEN 'HP-1234CMP' ELSE 'sin_matricula' END AS plane FROM r
""")
def name_details(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = k.cast("string")
    stamp = F.when(k % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(k % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    alias = F.when(k % 5 == 0, " hp-9.999 ").otherwise(F.concat(F.lit("hp-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit(" cmp")))
    return table(spark, d, "orders").select(
        k.alias("k"), fd.two_digit_year(F.date_format(day, "yyyy"), F.to_date(F.lit("2099-12-31"))).alias("year_2"), fd.two_digit_day((k % 40).cast("string")).alias("day_2"), fd.month_name(F.when(k % 7 != 0, day)).alias("month"), fd.any_timestamp(stamp, ["dd/MM/yyyy", "yyyy-MM-dd"]).alias("stamp"),
        fd.deadline(k % 5).alias("deadline"), fd.usable_id(F.when(k % 4 == 0, F.when(k % 8 == 0, " None ").otherwise("0")).otherwise(text)).alias("id"), fd.aliased(alias, {"HP9999": "HP-1717CMP"}).alias("alias"), fd.title_without_batch(F.concat(F.lit("Title "), text, F.when(k % 2 == 0, "-batch2").otherwise(""))).alias("title"),
        fd.file_title(F.when(k % 6 > 1, text), F.when(k % 6 > 0, "HP-1"), "o_orderkey").alias("file"), fd.plane_key(F.when(k % 2 == 0, "HP-1234CMP").otherwise("?"), "^HP-[0-9]{4}").alias("plane"),
    )


SIGNATURES = {"firma de piloto": "pilot_signature", "firma de capitan": "captain_signature", "licencia de tecnico": "technician_license"}


@query("""
    WITH r AS (SELECT o_orderkey AS k, o_orderkey % 5 AS c FROM orders)
    SELECT k, CASE c WHEN 0 THEN 'PILOT' WHEN 1 THEN 'PILOT' WHEN 2 THEN 'CAPTAIN' WHEN 3 THEN '' ELSE 'LICENSE' END AS reason, CASE c WHEN 1 THEN 'pilot_signature,technician_license' WHEN 2 THEN 'pilot_signature,captain_signature,technician_license' WHEN 4 THEN 'technician_license' ELSE '' END AS fields,
           CASE WHEN k % 3 = 0 THEN 'there' ELSE 'new' END AS written FROM r
""")
def canonical_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Formal reasons and older sentences; what is written never overwrites what is there."""
    k = F.col("o_orderkey")
    said = F.array(*map(F.lit, ("discrepancy note: pilot", "Missing firma de piloto and licencia de técnico (maintenance)", "Missing firma de piloto, firma de capitán and licencia de tecnico", "Missing nothing", "missing licencia de técnico")))
    sentence = F.get(said, (k % 5).cast("int"))
    values, remote = F.create_map(F.lit("reason"), F.lit("new"), F.lit("other"), F.lit("x")), F.create_map(F.lit("reason"), F.when(k % 3 == 0, " there "))
    kept = fd.keep_remote(values, remote, "reason", ["other"])
    return table(spark, d, "orders").select(k.alias("k"), fd.canonical_reason(sentence, SIGNATURES).alias("reason"), F.array_join(fd.reason_fields(sentence, SIGNATURES), ",").alias("fields"), F.array_join(F.map_values(kept), ",").alias("written"))


@query("""
    WITH r AS (SELECT o_orderkey AS k, (o_orderkey % 31 + 1)::INT AS d, (o_orderkey % 13)::INT AS a, o_orderkey % 4 = 0 AS derived FROM orders),
    c AS (SELECT *, list_filter([a, (k % 33)::INT], lambda x: x BETWEEN 1 AND 31 AND NOT (x < 10 AND d >= 10)) AS o FROM r)
    SELECT k, CASE WHEN derived OR a = 0 OR a = d THEN lpad(d::VARCHAR, 2, '0') ELSE lpad(d::VARCHAR, 2, '0') || ',' || lpad(a::VARCHAR, 2, '0') END AS candidates,
           array_to_string(list_filter(list_concat(CASE WHEN len(o) = 2 AND o[1] = o[2] THEN [o[1]] ELSE o END, CASE WHEN d < 10 THEN [d + 10, d + 20, d + 30] ELSE [] END), lambda x: x <> d), ',') AS days, (0.5 + CASE WHEN d >= 10 AND k % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS strength FROM c
""")
def reading_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day, other = (k % 31 + 1).cast("int"), (k % 13).cast("string")
    found = fd.component_candidates(day.cast("string"), F.array(other), F.when(k % 4 == 0, "inferred").otherwise("direct"), fd.two_digit_day)
    days = fd.day_candidates(day, F.array(other, (k % 33).cast("string")))
    return table(spark, d, "orders").select(k.alias("k"), F.array_join(found, ",").alias("candidates"), F.array_join(F.transform(days, lambda x: x.cast("string")), ",").alias("days"), fd.day_strength(F.lit(0.5), day, k % 2 == 0).alias("strength"))


@query("""
    WITH m AS (SELECT * FROM (VALUES ('ENE', 1), ('JAN', 1), ('FEB', 2), ('MAR', 3), ('ABR', 4), ('APR', 4), ('MAY', 5), ('JUN', 6), ('JUL', 7), ('AGO', 8), ('AUG', 8), ('SEP', 9), ('OCT', 10), ('NOV', 11), ('DIC', 12), ('DEC', 12)) t(name, n)),
    r AS (SELECT o_orderkey AS k, ['J', '3', 'M', 'A', 'D'][o_orderkey % 5 + 1] AS s1, ['U', 'A', '0', 'V', 'E'][o_orderkey // 5 % 5 + 1] AS s2, ['L', 'N', 'Y', '1', ''][o_orderkey // 25 % 5 + 1] AS s3, (5 + o_orderkey % 4) / 10 AS c FROM orders),
    w AS (SELECT k, name, n, s1, s2, s3, c * CASE WHEN s1 = substr(name, 1, 1) THEN 1 WHEN substr(name, 1, 1) = 'J' AND s1 = '3' THEN 0.85 ELSE 0 END AS x1, c * CASE WHEN s2 = substr(name, 2, 1) THEN 1 WHEN (substr(name, 2, 1) = 'U' AND s2 IN ('0', 'V')) OR (substr(name, 2, 1) = 'O' AND s2 = '0') THEN 0.85 ELSE 0 END AS x2,
                 0.9 * CASE WHEN s3 = substr(name, 3, 1) THEN 1 WHEN substr(name, 3, 1) = 'L' AND s3 = '1' THEN 0.85 ELSE 0 END AS x3 FROM r, m),
    g AS (SELECT k, n, max(CASE WHEN x1 > 0 THEN greatest(0.05, x1) ELSE 0.03 END * CASE WHEN x2 > 0 THEN greatest(0.05, x2) ELSE 0.03 END * CASE WHEN x3 > 0 THEN greatest(0.05, x3) WHEN s3 <> '' THEN 0.03 ELSE 0.05 END) AS score FROM w WHERE (x1 > 0)::INT + (x2 > 0)::INT + (x3 > 0)::INT >= 2 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, n) AS rn, lead(score) OVER (PARTITION BY k ORDER BY score DESC, n) AS second FROM g)
    SELECT k, n AS best, (CASE WHEN second IS NULL OR score >= second * 1.5 THEN n END)::INT AS decided FROM o WHERE rn = 1
""")
def month_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Months ranked by three handwritten signs, and decided where the first is clear."""
    k = F.col("o_orderkey")
    sign = lambda signs, step: F.get(F.array(*map(F.lit, signs)), (F.floor(k / step) % 5).cast("int"))
    c = (5 + k % 4) / 10
    slots = fd.month_slots([F.col("s1"), F.col("s2"), F.col("s3")], [F.col("c"), F.col("c"), F.lit(0.9)])
    rows = table(spark, d, "orders").select(k.alias("k"), sign("J3MAD", 1).alias("s1"), sign("UA0VE", 5).alias("s2"), sign(["L", "N", "Y", "1", ""], 25).alias("s3"), c.alias("c")).withColumn("slots", slots)
    return rows.where(F.size("slots") > 0).select("k", F.get("slots", F.lit(0)).month.alias("best"), fd.decided_month(F.col("slots")).alias("decided"))


@query("""
    WITH e AS (SELECT event_id, (props->>'$.k')::INT AS k FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS n_rows, k > 50 AS held FROM e
""")
def json_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of JSON answers, plain or in one of several envelopes, and whether a value is among their leaves."""
    n, p = F.col("event_id") % 4, F.col("props")
    text = F.when(n == 0, F.concat(F.lit("["), p, F.lit("]"))).when(n == 1, F.concat(F.lit('{"data":['), p, F.lit(","), p, F.lit("]}"))).when(n == 2, F.concat(F.lit('{"results":['), p, F.lit("]}"))).otherwise('{"none":1}')
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", F.size(fd.unwrapped(text)).alias("size"), fd.holds_value(F.array(k), F.when(k.cast("int") > 50, k).otherwise("-1")).alias("held")).select("event_id", F.when(F.col("size") >= 0, F.col("size")).alias("n_rows"), "held")


@query("""
    WITH g AS (SELECT o_custkey, o_orderkey // 10 AS n FROM orders GROUP BY ALL), i AS (SELECT o_custkey, min(n) AS a, max(n) AS b FROM (SELECT *, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS grp FROM g) GROUP BY o_custkey, grp),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a) AS rn FROM i)
    SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) FILTER (rn <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || sum(b - a + 1) FILTER (rn > 3) || ' more' ELSE '' END AS numbers FROM p GROUP BY 1
""")
def number_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 10).alias("n")).groupBy("o_custkey").agg(F.collect_set("n").alias("n"))
    return rows.select("o_custkey", fd.number_ranges(F.col("n"), 3).alias("numbers"))


@query("""
    WITH q AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 7, '0') AS number FROM orders)
    SELECT o_orderkey, number = '0000101' AS exact, contains(number, '10') AS part FROM q WHERE number = '0000101' OR contains(number, '10')
""")
def logbook_search(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that a query of seven digits, or of a fragment, finds."""
    rows = table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 7, "0").alias("number"))
    exact, part = jobs.number_query("0000101"), jobs.number_query("bit: 10")
    return rows.select("o_orderkey", exact(F.col("number")).alias("exact"), part(F.col("number")).alias("part")).where("exact OR part")


@query("""
    WITH n AS (SELECT c_custkey AS id, c_nationkey AS pages, c_mktsegment AS wanted FROM customer WHERE c_custkey % 3 > 0),
    r AS (SELECT *, rank() OVER (PARTITION BY wanted ORDER BY abs(pages - 7)) AS rk FROM n), f AS (SELECT wanted, count(*) AS n, min(id) AS id FROM r WHERE rk = 1 GROUP BY 1)
    SELECT wanted, CASE WHEN n = 1 THEN id END AS found, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS verdict FROM f
""")
def new_batches(spark: SparkSession, d: str) -> DataFrame:
    """The one new batch of each name nearest to its expected pages, if no other is as near."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pages"), F.col("c_mktsegment").alias("wanted"))
    return jobs.new_batch(c, c.where("id % 3 = 0"), "id", "wanted", "pages", F.lit(7)).select("wanted", "found", "verdict")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN 'N' || l_suppkey ELSE 'x' || l_suppkey END AS reg FROM lineitem), f AS (SELECT 'x' || s_suppkey AS reg FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN f.reg IS NOT NULL THEN 'fleet' WHEN starts_with(l.reg, 'N') THEN 'foreign' ELSE 'unknown' END AS owner FROM l LEFT JOIN f USING (reg)
""")
def fleet_owners(spark: SparkSession, d: str) -> DataFrame:
    """Registrations looked up in the fleet, else by their prefix."""
    reg = F.concat(F.when(F.col("l_partkey") % 5 == 0, "N").otherwise("x"), F.col("l_suppkey").cast("string"))
    fleet = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("reg"), F.lit("fleet").alias("owner"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reg.alias("reg"))
    return jobs.resolved(rows, fleet, "reg", "owner", {"N": "foreign"}, "unknown").drop("reg")


@query("""
    SELECT l_returnflag AS cause, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM lineitem GROUP BY 1
""")
def cause_histogram(spark: SparkSession, d: str) -> DataFrame:
    return jobs.shares(table(spark, d, "lineitem").select(F.array("l_returnflag").alias("causes")), "causes", "cause")


@query("""
    WITH e AS (SELECT user_id, event_id, ts, event_type FROM events)
    SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'click') AS sent, arg_max(event_type, (ts, event_id)) AS last_type, max(ts)::TIMESTAMP AS last_at,
           CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'click') >= 20 THEN 'done' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'sending' WHEN arg_max(event_type, (ts, event_id)) = 'ready' THEN 'waiting' ELSE 'new' END AS state FROM e GROUP BY 1
""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Each job's events counted and its state."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    got = jobs.event_counts(e, "user_id", F.struct("ts", "event_id"), "event_type", {"sent": F.col("event_type") == "click", "errors": F.col("event_type") == "error"}, F.col("ts").cast("timestamp"))
    return got.withColumn("state", fd.job_state(F.col("last_type"), F.col("errors"), F.col("sent"), F.lit(20))).drop("errors")


@query("""
    WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS turn FROM customer)
    SELECT k, place FROM (SELECT k, row_number() OVER (ORDER BY turn NULLS FIRST, k)::INT AS place FROM c) WHERE place <= 20
""")
def least_recent(spark: SparkSession, d: str) -> DataFrame:
    """The twenty books whose turn it is: those never checked first (a report of a fixed length)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("turn"))
    return jobs.rotation(c, "turn", "k", 20).select("k", "place")


@query("""
    WITH l AS (SELECT DISTINCT l_suppkey % 20 AS num, l_returnflag AS suffix, CASE WHEN l_linenumber % 3 > 0 THEN strftime(l_shipdate, '%Y-%m') END AS month FROM lineitem)
    SELECT num, suffix, month, row_number() OVER (PARTITION BY suffix ORDER BY num, month NULLS LAST)::INT AS place FROM l
""")
def section_order(spark: SparkSession, d: str) -> DataFrame:
    """Sections by number, then by month with the unknown ones last."""
    month = F.when(F.col("l_linenumber") % 3 > 0, F.date_format("l_shipdate", "yyyy-MM"))
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("num"), F.col("l_returnflag").alias("suffix"), month.alias("month")).distinct()
    return jobs.placed(rows, ["suffix"], [F.col("num"), F.asc_nulls_last("month")])


@query("""
    SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS position FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1
""")
def last_observations(spark: SparkSession, d: str) -> DataFrame:
    """Of each number's valid pages the last one."""
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_totalprice")
    return jobs.last_of_each(rows, ["o_custkey"], "o_orderkey", "o_totalprice", "price")


@query("""
    WITH m AS (SELECT o_orderkey AS k, o_custkey % 4 AS v, o_orderstatus AS s FROM orders), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey % 4 END AS v FROM orders WHERE o_orderkey % 5 > 0)
    SELECT m.k FROM m JOIN r ON m.k = r.k AND m.v = r.v WHERE m.s = 'F'
""")
def confirmed_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """Rows confirmed earlier whose values are still the same remotely."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), (F.col("o_custkey") % 4).alias("v"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    remote = rows.where("k % 5 > 0").select("k", F.when(F.col("k") % 3 == 0, 9).otherwise(F.col("v")).alias("v"))
    return jobs.unchanged(rows, remote, "k", ["v"], "confirmed").select("k")


@query("""
    WITH r AS (SELECT l_suppkey AS report, l_orderkey AS page, l_linenumber AS line, l_partkey AS part, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem), n AS (SELECT report, count(*) AS n FROM r GROUP BY 1), b AS (SELECT report, sum(n) OVER (ORDER BY report) - n AS before FROM n)
    SELECT r.report, r.page, r.line, r.part, (before + rn)::BIGINT AS position FROM r JOIN b USING (report)
""")
def page_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each page's place among the pages of all reports."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("report"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return jobs.global_positions(rows, "report", ["page", "line", "part"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows drawn by a seed (a sampling operator)."""
    return jobs.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@query("""
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'Order 12-34' ELSE '' END = '' AND o_orderkey % 4 > 0 AS blank, o_orderstatus <> 'F' AS writable, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'a' END, CASE WHEN o_orderkey % 5 = 0 THEN 'b' END) AS unread,
           CASE o_orderkey % 4 WHEN 0 THEN '123' WHEN 1 THEN 'ABC 1' WHEN 2 THEN '0001234' ELSE 'as it is' END AS value, CASE WHEN o_orderkey % 4 < 3 THEN 'changed by ' || ['digits', 'upper', 'log_number'][o_orderkey % 4 + 1] ELSE '' END AS note, sha256('https://x' || o_orderkey) AS fingerprint FROM orders
""")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    """Blank rows, rows that may be written, unread fields, readings by their field's rule, and content names."""
    k = F.col("o_orderkey")
    part = lambda name, bad: F.struct(F.lit(name).alias("field_id"), F.when(bad, "").otherwise("x").alias("value"), F.lit("OK").alias("status"))
    fields = F.array(part("a", k % 3 == 0), part("b", k % 5 == 0))
    value, note = F.lit("as it is"), F.lit("")
    for n, (text, rule) in enumerate((("no. 1-23", "digits"), (" abc 1", "upper"), ("0001-234", "log_number"))):
        v, m = fd.postprocessed(F.lit(text), rule)
        value, note = F.when(k % 4 == n, v).otherwise(value), F.when(k % 4 == n, m).otherwise(note)
    blank = fd.is_blank_row([F.when(k % 6 == 0, "Order 12-34").otherwise(" "), F.when(k % 4 == 0, k)])
    return table(spark, d, "orders").select(
        k.alias("k"), blank.alias("blank"), fd.may_overwrite(F.when(F.col("o_orderstatus") == "F", 4).otherwise(1), 4, False).alias("writable"), F.array_join(fd.unread_fields(fields), ",").alias("unread"), value.alias("value"), note.alias("note"), fd.content_fingerprint("https://x", k.cast("string")).alias("fingerprint")
    )


@query("""
    SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'log=' || c_custkey || ',' END || 'reg=' || c_mktsegment || ',status=' || CASE WHEN c_nationkey % 4 = 0 THEN 'Discrepancy' ELSE 'Valid' END AS vals FROM customer
""")
def index_values(spark: SparkSession, d: str) -> DataFrame:
    """Records as maps of the controlled fields, whose status depends on discrepancies."""
    k = F.col("c_custkey")
    values = jobs.index_values({"log": F.when(k % 3 > 0, k), "reg": F.col("c_mktsegment"), "note": F.col("c_name")}, ("log", "reg"), F.col("c_nationkey") % 4 == 0, "Valid", "Discrepancy")
    pairs = F.transform(F.map_entries(values), lambda e: F.concat_ws("=", e.key, e.value))
    return table(spark, d, "customer").select(k.alias("k"), F.array_join(pairs, ",").alias("vals"))


@query("""
    WITH p AS (SELECT l_returnflag AS run, l_suppkey, count(*) AS pages, count(*) FILTER (l_quantity > 45) AS flagged FROM lineitem GROUP BY ALL) SELECT run, count(*) AS parts, sum(pages)::BIGINT AS pages, sum(flagged)::BIGINT AS flagged FROM p GROUP BY 1
""")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Runs' summaries summed from their parts, written as JSON and read."""
    parts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), "l_suppkey").agg(F.count("*").alias("pages"), F.count_if(F.col("l_quantity") > 45).alias("flagged"))
    return jobs.run_summary(parts, "run", ["pages", "flagged"]).select("run", F.from_json("json", "parts long, pages long, flagged long").alias("s")).select("run", "s.*")


@query("SELECT user_id, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value FROM (SELECT user_id, event_type AS v FROM events WHERE user_id % 3 > 0 UNION ALL SELECT user_id, 'same' FROM events WHERE user_id % 3 = 0) GROUP BY 1")
def unanimous_leaves(spark: SparkSession, d: str) -> DataFrame:
    """A value found in a job's answers if all of them agree."""
    values = F.array(F.when(F.col("user_id") % 3 == 0, "same").otherwise(F.col("event_type")))
    return jobs.unanimous_value(table(spark, d, "events").select("user_id", "event_type"), "user_id", values, "value")


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions without repeats, each with the first place it had."""
    return jobs.first_of_each(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("""
    SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N' AND l_linenumber > 2) AS review FROM orders
""")
def review_marks(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose final rows lack a required value."""
    final = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("a"), F.when(F.col("l_linenumber") > 2, "x").otherwise("").alias("b"))
    return jobs.marked_for_review(table(spark, d, "orders").select("o_orderkey"), final, ["o_orderkey"], ["a", "b"])


@query("""
    WITH r AS (SELECT l_suppkey, CASE WHEN o_orderkey IS NOT NULL THEN 'exact' ELSE 'missing' END AS path FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F') SELECT l_suppkey, path, count(*) AS n FROM r GROUP BY ALL
""")
def path_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each batch each way of matching found."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("exact").alias("found"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(done, "l_orderkey", "left").withColumn("path", F.coalesce("found", F.lit("missing")))
    return jobs.match_paths(rows, "path", "l_suppkey")
