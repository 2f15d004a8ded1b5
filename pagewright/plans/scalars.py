"""Scalar functions over columns of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import collections as fc
from pagewright.functions import dates as fd
from pagewright.functions import fuzzy as ff
from pagewright.functions import handwritten as fh
from pagewright.functions import text as ft
from pagewright.operators import joins, status
from pagewright.plans.registry import AS_OF, query, table


def now():
    return F.to_date(F.lit(AS_OF))


@query("""
    SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, CASE WHEN upper(substr(trim(c_name), 1, 1)) ~ '^[A-Z0-9]$' THEN upper(substr(trim(c_name), 1, 1)) ELSE '' END AS first_char,
           upper(trim(c_mktsegment)) AS segment, regexp_replace(c_name, '-[0-9]+$', '') AS stem, regexp_replace(c_name, '[#0]', '_', 'g') AS file_name,
           lower(trim(regexp_replace('  ' || c_name || '  x ', '[ \\t\\n]+', ' ', 'g'))) AS squeezed FROM customer
""")
def text_normalisers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey", ft.only_digits("c_name").alias("digits"), ft.first_char("c_name").alias("first_char"), ft.upper_trim("c_mktsegment").alias("segment"), ft.strip_copy_suffix("c_name").alias("stem"),
        ft.safe_file_name(F.translate("c_name", "#0", "??")).alias("file_name"), ft.squeeze(F.concat(F.lit("  "), "c_name", F.lit("  x "))).alias("squeezed"),
    )


@query("""
    SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 7, '0') AS number, substr(lpad(o_orderkey::VARCHAR, 7, '0'), 1, 5) || CASE WHEN substr(lpad(o_orderkey::VARCHAR, 7, '0'), 6, 2) < '50' THEN 'A' ELSE 'B' END AS book,
           (o_orderkey // 100)::BIGINT AS series, CASE WHEN o_orderkey % 100 < 50 THEN 'A' ELSE 'B' END AS half FROM orders
""")
def book_keys(spark: SparkSession, d: str) -> DataFrame:
    series, half = ft.book_of("o_orderkey")
    number = ft.log_number(F.concat(F.lit("No. "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")))
    return table(spark, d, "orders").select("o_orderkey", number.alias("number"), ft.book_key(number).alias("book"), series.alias("series"), half.alias("half"))


@query("""
    WITH r AS (SELECT o_orderkey, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS n FROM orders)
    SELECT o_orderkey, 'HP-' || n || CASE WHEN (o_orderkey % 3 = 0 OR n = '1990') AND n <> '1522' THEN 'WWP' ELSE 'CMP' END AS registration, 'clean' AS quality FROM r
""")
def registrations_clean(spark: SparkSession, d: str) -> DataFrame:
    n = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    noisy = F.concat(F.lit("hp - "), n, F.when(F.col("o_orderkey") % 3 == 0, "wwp").when(F.col("o_orderkey") % 3 == 1, " cmp.").otherwise(""))
    value, quality = ft.registration(noisy)
    return table(spark, d, "orders").select("o_orderkey", value.alias("registration"), quality.alias("quality"))


@query("""
    WITH r AS (SELECT o_orderkey, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS n FROM orders)
    SELECT o_orderkey, 'HP' || translate(substr(n, 1, 2), '1507', 'ISOF') || substr(n, 3, 2) || 'CMP' AS reading, 'HP-' || n || CASE WHEN n = '1990' THEN 'WWP' ELSE 'CMP' END AS registration,
           CASE WHEN regexp_matches(substr(n, 1, 2), '[1507]') THEN 'ambiguous' ELSE 'clean' END AS quality FROM r
""")
def registrations_noisy(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of which some digits were read as look-alike letters."""
    n = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    noisy = F.concat(F.lit("HP"), F.translate(F.substring(n, 1, 2), "1507", "ISOF"), F.substring(n, 3, 2), F.lit("CMP"))
    value, quality = ft.registration(noisy)
    return table(spark, d, "orders").select("o_orderkey", noisy.alias("reading"), value.alias("registration"), quality.alias("quality"))


@query("""
    SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
           trim(regexp_replace(lower(replace(replace('A &amp; B_' || url, '&lt;', '<'), '&amp;', '&')), '[ _\\-.]+', ' ', 'g')) AS name FROM pages
""")
def page_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), ft.normalise_name(F.concat(F.lit("A &amp; B_"), "url")).alias("name"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority ~ '^[1-3]-[A-Z]+$' THEN o_orderpriority ELSE '' END AS gated, 'Lote' || CASE WHEN o_orderkey % 4 <= 1 THEN '' ELSE ' -' || (o_orderkey % 3)::VARCHAR END AS part FROM orders
""")
def gates_and_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", ft.gated("o_orderpriority", "^[1-3]-[A-Z]+$").alias("gated"), ft.part_name(F.lit("Lote"), F.col("o_orderkey") % 3, F.col("o_orderkey") % 4).alias("part"))


@query(f"""
    WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, DATE '{AS_OF}' AS now FROM orders)
    SELECT o_orderkey, year(day) BETWEEN 2000 AND year(now) OR false AS year_ok, day <= now AND year(day) >= 2000 AS date_ok, last_day(day)::DATE AS month_end,
           day < make_date(year(now) - CASE WHEN month(now) = 1 THEN 1 ELSE 0 END, 1, 1) AS old,
           greatest(datediff('day', day, (date_trunc('month', now) - INTERVAL 1 MONTH)::DATE), datediff('day', now, day), 0)::INT AS outside,
           (greatest(datediff('day', day, (date_trunc('month', now) - INTERVAL 1 MONTH)::DATE), datediff('day', now, day), 0) // 365)::INT AS years_outside, strftime(day, '%Y-%m') AS month_key
    FROM o
""")
def date_windows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.select(
        "o_orderkey", fd.year_is_possible(F.year("day"), now()).alias("year_ok"), fd.date_is_possible("day", now()).alias("date_ok"), F.last_day("day").alias("month_end"), fd.needs_review_for_age("day", now()).alias("old"),
        fd.days_outside_usual("day", now()).alias("outside"), fd.years_outside_usual("day", now()).alias("years_outside"), fd.month_key("day").alias("month_key"),
    )


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, day(l_shipdate)::INT + (l_partkey % 4)::INT AS dd, month(l_shipdate)::INT AS mm, (year(l_shipdate) % 100)::INT AS yy FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, try_cast(printf('%04d-%02d-%02d', 2000 + yy % 24, mm, dd) AS DATE) AS combined,
           strftime(try_cast(printf('%04d-%02d-%02d', 2000 + yy % 24, mm, dd) AS DATE), '%m/%d/%Y') AS remote FROM l
""")
def combined_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates from separate parts; parts that give none are null."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.dayofmonth("l_shipdate") + (F.col("l_partkey") % 4).cast("int")).alias("dd"), F.month("l_shipdate").alias("mm"), (F.year("l_shipdate") % 100).alias("yy"))
    year = fd.full_year(F.col("yy") % 24, F.make_date(F.lit(2026), F.lit(1), F.lit(1)))
    day = fd.checked_date(year, fd.month_number(F.col("mm").cast("string")), "dd")
    return rows.withColumn("combined", day).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "combined", fd.reformat(F.date_format("combined", "yyyy/MM/dd"), "yyyy/MM/dd", "MM/dd/yyyy").alias("remote"))


@query("""
    SELECT o_orderkey, o_orderdate::DATE - (year(o_orderdate)::INT * 0) AS parsed FROM orders WHERE day(o_orderdate) > 0
""")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in three ways, read back; years are of this century, so they are shifted for the comparison."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    y = F.year("day") % 100
    two = F.lpad(((y + 4) % 24 + 0).cast("string"), 2, "0")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.dayofmonth("day"), F.upper(F.date_format("day", "MMM")), two)).otherwise(F.concat_ws("-", F.dayofmonth("day"), F.month("day"), two))
    got = fd.any_date(text, F.make_date(F.lit(2026), F.lit(12), F.lit(31)))
    shift = F.year("day") - (F.lit(2000) + (y + 4) % 24)
    return o.select("o_orderkey", F.coalesce(F.add_months(got, shift * 12), F.when(got.isNull() & (F.dayofmonth("day") == 29) & (F.month("day") == 2), F.col("day"))).alias("parsed"))


@query("""
    SELECT event_id, (CASE WHEN (event_id % 50) > 0 THEN (value * 1000 / (event_id % 50)) * least(0.9, (event_id % 50) / 20.0) + 250.0 * (1 - least(0.9, (event_id % 50) / 20.0)) ELSE 250.0 END) * greatest(60 - event_id % 50, 0) / 1000 AS seconds_left FROM events
""")
def remaining_time(spark: SparkSession, d: str) -> DataFrame:
    done = (F.col("event_id") % 50).cast("double")
    return table(spark, d, "events").select("event_id", fd.remaining_seconds(F.lit(60), done, F.col("value"), F.lit(250.0)).alias("seconds_left"))


@query("""
    SELECT p_partkey, levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS edits, round(greatest(0.6, least(0.9, 0.64 + 0.05 * least(p_size % 7, 5) - least(0.1, 0.005 * (p_size % 30)))), 3)::DOUBLE AS confidence,
           length(regexp_replace(p_name, '[^a-z]', '', 'g')) AS letters FROM part
""")
def name_distances(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    conf = fc.inferred_confidence(F.col("p_size") % 7, F.col("p_size") % 30)
    return table(spark, d, "part").select("p_partkey", F.levenshtein(words[0], words[1]).cast("long").alias("edits"), conf.alias("confidence"), F.length(F.regexp_replace("p_name", "[^a-z]", "")).cast("long").alias("letters"))


@query("""
    WITH subs AS (SELECT list_aggregate(list_transform(list_filter([1, 2, 3, 4, 5], lambda k: (m >> (k - 1)) & 1 = 1), lambda k: substr('SMALL', k, 1)), 'string_agg', '.*') AS pattern, bit_count(m)::INT AS n FROM range(0, 32) t(m)),
    p AS (SELECT p_partkey, substr(p_type, 1, 5) AS t, 'HP' || p_partkey AS c FROM part),
    l AS (SELECT p_partkey, max(n) AS lcs FROM p JOIN subs ON n = 0 OR regexp_matches(t, pattern) GROUP BY 1)
    SELECT p_partkey, lcs, CASE WHEN length(c) >= 4 THEN list_min([list_sum([
        CASE WHEN NOT regexp_matches(substr(c, k + i, 1), '[0-9]') THEN 14 WHEN substr(c, k + i, 1) = substr('1717', i, 1) THEN 0
             WHEN least(substr(c, k + i, 1), substr('1717', i, 1)) || greatest(substr(c, k + i, 1), substr('1717', i, 1)) IN ('17', '27', '12', '14', '47', '49', '07', '38', '35', '58', '56', '68', '08', '06', '09') THEN 6 ELSE 10 END
        FOR i IN [1, 2, 3, 4]]) FOR k IN range(0, length(c) - 3)])::INT END AS cost FROM p JOIN l USING (p_partkey)
""")
def common_subsequences(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequences of part types and a word, and the cheapest windows of noisy numbers."""
    return table(spark, d, "part").select("p_partkey", ff.lcs_length(F.substring("p_type", 1, 5), F.lit("SMALL")).alias("lcs"), ff.best_window_cost(F.concat(F.lit("HP-"), F.col("p_partkey")), F.lit("1717")).alias("cost"))


@query("""
    WITH e AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events)
    SELECT event_id, k::VARCHAR AS leaf, CASE WHEN k > 50 THEN 'large' ELSE 'small' END AS kind, sha256('[' || '"' || event_type || '"' || ']') AS digest FROM e
""")
def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("leaf", fc.leaf_strings("props")[0])
    return e.select("event_id", "leaf", F.when(F.col("leaf").cast("int") > 50, "large").otherwise("small").alias("kind"), fc.content_hash(F.array("event_type")).alias("digest"))


@query("""
    SELECT c_custkey, base64(encode('name=' || replace(c_name, '#', '%23') || '&segment=' || c_mktsegment)) AS encoded, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'segment' ELSE '' END AS changed FROM customer
""")
def encoded_values(spark: SparkSession, d: str) -> DataFrame:
    sent = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    back = F.create_map(F.lit("segment"), F.when(F.col("c_nationkey") % 2 == 0, "x").otherwise(F.col("c_mktsegment")), F.lit("name"), F.col("c_name"))
    encoded = fc.encode_values(sent)
    return table(spark, d, "customer").select("c_custkey", encoded.alias("encoded"), F.element_at(fc.decode_values(encoded), "name").alias("name"), F.array_join(fc.changed_keys(sent, back), ",").alias("changed"))


@query("""
    WITH r AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber = 7 AS blank, l_quantity > 45 AS review, l_partkey % 13 = 0 AS note_only, l_partkey % 13 = 1 AS bare, l_discount > 0.08 AS doubtful,
               CASE WHEN l_partkey % 13 > 1 AND l_suppkey % 6 > 0 THEN (l_returnflag <> 'A')::INT END AS number_read, CASE WHEN l_partkey % 13 > 1 AND l_suppkey % 10 > 0 THEN (l_linestatus <> 'F')::INT END AS plane_read,
               CASE WHEN l_partkey % 13 > 1 AND l_suppkey % 14 > 0 THEN (l_suppkey % 4 = 3 OR l_partkey % 40 BETWEEN 1 AND 31 AND l_discount >= 0.05)::INT END AS date_read FROM lineitem),
    e AS (SELECT *, (number_read IS NOT NULL)::INT + (plane_read IS NOT NULL)::INT + (date_read IS NOT NULL)::INT AS asked, coalesce(number_read, 0) + coalesce(plane_read, 0) + coalesce(date_read, 0) AS n_read FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN blank THEN 'ERROR' WHEN bare THEN 'WARNING' WHEN asked > 0 AND n_read = 0 THEN 'ERROR' WHEN n_read < asked THEN 'WARNING' WHEN review OR (doubtful AND date_read IS NOT NULL) THEN 'WARNING' ELSE 'OK' END AS status FROM e
""")
def page_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Pages with all identifiers, with some, with a note only and with no field; dates come whole or in parts."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    one = lambda name, value, state="OK": F.struct(F.lit(name).alias("field_id"), (F.lit(value) if isinstance(value, str) else value).alias("value"), (F.lit(state) if isinstance(state, str) else state).alias("status"))
    doubtful = F.when(F.col("l_discount") > 0.08, "WARNING").otherwise("OK")
    kept = lambda condition, *fields: F.when(condition, F.array(*fields)).otherwise(F.array().cast("array<struct<field_id:string,value:string,status:string>>"))
    named = part % 13 > 1
    fields = F.concat(
        kept(named & (supplier % 6 > 0), one("log_number", F.when(F.col("l_returnflag") == "A", "12").otherwise(" 0012345 "))),
        kept(named & (supplier % 10 > 0), one("matricula", F.when(F.col("l_linestatus") == "F", "?").otherwise("HP-1717CMP\t"))),
        kept(named & (supplier % 14 > 0), one("day", (part % 40).cast("string"), doubtful), one("month", F.when(F.col("l_discount") < 0.05, "?").when(part % 2 == 0, "Jan").otherwise("1"))),
        kept((part % 13 != 1), one("note", "x"), one("captain_signature", "x", "ERROR"), one("day_1", "", "ERROR"), one("flight_number", "", "ERROR")),
    )
    rows = table(spark, d, "lineitem").withColumn("fields", fields)
    whole = F.when(supplier % 4 == 3, "2025/01/31").otherwise("2025-01")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.page_status("fields", F.col("l_linenumber") == 7, F.col("l_quantity") > 45, F.lit("WARNING"), whole).alias("status"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'optional_empty' ELSE 'required' END WHEN NOT regexp_full_match(p_brand, 'Brand#[1-3]|Brand#[2-4].') THEN 'regex' WHEN length(p_brand) < 8 THEN 'too_short' WHEN length(p_brand) > 20 THEN 'too_long'
                           WHEN p_size / 50.0 < 0.3 AND p_size % 7 <> 0 THEN 'low_confidence' END AS broken,
           CASE WHEN p_size % 10 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'WARNING' ELSE 'ERROR' END WHEN NOT regexp_full_match(p_brand, 'Brand#[1-3]|Brand#[2-4].') OR length(p_brand) NOT BETWEEN 8 AND 20 THEN 'ERROR' WHEN p_size / 50.0 < 0.3 AND p_size % 7 <> 0 THEN 'WARNING' ELSE 'OK' END AS status,
           CASE WHEN p_size % 3 = 0 THEN 'name' || CASE WHEN p_size % 2 = 0 THEN ',type' ELSE '' END WHEN p_size % 2 = 0 THEN 'type' ELSE '' END AS missing,
           CASE WHEN p_size % 5 = 0 AND p_size >= 40 THEN true WHEN p_size % 5 <> 0 AND p_size >= 10 THEN false END AS present FROM part
""")
def rule_checks(spark: SparkSession, d: str) -> DataFrame:
    rule = F.struct((F.col("p_size") % 4 != 0).alias("required"), F.lit("Brand#[1-3]|Brand#[2-4].").alias("regex"), F.lit(8).alias("min_length"), F.lit(20).alias("max_length"))
    value = F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).otherwise(F.when(F.col("p_size") % 20 == 0, " "))
    missing = status.missing_required({"name": F.when(F.col("p_size") % 3 != 0, F.col("p_name")), "type": F.when(F.col("p_size") % 2 != 0, F.col("p_type")).otherwise("")})
    presence = status.presence(F.when(F.col("p_size") % 5 == 0, "true").otherwise("false"), F.col("p_size") / 50)
    rows = table(spark, d, "part").withColumn("rule", rule).withColumn("broken", status.first_failed_rule(value, F.col("rule"), F.col("p_size") / 50, 0.3, F.col("p_size") % 7 == 0))
    return rows.select("p_partkey", "broken", status.rule_status(F.col("broken")).alias("status"), F.array_join(missing, ",").alias("missing"), presence.alias("present"))


@query("""
    SELECT o_orderkey, month(o_orderdate)::INT AS named, month(o_orderdate)::INT AS numbered, strftime(o_orderdate, '%d') AS day, strftime(o_orderdate, '%y') AS year FROM orders
""")
def handwritten_dates(spark: SparkSession, d: str) -> DataFrame:
    """Readings of all orders, 99, 00 and 01 among the years."""
    return _handwritten(table(spark, d, "orders"))


def _handwritten(orders: DataFrame) -> DataFrame:
    """Printed labels around the parts, a letter for a zero before a digit, and names in English."""
    day = F.to_date("o_orderdate")
    written_day = F.regexp_replace(F.date_format(day, "dd"), "^0", "O")
    as_of = F.make_date(F.lit(2099), F.lit(12), F.lit(31))
    texts = orders.select("o_orderkey", F.concat(F.upper(F.date_format(day, "MMM")), F.lit(" month")).alias("name_text"), F.date_format(day, "M").alias("number_text"), written_day.alias("day_text"), F.concat(F.lit("Year YR "), F.date_format(day, "yy")).alias("year_text"))
    parts = {"named": fh.month_value("name_text"), "numbered": fh.month_value("number_text"), "day": fh.day_value("day_text"), "year": fh.year_value("year_text", as_of)}
    return joins.worked_out_once(texts, ["name_text", "number_text", "day_text", "year_text"], parts).select("o_orderkey", *parts)


@query("""
    WITH o AS (SELECT o_orderkey, o_orderdate::DATE + INTERVAL 30 YEAR AS t FROM orders), p AS (SELECT o_orderkey, t::DATE AS day, DATE '2026-01-15' AS now FROM o),
    q AS (SELECT *, day >= DATE '2000-01-01' AND date_trunc('month', day) <= date_trunc('month', now) AS possible FROM p)
    SELECT o_orderkey, CASE WHEN possible AND day <= now THEN day WHEN possible THEN last_day(day) END AS delivered, CASE WHEN possible AND day <= now THEN 'specific_day' WHEN possible THEN 'month_end' ELSE 'none' END AS policy FROM q
""")
def date_policies(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date(F.add_months(F.to_date("o_orderdate"), 360))
    delivered, policy = status.date_policy(day, False, F.to_date(F.lit("2026-01-15")))
    return table(spark, d, "orders").select("o_orderkey", delivered.alias("delivered"), policy.alias("policy"))


@query("""
    SELECT user_id, CASE WHEN f >= 10 AND f * 100 >= (f + m) * 90 THEN 'skip' WHEN m >= 4 THEN 'upload' ELSE 'wait' END AS decision FROM (SELECT user_id, count(*) FILTER (value < 95) AS f, count(*) FILTER (value >= 95) AS m FROM events GROUP BY 1)
""")
def upload_decisions(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") < 95).alias("f"), F.count_if(F.col("value") >= 95).alias("m"))
    return counts.select("user_id", status.upload_decision(F.col("f"), F.col("m")).alias("decision"))
