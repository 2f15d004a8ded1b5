"""Ledgers, arbitration, tilings, bands, thresholds and exact batches, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import nested, slots
from pagewright.operators import arbitration, evaluate, fullbatches, groups, jobs, joins, order, records, tiling
from pagewright.plans.grouped import BOOK_SQL, with_book
from pagewright.plans.ordered import BOOK
from pagewright.plans.registry import query, table
from pagewright.session import shared_folder, stored
from pagewright.sources import csv_runs, guarded, manifests
from pagewright.streaming import ledger


@query("""
    WITH RECURSIVE e AS (
        SELECT user_id, event_type, event_id, ts::TIMESTAMP AS ts, CASE WHEN value < 3 THEN 'rejected' WHEN value > 8 THEN 'unknown' ELSE 'ok' END AS ended, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    walk AS (
        SELECT DISTINCT user_id, event_type, 0::BIGINT AS n, NULL::TIMESTAMP AS lease, NULL::BIGINT AS sender, NULL::TIMESTAMP AS sent_at, 0::BIGINT AS rejected, 0::BIGINT AS held, 0::BIGINT AS refused, 0::BIGINT AS expired FROM e
        UNION ALL
        SELECT user_id, event_type, n, CASE WHEN free AND ended = 'unknown' THEN ts + INTERVAL 6 HOUR WHEN ran_out THEN NULL ELSE lease END, CASE WHEN free AND ended = 'ok' THEN event_id ELSE sender END, CASE WHEN free AND ended = 'ok' THEN ts ELSE sent_at END,
               rejected + (free AND ended = 'rejected')::INT, held + (free AND ended = 'unknown')::INT, refused + (NOT free)::INT, expired + ran_out::INT
        FROM (SELECT w.user_id, w.event_type, e.n, e.event_id, e.ts, e.ended, w.lease, w.sender, w.sent_at, w.rejected, w.held, w.refused, w.expired, coalesce(w.lease <= e.ts, false) AS ran_out, w.sender IS NULL AND (w.lease IS NULL OR w.lease <= e.ts) AS free
              FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type IS NOT DISTINCT FROM w.event_type AND e.n = w.n + 1))
    SELECT user_id, event_type, sender, sent_at, (sender IS NOT NULL)::BIGINT AS sent, rejected, held, refused, expired + (lease IS NOT NULL)::BIGINT AS expired
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC) AS last FROM walk) WHERE last = 1
""")
def send_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of each user and kind that arrive as files, every one twice and in no order: one send at most, reserved before it, by a stream."""
    end = F.when(F.col("value") < 3, "rejected").when(F.col("value") > 8, "unknown").otherwise("ok")
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), end.alias("ended"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    days = (last - first).days + 1 if first else 1
    source, archive, out, checkpoint = (shared_folder(spark, f"sends-{k}") for k in ("in", "archive", "journal", "checkpoint"))
    for k in range(2):
        rows.repartition(8, F.xxhash64("event_id", F.lit(k))).write.mode("append").parquet(source)
    arriving = ledger.archiving(spark, source, archive, "user_id long, event_type string, event_id long, ts timestamp, ended string", per_batch=6)
    stream = ledger.journal(arriving, ["user_id", "event_type"], "ts", "event_id", "ended", late=f"{days} days", lease_seconds=6 * 3600)
    ledger.run_to_end(stream, out, checkpoint)
    # a row without an attempt, after all leases have ended, moves the watermark past all attempts
    closing = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.make_dt_interval(F.lit(days + 2))).alias("ts"), F.lit(None).cast("string").alias("ended"))
    closing.write.mode("append").parquet(source)
    return ledger.ledger(ledger.run_to_end(stream, out, checkpoint), ["user_id", "event_type"])


@query("""
    WITH RECURSIVE docs AS (
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN m ELSE '1' END AS wanted,
               '{"k":' || k || ',"rows":[{"id":' || m || ',"more":{"n":' || k || ',"list":[1,[' || k || ',"' || m || '"],{"deep":{"y":" ' || k || ' "}}]}},{"id":' || k || '},{"other":[[' || k || ']]},{"a":{"b":{"c":{"d":{"e":{"f":{"g":' || m || '}}}}}}}],"flag":true,"none":null}' AS doc
        FROM (SELECT event_id, json_extract_string(props, '$.k') AS k, (event_id % 7)::VARCHAR AS m FROM events)),
    nodes AS (SELECT event_id, wanted, t.id, t.parent, t.type, t.fullkey, trim(json_extract_string(t.atom, '$')) AS said FROM docs, json_tree(doc) t),
    deep AS (SELECT event_id, id, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.event_id, n.id, p.depth + 1 FROM deep p JOIN nodes n ON n.event_id = p.event_id AND n.parent = p.id),
    levels AS (SELECT n.*, d.depth FROM nodes n JOIN deep d USING (event_id, id)),
    climb AS (
        SELECT event_id, id AS at, parent, type, depth AS leaf, depth, fullkey FROM levels WHERE said = wanted AND type NOT IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL')
        UNION ALL SELECT c.event_id, n.id, n.parent, n.type, c.leaf, n.depth, n.fullkey FROM climb c JOIN levels n ON n.event_id = c.event_id AND n.id = c.parent WHERE c.type <> 'OBJECT' OR c.depth > 6),
    held AS (SELECT DISTINCT event_id, fullkey AS place FROM climb WHERE type = 'OBJECT' AND depth <= 6 AND leaf - depth <= 6)
    SELECT event_id, place FROM held h WHERE NOT EXISTS (SELECT 1 FROM held i WHERE i.event_id = h.event_id AND (starts_with(i.place, h.place || '.') OR starts_with(i.place, h.place || '[')))
""")
def innermost_objects(spark: SparkSession, d: str) -> DataFrame:
    """The smallest objects of nested documents that hold a number."""
    k, m = F.get_json_object("props", "$.k"), (F.col("event_id") % 7).cast("string")
    s = F.lit
    doc = F.concat(s('{"k":'), k, s(',"rows":[{"id":'), m, s(',"more":{"n":'), k, s(',"list":[1,['), k, s(',"'), m, s('"],{"deep":{"y":" '), k, s(' "}}]}},{"id":'), k, s('},{"other":[['), k, s(']]},{"a":{"b":{"c":{"d":{"e":{"f":{"g":'), m, s('}}}}}}}],"flag":true,"none":null}'))
    wanted = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 3 == 1, m).otherwise("1")
    return nested.innermost_objects(table(spark, d, "events").select("event_id", doc.alias("doc"), wanted.alias("wanted")), "event_id", "doc", "wanted")


@query("""
    WITH p AS (
        SELECT o_orderkey AS page, o_orderkey // 1000 AS batch, CASE WHEN o_orderkey % 29 = 3 THEN NULL WHEN o_orderkey % 31 = 7 THEN 'P' || (o_custkey % 5) ELSE 'P' || (o_orderkey // 50 % 5) END AS plane, o_orderkey % 11 = 5 AS open,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 11 = 5 AND o_custkey % 2 = 0 THEN o_orderkey + 50 * (o_custkey % 3) + 100000 * (o_custkey % 4 // 2) ELSE o_orderkey END AS own,
               CASE WHEN o_custkey % 2 = 0 THEN o_orderkey + 100000 * (o_custkey % 8 // 6) ELSE o_orderkey + 150 * (o_custkey % 5) END AS other, o_orderkey % 3 = 0 AS valid FROM orders),
    known AS (
        SELECT batch, own // 50 AS book, plane FROM p WHERE NOT open AND own IS NOT NULL AND plane IS NOT NULL
        UNION SELECT batch, other // 50, min(plane) FROM p WHERE NOT open AND valid AND other IS NOT NULL AND plane IS NOT NULL GROUP BY batch, other // 50 HAVING count(DISTINCT plane) = 1),
    judged AS (
        SELECT page, plane, own, other,
               coalesce((SELECT list_sort(list(DISTINCT k.plane)) FROM known k WHERE k.batch = p.batch AND k.book = p.own // 50) = [plane], false) AND own NOT IN (SELECT q.own FROM p q WHERE q.batch = p.batch AND NOT q.open AND q.own IS NOT NULL) AS own_good,
               coalesce((SELECT list_sort(list(DISTINCT k.plane)) FROM known k WHERE k.batch = p.batch AND k.book = p.other // 50) = [plane], false) AND other NOT IN (SELECT q.own FROM p q WHERE q.batch = p.batch AND NOT q.open AND q.own IS NOT NULL) AS other_good
        FROM p WHERE open)
    SELECT page, CASE WHEN plane IS NULL OR own IS NULL OR other IS NULL OR own_good = other_good THEN NULL WHEN own_good THEN 'own' ELSE 'other' END AS verdict,
           CASE WHEN plane IS NULL THEN 'no plane' WHEN own IS NULL OR other IS NULL THEN 'no number' WHEN own_good AND other_good THEN 'both' WHEN own_good OR other_good THEN 'book' ELSE 'neither' END AS why FROM judged
""")
def number_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two numbers: the one whose book the rest of the batch knows as the page's plane's."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    by_two = c % 2 == 0
    div = lambda a, b: F.floor(a / b).cast("long")
    plane = F.when(k % 29 == 3, None).when(k % 31 == 7, F.concat(F.lit("P"), (c % 5).cast("string"))).otherwise(F.concat(F.lit("P"), (div(k, 50) % 5).cast("string")))
    own = F.when(k % 17 == 0, None).when((k % 11 == 5) & by_two, k + 50 * (c % 3) + 100000 * div(c % 4, 2)).otherwise(k)
    other = F.when(by_two, k + 100000 * div(c % 8, 6)).otherwise(k + 150 * (c % 5))
    pages = table(spark, d, "orders").select(k.alias("page"), div(k, 1000).alias("batch"), plane.alias("plane"), own.alias("own"), other.alias("other"), (k % 11 == 5).alias("open"), (k % 3 == 0).alias("valid"))
    mine = pages.select("batch", "page", "plane", F.col("own").alias("number"))
    theirs = pages.where("valid").select("batch", "page", "plane", F.col("other").alias("number"))
    return arbitration.arbitrated(pages.where("open"), mine, theirs, "batch", "page", "plane", "own", "other", lambda n: div(n, 50)).select("page", "verdict", "why")


@query("""
    WITH RECURSIVE s AS (SELECT o_custkey AS batch, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, 'T' || (o_orderkey // 4 % 5) AS token FROM orders),
    c AS (SELECT *, max(CASE WHEN o_orderkey % 3 = 0 OR place = 0 THEN o_orderkey END) OVER (PARTITION BY batch ORDER BY place) AS manifest FROM s),
    m AS (SELECT batch, manifest, list(CASE WHEN o_orderkey % 41 = 3 THEN 'X' ELSE token END ORDER BY place) AS tokens FROM c GROUP BY ALL),
    q AS (SELECT batch, list(token ORDER BY place) AS tokens FROM s GROUP BY batch),
    fits AS (SELECT q.batch, spot AS start, m.manifest, len(m.tokens) AS length FROM q JOIN m USING (batch), LATERAL (SELECT unnest(range(0, len(q.tokens) - len(m.tokens) + 1)) AS spot) WHERE q.tokens[spot + 1:spot + len(m.tokens)] = m.tokens),
    walk AS (
        SELECT batch, 0::BIGINT AS spot, []::BIGINT[] AS used FROM q
        UNION ALL SELECT batch, any_value(start + length)::BIGINT, list_append(any_value(used), any_value(manifest)) FROM (SELECT w.batch, w.used, f.* EXCLUDE (batch) FROM walk w JOIN fits f ON f.batch = w.batch AND f.start = w.spot AND NOT list_contains(w.used, f.manifest)) GROUP BY batch HAVING count(*) = 1),
    done AS (SELECT w.batch, w.used FROM walk w JOIN q USING (batch) WHERE w.spot = len(q.tokens) AND len(w.used) >= 2)
    SELECT batch, f.start, f.length::BIGINT AS length, f.manifest FROM (SELECT batch, unnest(used) AS manifest, used FROM done) u JOIN fits f USING (batch, manifest)
    WHERE f.start = coalesce((SELECT sum(g.length) FROM (SELECT DISTINCT manifest, length FROM fits h WHERE h.batch = u.batch) g WHERE list_position(u.used, g.manifest) < list_position(u.used, u.manifest)), 0)
""")
def manifest_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as sequences, made up of whole manifests of several lengths, one fitting at each step."""
    from pyspark.sql import Window

    k, own = F.col("o_orderkey"), Window.partitionBy("batch").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), k, F.concat(F.lit("T"), (F.floor(k / 4) % 5).cast("string")).alias("token")).withColumn("place", F.row_number().over(own) - 1)
    cut = rows.withColumn("manifest", F.max(F.when((k % 3 == 0) | (F.col("place") == 0), k)).over(own))
    inside = F.row_number().over(Window.partitionBy("batch", "manifest").orderBy("place")) - 1
    manifests = cut.select("batch", "manifest", inside.alias("place"), F.when(k % 41 == 3, "X").otherwise(F.col("token")).alias("token"))
    return tiling.tiled(rows.select("batch", "place", "token"), manifests, "batch", "place", "token", "manifest")


@query("""
    WITH r AS (SELECT l_suppkey, (l_partkey * 7 % 61 + CASE WHEN l_returnflag = 'R' THEN 30 + l_suppkey % 40 ELSE 0 END)::INT AS score, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS label FROM lineitem WHERE l_quantity IS NOT NULL),
    x AS (SELECT l_suppkey, list_sort(list(score) FILTER (label)) AS t, list_reverse(list_sort(list(score) FILTER (NOT label))) AS f FROM r WHERE label IS NOT NULL GROUP BY 1),
    c AS (SELECT l_suppkey, len(t) AS nt, len(f) AS nf, dt, df, f[df + 1] AS low, t[dt + 1] AS high FROM x, range(0, 3) a(dt), range(0, 3) b(df)),
    ok AS (SELECT * FROM c WHERE nt - dt >= 3 AND nf - df >= 3 AND high > low),
    won AS (SELECT l_suppkey, low, high FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (high - low >= 3) DESC, CASE WHEN high - low >= 3 THEN 0 ELSE low - high END, dt + df, dt) AS rn FROM ok) WHERE rn = 1)
    SELECT x.l_suppkey, low, high, CASE WHEN coalesce(len(t), 0) < 3 OR coalesce(len(f), 0) < 3 THEN 'few' WHEN low IS NULL THEN 'overlap' WHEN high - low >= 3 THEN 'wide' ELSE 'narrow' END AS why FROM x LEFT JOIN won USING (l_suppkey)
""")
def confident_bands(spark: SparkSession, d: str) -> DataFrame:
    """The band between returned and accepted lines' scores, a supplier each."""
    flag = F.col("l_returnflag")
    score = (F.col("l_partkey") * 7 % 61 + F.when(flag == "R", 30 + F.col("l_suppkey") % 40).otherwise(0)).cast("int")
    rows = table(spark, d, "lineitem").select("l_suppkey", score.alias("score"), F.when(flag == "R", True).when(flag == "A", False).alias("label"))
    return evaluate.confident_bands(rows, "l_suppkey", "score", "label", F.lit(3))


@query("""
    WITH h AS (SELECT l_linenumber, (l_partkey % 300 + CASE WHEN l_returnflag = 'R' THEN 120 ELSE 0 END)::DOUBLE AS score, count(*) FILTER (l_returnflag <> 'R') AS neg, count(*) FILTER (l_returnflag = 'R') AS pos FROM lineitem GROUP BY ALL),
    c AS (SELECT *, sum(neg) OVER w AS neg_to, sum(pos) OVER w AS pos_to, sum(neg) OVER (PARTITION BY l_linenumber) AS all_neg, sum(neg + pos) OVER (PARTITION BY l_linenumber) AS total FROM h WINDOW w AS (PARTITION BY l_linenumber ORDER BY score)),
    g AS (
        SELECT a.l_linenumber, a.score AS absent, p.score AS present, p.all_neg - p.neg_to + p.neg AS false_present, CASE WHEN a.score < p.score THEN a.pos_to ELSE a.pos_to - a.pos END AS false_absent,
               p.neg_to + p.pos_to - p.neg - p.pos - CASE WHEN a.score < p.score THEN a.neg_to + a.pos_to ELSE a.neg_to + a.pos_to - a.neg - a.pos END AS unsure, p.total
        FROM c a JOIN c p ON a.l_linenumber = p.l_linenumber AND a.score <= p.score)
    SELECT l_linenumber, absent, present, false_present::BIGINT AS false_present, false_absent::BIGINT AS false_absent, unsure::BIGINT AS unsure, total::BIGINT AS n_rows, (false_present * 5 + false_absent * 4 + unsure * 1) / total AS cost
    FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY false_present * 5 + false_absent * 4 + unsure, present, absent) AS rn FROM g WHERE (total - unsure) * 5 >= total * 4) WHERE rn = 1
""")
def best_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest thresholds for returned lines that leave a fifth unsure at most, a line number each."""
    returned = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_partkey") % 300 + F.when(returned, 120).otherwise(0)).alias("score"), returned.cast("int").alias("label"))
    return evaluate.best_thresholds(rows, "l_linenumber", "score", "label", 5, 4, 1)


@query("""
    WITH RECURSIVE p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS page, l_linenumber = 1 AS head FROM lineitem),
    h AS (SELECT *, max(CASE WHEN head THEN page END) OVER (PARTITION BY l_suppkey ORDER BY page) AS header, max(page) OVER (PARTITION BY l_suppkey) AS last FROM p),
    b AS (
        SELECT l_suppkey, 0::BIGINT AS batch, page AS first, coalesce(header < page, false) AS repeated FROM h WHERE page = 1
        UNION ALL SELECT h.l_suppkey, b.batch + 1, h.page, coalesce(h.header < h.page, false) FROM b JOIN h ON h.l_suppkey = b.l_suppkey AND h.page = b.first + 20 - b.repeated::INT),
    filled AS (SELECT h.l_suppkey, h.page, b.batch, h.page - b.first + b.repeated::INT AS place FROM h ASOF JOIN b ON h.l_suppkey = b.l_suppkey AND h.page >= b.first)
    SELECT l_suppkey, page, batch, place, false AS repeated FROM filled
    UNION ALL SELECT b.l_suppkey, h.header, b.batch, 0, true FROM b JOIN h ON h.l_suppkey = b.l_suppkey AND h.page = b.first WHERE b.repeated
""")
def full_batches(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' lines in batches of exactly twenty; an order cut in two repeats its first line."""
    from pyspark.sql import Window

    own = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = table(spark, d, "lineitem").withColumn("page", F.row_number().over(own)).select("l_suppkey", "page", (F.col("l_linenumber") == 1).alias("head"))
    return fullbatches.full_batches(rows, ["l_suppkey"], "page", "head", 20)


@query("""
    WITH v AS (SELECT label, spot, floor(64 * embedding[spot]::DOUBLE)::BIGINT AS level FROM embeddings, LATERAL (SELECT unnest(range(1, (len(embedding) - vec_id % 3 + 1)::BIGINT)) AS spot) WHERE embedding IS NOT NULL)
    SELECT label, (spot - 1)::INT AS place, CASE WHEN n >= 3 THEN m END AS median FROM (SELECT label, spot, count(*) AS n, median(level)::DOUBLE AS m FROM v WHERE level IS NOT NULL GROUP BY ALL)
""")
def vector_medians(spark: SparkSession, d: str) -> DataFrame:
    """The median of each element of a label's vectors, some of them an element or two shorter."""
    levels = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")))
    rows = table(spark, d, "embeddings").select("label", F.slice(levels, F.lit(1), F.size("embedding") - (F.col("vec_id") % 3).cast("int")).alias("levels"))
    return evaluate.vector_medians(rows, "label", "levels").select("label", F.posexplode("medians").alias("place", "median"))


@query("""
    WITH stands(c, d, w) AS (VALUES ('O', 0, 0.90::DOUBLE), ('I', 1, 0.85), ('Z', 2, 0.90), ('S', 5, 0.85), ('G', 6, 0.85), ('C', 6, 0.72), ('C', 0, 0.40), ('B', 8, 0.82), ('B', 6, 0.68)),
    every AS (SELECT * FROM stands UNION ALL SELECT k::VARCHAR, k, 1.0 FROM range(10) t(k)),
    r AS (SELECT o_orderkey, strftime(o_orderdate, '%d') AS dd, (5 + o_orderkey % 5) / 10 AS c1, (o_orderkey % 7) / 10 AS c2 FROM orders),
    s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN translate(dd[1], '012', 'OIZ') ELSE dd[1] END AS x, CASE WHEN o_orderkey % 4 = 0 THEN translate(dd[2], '012568', 'CIZSGB') WHEN o_orderkey % 4 = 1 THEN '?' ELSE dd[2] END AS y, c1, c2 FROM r),
    m AS (
        SELECT s.o_orderkey, a.d * 10 + b.d AS n, (greatest(0.05, c1) * a.w) * (greatest(0.05, c2) * b.w) AS weight
        FROM s JOIN every a ON a.c = s.x JOIN (SELECT * FROM every UNION ALL SELECT '7', 9, 0.35) b ON b.c = s.y WHERE a.d * 10 + b.d BETWEEN 1 AND 31),
    best AS (SELECT o_orderkey, string_agg(lpad(n::VARCHAR, 2, '0'), ',' ORDER BY weight DESC, n) AS likely, max(weight) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY weight DESC, n) AS rn FROM m) WHERE rn <= 3 GROUP BY o_orderkey),
    d AS (SELECT o_orderkey, x ~ '^[0-9]$' AS fx, y ~ '^[0-9]$' AS fy, x, y, round((c1 + CASE WHEN c2 > 0 THEN c2 ELSE 0 END) / (1 + (c2 > 0)::INT), 3) AS mean FROM s)
    SELECT o_orderkey, CASE WHEN fx AND fy THEN x || y WHEN fy THEN y ELSE '' END AS day, CASE WHEN fy THEN mean ELSE 0 END AS confidence, coalesce(likely, '') AS likely, coalesce(round(weight, 9), 0) AS weight FROM d LEFT JOIN best USING (o_orderkey)
""")
def slot_days(spark: SparkSession, d: str) -> DataFrame:
    """Days read slot by slot, some of their digits as letters: the plain reading, and the three likeliest days."""
    dd, k = F.date_format("o_orderdate", "dd"), F.col("o_orderkey")
    x, y = F.substring(dd, 1, 1), F.substring(dd, 2, 1)
    x = F.when(k % 3 == 0, F.translate(x, "012", "OIZ")).otherwise(x)
    y = F.when(k % 4 == 0, F.translate(y, "012568", "CIZSGB")).when(k % 4 == 1, "?").otherwise(y)
    c1, c2 = (5 + k % 5) / 10, (k % 7) / 10
    read = slots.decoded("day", F.array(F.struct(x.alias("char"), c1.alias("confidence")), F.struct(y.alias("char"), c2.alias("confidence"))))
    best = slots.best_products(slots.digit_weights(x, c1, "day", 0), slots.digit_weights(y, c2, "day", 1), 1, 31, 3)
    rows = table(spark, d, "orders").select("o_orderkey", read.alias("r"), best.alias("b"))
    return rows.select("o_orderkey", F.col("r.text").alias("day"), "r.confidence", F.array_join(F.transform("b", lambda p: p["text"]), ",").alias("likely"), F.coalesce(F.round(F.get("b", F.lit(0))["weight"], 9), F.lit(0.0)).alias("weight"))


@query("""
    WITH n AS (SELECT c_nationkey AS nation, count(*) AS n, sum(c_custkey) AS keys FROM customer GROUP BY 1)
    SELECT nation, CASE WHEN nation % 3 = 0 THEN 'untouched' WHEN nation % 4 = 0 THEN 'refused' ELSE 'written' END AS change, CASE WHEN nation % 3 = 0 OR nation % 4 = 0 THEN 'none' WHEN nation % 5 = 0 THEN 'refused' ELSE 'restored' END AS undo,
           CASE WHEN nation % 4 = 0 OR (nation % 3 > 0 AND nation % 5 = 0) THEN 2 * n ELSE n END AS n_rows, (CASE WHEN nation % 4 = 0 OR (nation % 3 > 0 AND nation % 5 = 0) THEN 2 ELSE 1 END * keys)::BIGINT AS keys
    FROM n
""")
def guarded_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation: a change of two thirds of the nations, after somebody changed every fourth, is undone after somebody changed every fifth of them."""
    schema = "c_custkey long, c_mktsegment string, nation int"
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("nation"))
    path = shared_folder(spark, "guarded")
    guarded.write_partitions(rows, path, "nation")
    seen = stored(guarded.digests(guarded.read_partitions(spark, path, schema), "nation"), "seen")
    twice = rows.unionByName(rows)
    guarded.write_partitions(twice.where("nation % 4 = 0"), path, "nation")  # somebody else
    journal, backup = guarded.overwritten(spark, path, schema, "nation", rows.where("nation % 3 > 0").withColumn("c_mktsegment", F.lit("NEW")), seen)
    guarded.write_partitions(twice.where("nation % 3 > 0 AND nation % 4 > 0 AND nation % 5 = 0"), path, "nation")  # somebody else again
    undone = guarded.restored(spark, path, schema, "nation", backup)
    now = guarded.read_partitions(spark, path, schema).groupBy("nation").agg(F.count("*").alias("n_rows"), F.sum("c_custkey").alias("keys"))
    met = now.join(journal.select("nation", F.col("action").alias("change")), "nation", "left").join(undone.select("nation", F.col("action").alias("undo")), "nation", "left")
    return met.select("nation", F.coalesce("change", F.lit("untouched")).alias("change"), F.coalesce("undo", F.lit("none")).alias("undo"), "n_rows", "keys")


@query("""
    WITH r AS (
        SELECT o_orderkey AS k, 'f' || o_custkey % 5 || '.pdf' AS file, o_orderkey::INT AS page, CASE o_orderkey % 6 WHEN 0 THEN 'HP-' || lpad((o_custkey % 40 + 1700)::VARCHAR, 4, '0') || 'CMP' WHEN 1 THEN 'HP-9' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || 'WWP' WHEN 2 THEN 'HP-1711CMP' WHEN 3 THEN '' ELSE 'HP-1500CMP' END AS plane,
               CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE lpad(o_orderkey::VARCHAR, 7, '0') END AS log_number, (o_orderdate + INTERVAL 30 YEAR)::DATE AS day, o_orderkey % 4 AS kind, o_orderkey % 10 = 3 AS doubtful, o_orderkey % 5 AS said FROM orders),
    i AS (SELECT k, (SELECT max((o_orderdate + INTERVAL 30 YEAR)::DATE) FROM orders) AS last FROM r WHERE k % 3 > 0),
    d AS (SELECT r.*, kind < 2 AND (day <= DATE '2027-06-15' OR day = DATE '2027-06-30') AS own, i.last FROM r LEFT JOIN i USING (k)),
    f AS (SELECT *, CASE WHEN doubtful THEN NULL WHEN own THEN day ELSE last END AS taken, NOT doubtful AND NOT own AND last IS NOT NULL AS guessed FROM d)
    SELECT k AS seq, file, page, CASE plane WHEN 'HP-1500CMP' THEN 'HP-1501CMP' ELSE plane END AS matricula, log_number, 'CM' || k % 100 AS flight_number,
           coalesce(CASE WHEN date_trunc('month', taken) <= DATE '2027-06-01' THEN strftime(last_day(taken), '%Y/%m/%d') END, '') AS date, doubtful, CASE WHEN guessed THEN 'between' ELSE '' END AS inferred,
           CASE WHEN plane = '' THEN '' WHEN plane = 'HP-1711CMP' THEN 'NG' WHEN plane LIKE 'HP-98%' OR plane LIKE 'HP-99%' THEN 'MAX' ELSE 'NG' END AS fleet, CASE WHEN plane = 'HP-1711CMP' THEN 'own' ELSE '' END AS lessor, plane NOT IN ('', 'HP-1711CMP') AS fleet_inferred,
           k % 8 = 0 AS duplicate, said < 4 AS discrepancy, CASE said WHEN 1 THEN 'pilot_signature,technician_license' WHEN 2 THEN 'captain_signature' ELSE '' END AS fields, CASE said WHEN 0 THEN 'PILOT' WHEN 1 THEN 'PILOT' WHEN 2 THEN 'CAPTAIN' ELSE '' END AS reason
    FROM f
""")
def index_records(spark: SparkSession, d: str) -> DataFrame:
    """Report rows, all texts, as typed records: registrations, numbers, dates at their month's end, fleets, reasons."""
    from pagewright.plans.detailed import SIGNATURES

    k, c, orders = F.col("o_orderkey"), F.col("o_custkey"), table(spark, d, "orders")
    case = lambda *values: F.get(F.array(*values), (k % 6).cast("int"))
    first = F.concat(F.lit(" hp-"), F.lpad((c % 40 + 1700).cast("string"), 4, "0"), F.lit("cmp "))
    plane = case(first, F.concat(F.lit("HP-9"), F.lpad((c % 1000).cast("string"), 3, "0"), F.lit(" WWP")), F.lit("HP-1711CMP"), F.lit("HP-171?"), F.lit("HP-1500CMP"), F.lit("HP-1500CMP"))
    day = F.when(k % 4 < 2, F.date_format(F.add_months("o_orderdate", 360), "yyyy/MM/dd")).when(k % 4 == 2, "2026/02/30").otherwise("")
    said = F.get(F.array(*map(F.lit, ("Discrepancy note: pilot", "Missing firma de piloto and licencia de técnico", "missing firma de capitán", "Missing nothing", ""))), (k % 5).cast("int"))
    rows = orders.select(
        k.alias("k"), F.concat(F.lit(" f"), (c % 5).cast("string"), F.lit(".pdf")).alias("file"), F.concat(F.lit(" "), k.cast("string")).alias("page"), plane.alias("matricula"), F.when(k % 7 == 0, "12").otherwise(F.concat(F.lit("No. "), F.lpad(k.cast("string"), 7, "0"))).alias("log_number"),
        F.concat(F.lit("cm"), (k % 100).cast("string")).alias("flight_number"), day.alias("date"), F.when(k % 8 == 0, " TRUE").otherwise("no").alias("dup"), F.when(k % 5 < 4, "true").otherwise("").alias("disc"), said.alias("disc_reason"), (k % 10 == 3).alias("unsure"),
    )
    fleet = rows.where("matricula = 'HP-1711CMP'").select("matricula").distinct().select("matricula", F.lit("NG").alias("fleet"), F.lit("own").alias("lessor"))
    last = orders.agg(F.max(F.add_months("o_orderdate", 360)).alias("day"))
    inferred = rows.where("k % 3 > 0").select(F.trim("file").alias("file"), F.trim("page").cast("int").alias("page"), F.lit("between").alias("method")).join(F.broadcast(last))  # one row
    as_of = F.to_date(F.lit("2027-06-15"))
    got = records.index_records(rows, "k", fleet, inferred, as_of, "HP-[0-9]{4}(CMP|WWP)", {"HP-1500CMP": "HP-1501CMP"}, {"HP-98": "MAX", "HP-99": "MAX"}, "NG", SIGNATURES, month_end=True, doubtful="unsure")
    return got.withColumn("fields", F.array_join("fields", ","))


@query("""
    WITH t AS (SELECT p_brand AS id, bool_or(p_size = 50) AS required, min(p_size) % 9 + 5 AS low, max(p_size) % 7 + 18 AS high, bool_or(p_size = 49) AS signature FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
    f AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS value, p_size / 50 AS confidence FROM part),
    b AS (SELECT p_partkey, p_brand, CASE WHEN id IS NULL THEN 'unknown' WHEN value = '' THEN CASE WHEN required THEN 'required' ELSE 'optional_empty' END WHEN NOT regexp_full_match(value, '[a-zA-Z# 0-9_]+') THEN 'regex' WHEN length(value) < low THEN 'too_short' WHEN length(value) > high THEN 'too_long'
                                        WHEN confidence < 0.4 AND NOT signature THEN 'low_confidence' END AS broken FROM f LEFT JOIN t ON id = p_brand)
    SELECT p_partkey, p_brand AS field_id, broken, CASE WHEN broken IS NULL THEN 'OK' WHEN broken IN ('unknown', 'optional_empty', 'low_confidence') THEN 'WARNING' ELSE 'ERROR' END AS status FROM b
""")
def template_rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts as fields of a form whose template, one field a brand, is written as JSON and read again."""
    parts = table(spark, d, "part")
    size = F.col("p_size")
    rules = parts.where("p_brand <> 'Brand#11'").groupBy("p_brand").agg((F.min(size) % 9 + 5).alias("low"), (F.max(size) % 7 + 18).alias("high"), F.bool_or(size == 50).alias("required"), F.bool_or(size == 49).alias("signature"))
    part = lambda v: F.lit(v).cast("double")
    field = F.struct(F.col("p_brand").alias("id"), F.when(F.col("signature"), "signature").alias("type"), F.col("required"), part(0).alias("x"), part(0.5).alias("y"), part(1).alias("w"), part(0.1).alias("h"), F.lit("[a-zA-Z# 0-9_]+").alias("regex"), F.col("low").alias("min_length"), F.col("high").alias("max_length"))
    path = shared_folder(spark, "template")
    rules.agg(F.array_sort(F.collect_list(field)).alias("fields")).select(F.lit("parts").alias("name"), F.lit("1.0").alias("version"), "fields").coalesce(1).write.json(path)  # one field a brand
    fields = parts.select("p_partkey", F.col("p_brand").alias("field_id"), F.when(size % 10 == 0, "").otherwise(F.col("p_name")).alias("value"), (size / 50).alias("confidence"))
    return records.ruled(fields, manifests.template_fields(spark, path), 0.4, ["p_partkey"])


@query("""
    WITH j AS (SELECT o_custkey AS run, o_orderkey AS job, o_orderkey % 3 + 1 AS part, o_orderkey % 5 = 0 AS review, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 1) AS logs FROM orders WHERE o_orderkey % 11 > 0)
    SELECT run, job::VARCHAR AS job, review, (row_number() OVER (PARTITION BY run, review ORDER BY part, job::VARCHAR))::INT AS "index", count(*) OVER (PARTITION BY run, review) AS "of", (row_number() OVER (PARTITION BY run ORDER BY review, part, job::VARCHAR))::INT AS place, n::INT AS n_pages, logs::INT AS n_logs FROM j
""")
def manifest_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as job manifests, written as JSON below a root with broken ones among them, scanned again and numbered as parts."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.lit("f").alias("file"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") == 1).alias("separator")))).alias("pages"))
    k = F.col("o_orderkey")
    jobs = table(spark, d, "orders").join(lines, k == F.col("l_orderkey"), "left").select(k, F.to_json(F.struct(k.cast("string").alias("job"), F.col("o_custkey").cast("string").alias("batch"), (k % 3 + 1).alias("part"), (k % 5 == 0).alias("review"), "pages")).alias("text"))
    root = shared_folder(spark, "jobs")
    whole = F.when(k % 11 > 0, F.col("text")).when(k % 22 > 0, F.substring("text", 1, 20)).otherwise("{}")
    jobs.select(whole.alias("value")).write.text(f"{root}/a/b")
    found = manifests.manifests(spark, root, "part-*").withColumn("run", F.col("batch").cast("long"))
    return manifests.delivery_parts(found, "run")


@query("""
    WITH r AS (SELECT l_suppkey, (l_partkey * 7 % 61 + CASE WHEN l_returnflag = 'R' THEN 30 + l_suppkey % 40 ELSE 0 END)::INT AS score, CASE l_returnflag WHEN 'R' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'unclear' END AS said, CASE WHEN l_partkey % 5 > 0 THEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_partkey % 2 = 0) END AS label, l_linenumber > 2 AS may FROM lineitem),
    x AS (SELECT l_suppkey, list_sort(list(score) FILTER (said = 'present')) AS t, list_reverse(list_sort(list(score) FILTER (said = 'absent'))) AS f FROM r GROUP BY 1),
    c AS (SELECT l_suppkey, dt, df, f[df + 1] AS low, t[dt + 1] AS high FROM x, range(0, 3) a(dt), range(0, 3) b(df) WHERE len(t) - dt >= 3 AND len(f) - df >= 3 AND t[dt + 1] > f[df + 1]),
    won AS (SELECT l_suppkey, low, high FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (high - low >= 3) DESC, CASE WHEN high - low >= 3 THEN 0 ELSE low - high END, dt + df, dt) AS rn FROM c) WHERE rn = 1),
    v AS (SELECT r.*, CASE WHEN said = 'unclear' AND score >= high THEN 'present' WHEN said = 'unclear' AND score <= low AND may THEN 'absent' ELSE said END AS reviewed FROM r LEFT JOIN won USING (l_suppkey)),
    both_ AS (SELECT l_suppkey, 'plain' AS way, label, said FROM v UNION ALL SELECT l_suppkey, 'reviewed', label, reviewed FROM v)
    SELECT l_suppkey, way, count(*) AS total, count(*) FILTER (said = CASE WHEN label THEN 'present' ELSE 'absent' END) AS correct, count(*) FILTER (NOT label AND said = 'present') AS false_present, count(*) FILTER (label AND said = 'absent') AS false_absent,
           count(*) FILTER (label AND said = 'unclear') AS unsure_present, count(*) FILTER (NOT label AND said = 'unclear') AS unsure_absent FROM both_ WHERE label IS NOT NULL GROUP BY ALL
""")
def book_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Two classifiers compared, a supplier each: plain verdicts, and those with the unclear ones decided by the supplier's band."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    score = (part * 7 % 61 + F.when(flag == "R", 30 + F.col("l_suppkey") % 40).otherwise(0)).cast("int")
    label = F.when(part % 5 > 0, (flag == "R") | ((flag == "N") & (part % 2 == 0)))
    rows = table(spark, d, "lineitem").select("l_suppkey", score.alias("score"), F.when(flag == "R", "present").when(flag == "A", "absent").otherwise("unclear").alias("said"), label.alias("label"), (F.col("l_linenumber") > 2).alias("may"))
    seen = stored(evaluate.reviewed_by_band(rows, "l_suppkey", "score", "said", F.lit(3), F.col("may")), "reviews")
    ways = [evaluate.tallies(seen, ["l_suppkey"], "label", c).withColumn("way", F.lit(n)) for n, c in (("plain", "said"), ("reviewed", "reviewed"))]
    return ways[0].unionByName(ways[1])


@query("SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase' AND value > 20) ORDER BY first, user_id LIMIT 12")
def control_users(spark: SparkSession, d: str) -> DataFrame:
    """A report of the twelve users that came first of those with a large purchase."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return jobs.control_keys(rows, "user_id", (F.col("event_type") == "purchase") & (F.col("value") > 20), "event_id", 12)


@query("""
    SELECT 'lote' || l_suppkey % 7 AS batch, (l_orderkey * 10 + l_linenumber)::VARCHAR AS page, l_partkey::VARCHAR AS part, coalesce(CASE WHEN l_quantity > 10 THEN l_returnflag END, '') AS flag,
           CASE WHEN l_linenumber = 1 THEN 'separator' WHEN l_quantity < 40 THEN 'write' ELSE 'blocked' END AS action, CASE WHEN l_quantity >= 40 THEN 'too many | check' WHEN l_linenumber = 2 THEN 'second' ELSE '' END AS notes
    FROM lineitem
""")
def plan_report(spark: SparkSession, d: str) -> DataFrame:
    """The plan of several batches in one report, written as CSV and read again."""
    lines = table(spark, d, "lineitem")
    notes = F.when(F.col("l_quantity") >= 40, F.array(F.lit("too many"), F.lit("check"))).when(F.col("l_linenumber") == 2, F.array(F.lit("second")))
    plans = lines.select("*", F.concat(F.lit("lote"), (F.col("l_suppkey") % 7).cast("string")).alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page"), notes.alias("notes"))
    columns = {"part": F.col("l_partkey"), "flag": F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))}
    path = shared_folder(spark, "plan")
    csv_runs.write_run(jobs.plan_report(plans, "batch", "page", columns, F.col("l_linenumber") == 1, F.col("l_quantity") < 40, "notes"), path)
    return csv_runs.read_run(spark, path)


@query("""
    WITH p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS place, CASE WHEN l_partkey % 10 > 0 THEN l_orderkey * 10 + l_linenumber END AS number, l_quantity < 3 AS blank, trim(l_returnflag) AS flag FROM lineitem)
    SELECT l_suppkey, place::INT AS place, number, number IS NOT NULL AND count(*) OVER (PARTITION BY number) > 1 AS duplicated, blank, flag FROM p
""")
def purgeable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' reports of nested pages, flattened with what decides whether a page may go."""
    number = F.when(F.col("l_partkey") % 10 > 0, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    page = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", number.alias("number"), F.when(F.col("l_quantity") < 3, True).alias("blank"), F.concat(F.col("l_returnflag"), F.lit(" ")).alias("flag"))
    reports = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(page)).alias("pages"))  # a report, as the reader has them
    return groups.purgeable_pages(reports, "l_suppkey", "pages", "number", "blank", ["flag"])


@query(f"""
    WITH r AS (SELECT o_orderkey, o_custkey, {BOOK_SQL}, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS number, o_orderkey % 9 = 0 AS blank, CASE WHEN o_custkey % 4 > 0 THEN o_orderdate::DATE END AS day FROM orders)
    SELECT o_orderkey, (row_number() OVER w)::INT AS place, CASE WHEN day IS NOT NULL THEN count(day) OVER (w ROWS UNBOUNDED PRECEDING) END AS day_place FROM r WHERE number IS NOT NULL AND NOT blank WINDOW w AS (PARTITION BY series, half ORDER BY number, o_custkey)
""")
def written_order(spark: SparkSession, d: str) -> DataFrame:
    """The written pages of books in the order they were filled in, and their dated ones."""
    k = F.col("o_orderkey")
    rows = with_book(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    rows = rows.withColumns({"number": F.when(k % 7 > 0, k), "blank": k % 9 == 0, "day": F.when(F.col("o_custkey") % 4 > 0, F.to_date("o_orderdate"))})
    return order.written_order(rows, BOOK, "number", "o_custkey", "blank", "day").select("o_orderkey", "place", "day_place")


@query("""
    SELECT l_orderkey::VARCHAR AS number, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity::BIGINT END AS images FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 > 0)
""")
def copies_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The rows that are a wanted number, with their images where these are counted clearly."""
    images = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"))).otherwise(F.concat(F.lit("~"), F.col("l_quantity").cast("long").cast("string")))
    grid = table(spark, d, "lineitem").select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("number"), "l_linenumber", "l_partkey", images.alias("images"))
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey").cast("string")).otherwise(" ").alias("number"))
    return joins.copies_of(grid, wanted, "number", "images")


@query("""
    WITH r AS (
        SELECT o_orderkey AS k, o_custkey % 300 AS book, CASE WHEN o_orderkey % 40 = 0 THEN 2018 + o_custkey % 7 WHEN o_orderkey % 41 = 0 THEN NULL ELSE 2024 END AS year, CASE WHEN o_orderkey % 40 = 0 THEN month(o_orderdate) WHEN o_orderkey % 23 > 0 THEN month(o_orderdate) % 8 + 1 END AS month,
               o_orderkey % 120 = 0 AS other, o_orderkey % 9 > 0 AS direct, o_orderkey % 7 > 1 AS aligned FROM orders),
    v AS (SELECT year, count(*) AS votes, count(DISTINCT book) AS books FROM r WHERE direct AND year IS NOT NULL GROUP BY 1),
    run AS (SELECT year FROM (SELECT *, (sum(votes) OVER ())::BIGINT AS readings, row_number() OVER (ORDER BY votes DESC, year) AS rn, lead(votes) OVER (ORDER BY votes DESC, year) AS second FROM v) WHERE rn = 1 AND votes >= 12 AND books >= 3 AND votes * 10 >= readings * 9 AND votes > coalesce(second, 0)),
    b AS (SELECT book, year, count(*) AS n FROM r WHERE direct AND year IS NOT NULL GROUP BY ALL),
    x AS (SELECT r.*, (SELECT year FROM run) AS run, coalesce(b.n >= 2, false) AS twice, month IN (SELECT month FROM r JOIN run USING (year) WHERE month IS NOT NULL) AS fits FROM r LEFT JOIN b ON b.book = r.book AND b.year = r.year),
    m AS (
        SELECT *, CASE WHEN year IS NULL OR run IS NULL OR year = run OR twice THEN 'kept' WHEN aligned AND abs(year - run) >= 2 AND other THEN 'adopted' WHEN run IN (2024, 2025) AND coalesce(fits, false) AND (abs(year - run) >= 2 OR make_date(year::BIGINT, month::BIGINT, 1) < DATE '2025-01-01') THEN 'month_fit'
                       WHEN aligned AND abs(year - run) >= 2 AND run IN (2024, 2025) THEN 'review' ELSE 'kept' END AS method FROM x)
    SELECT k, CASE WHEN method IN ('adopted', 'month_fit') THEN run ELSE year END::INT AS adopted, method FROM m
""")
def run_year_fit(spark: SparkSession, d: str) -> DataFrame:
    """Years of a run's pages that differ from its own: adopted by an alternative or by the month, or for review."""
    k, c, month = F.col("o_orderkey"), F.col("o_custkey"), F.month("o_orderdate")
    year = F.when(k % 40 == 0, 2018 + c % 7).when(k % 41 != 0, 2024).cast("int")
    rows = table(spark, d, "orders").select(
        k.alias("k"), (c % 300).alias("book"), year.alias("year"), F.when(k % 40 == 0, month).when(k % 23 > 0, month % 8 + 1).alias("month"), F.when(k % 120 == 0, F.array(F.lit(2024))).otherwise(F.array().cast("array<int>")).alias("others"),
        (k % 9 > 0).alias("direct"), (k % 7 > 1).alias("aligned"),
    )
    run = groups.run_consensus(rows.where("direct"), "book", "year")
    return groups.fit_to_run(rows, "book", "year", "month", "others", F.col("direct"), F.col("aligned"), run, F.to_date(F.lit("2025-03-10"))).select("k", "adopted", "method")
