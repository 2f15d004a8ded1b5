"""The queries of this subpackage's operators, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import chat, exact_dedup, license_scan, mixing, packing, prefix_trie, quality_rules, repair, simhash, topk, toxicity, url_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.archive_pages(table(spark, sf_dir, "pages"), keep_monolithic=False), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_verdicts(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), share=(3, 4), max_epochs=2, seed=7)
    return drawn.select("doc_id", *[c.alias(n) for n, c in mixing.leaf_columns().items()], "n_draws", "prefix_tokens")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    # rows that have the id -1 already are further turns of the added conversation
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, 20)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    return prefix_trie.trie(prefix_trie.rebuilt_turns(turns, F.expr("conv_id - conv_id % 100"), heads, most=5)).drop("node")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    return judged.select("doc_id", *quality_rules.MEASURE_NAMES, "base_failed", "kept")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated and given another role, by the hash of their id and turn; dropped ones are marked as gone."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("kind", F.pmod(F.crc32(named.cast("binary")), F.lit(20)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.ordered(damaged(table(spark, sf_dir, "conversations")), "gone")
    return repair.digests(rows, repair.plan_repairs(rows))


QUERIES = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filter": op9_url_filter,
    "op10_exact_topk": op10_exact_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_structure_repair": op13_structure_repair,
}

#: CRC-32 of the text {s}, bit by bit, as unsigned number.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({s}, ''), lambda c: [ord(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
               lambda r, x: CASE WHEN x < 256 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END), 4294967295::BIGINT)"""
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CELL = "CASE WHEN {v} < 64 THEN {v} ELSE ({v} >> (length(bin({v})) - 6)) << (length(bin({v})) - 6) END"

ORACLE_SQL = {
    "op1_warc_normaliser": """
        WITH rows AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages),
        named AS (
            SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, hexed, min(page_id) OVER (PARTITION BY hexed) AS first_id,
                   translate(list_aggregate([to_base(('0x' || hexed[k:k + 4])::BIGINT, 32, 4) FOR k IN range(1, 41, 5)], 'string_agg', ''),
                             '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
            FROM rows)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM named
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    """,
    "op5_source_mixing": """
        WITH rows AS (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                   CASE WHEN coalesce(regexp_extract(source, '([0-9]{1,9})$', 1), '') = '' THEN 'other' ELSE 'd' || (regexp_extract(source, '([0-9]{1,9})$', 1)::INT % 4) END AS domain
            FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS supply FROM rows GROUP BY ALL),
        root AS (SELECT least(sum(tokens) * 3 // 4, sum(supply))::BIGINT AS given FROM leaves),
        d_nodes AS (
            SELECT n.domain, n.supply, n.tokens, n.weight, g.given
            FROM (SELECT domain, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens, CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY domain) n JOIN root g ON true),
        d_order AS (
            SELECT *, coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
            FROM d_nodes WINDOW w AS ( ORDER BY CASE WHEN weight > 0 THEN supply / weight ELSE 'inf'::DOUBLE END, domain)),
        d_full AS (SELECT *, supply * after <= (given - before) * weight AS full_up FROM d_order),
        d_rest AS (SELECT *, given - coalesce(sum(supply) FILTER (full_up) OVER (), 0) AS left_over, sum(weight) FILTER (NOT full_up) OVER () AS open_weight FROM d_full),
        d_floor AS (SELECT *, CASE WHEN full_up THEN supply ELSE coalesce(left_over * weight // nullif(open_weight, 0), 0) END AS floored, CASE WHEN NOT full_up THEN left_over * weight % nullif(open_weight, 0) END AS part FROM d_rest),
        d_given AS (
            SELECT domain, tokens, (floored + CASE WHEN part > 0 AND row_number() OVER ( ORDER BY part DESC NULLS LAST, domain) <= left_over - sum(floored) FILTER (NOT full_up) OVER () THEN 1 ELSE 0 END)::BIGINT AS given
            FROM d_floor),
        l_nodes AS (
            SELECT n.domain, n.lang, n.supply, n.tokens, n.weight, g.given
            FROM (SELECT domain, lang, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY domain, lang) n JOIN d_given g ON n.domain = g.domain),
        l_order AS (
            SELECT *, coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
            FROM l_nodes WINDOW w AS (PARTITION BY domain ORDER BY CASE WHEN weight > 0 THEN supply / weight ELSE 'inf'::DOUBLE END, lang)),
        l_full AS (SELECT *, supply * after <= (given - before) * weight AS full_up FROM l_order),
        l_rest AS (SELECT *, given - coalesce(sum(supply) FILTER (full_up) OVER (PARTITION BY domain), 0) AS left_over, sum(weight) FILTER (NOT full_up) OVER (PARTITION BY domain) AS open_weight FROM l_full),
        l_floor AS (SELECT *, CASE WHEN full_up THEN supply ELSE coalesce(left_over * weight // nullif(open_weight, 0), 0) END AS floored, CASE WHEN NOT full_up THEN left_over * weight % nullif(open_weight, 0) END AS part FROM l_rest),
        l_given AS (
            SELECT domain, lang, tokens, (floored + CASE WHEN part > 0 AND row_number() OVER (PARTITION BY domain ORDER BY part DESC NULLS LAST, lang) <= left_over - sum(floored) FILTER (NOT full_up) OVER (PARTITION BY domain) THEN 1 ELSE 0 END)::BIGINT AS given
            FROM l_floor),
        s_nodes AS (
            SELECT n.domain, n.lang, n.source, n.supply, n.tokens, n.weight, g.given
            FROM (SELECT domain, lang, source, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens, 1 AS weight FROM leaves GROUP BY domain, lang, source) n JOIN l_given g ON n.domain = g.domain AND n.lang = g.lang),
        s_order AS (
            SELECT *, coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
            FROM s_nodes WINDOW w AS (PARTITION BY domain, lang ORDER BY CASE WHEN weight > 0 THEN supply / weight ELSE 'inf'::DOUBLE END, source)),
        s_full AS (SELECT *, supply * after <= (given - before) * weight AS full_up FROM s_order),
        s_rest AS (SELECT *, given - coalesce(sum(supply) FILTER (full_up) OVER (PARTITION BY domain, lang), 0) AS left_over, sum(weight) FILTER (NOT full_up) OVER (PARTITION BY domain, lang) AS open_weight FROM s_full),
        s_floor AS (SELECT *, CASE WHEN full_up THEN supply ELSE coalesce(left_over * weight // nullif(open_weight, 0), 0) END AS floored, CASE WHEN NOT full_up THEN left_over * weight % nullif(open_weight, 0) END AS part FROM s_rest),
        s_given AS (
            SELECT domain, lang, source, tokens, (floored + CASE WHEN part > 0 AND row_number() OVER (PARTITION BY domain, lang ORDER BY part DESC NULLS LAST, source) <= left_over - sum(floored) FILTER (NOT full_up) OVER (PARTITION BY domain, lang) THEN 1 ELSE 0 END)::BIGINT AS given
            FROM s_floor),
        plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 2 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM s_given),
        keyed AS (SELECT r.*, p.epochs, p.rest, md5('7:' || (p.epochs + 1) || ':' || coalesce(r.doc_id::VARCHAR, 'none')) AS k FROM rows r JOIN plan p USING (domain, lang, source)),
        until AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
        SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - n_tokens < rest) THEN 1 ELSE 0 END)::INT AS n_draws,
               CASE WHEN upto > rest AND upto - n_tokens < rest THEN (rest - (upto - n_tokens))::BIGINT END AS prefix_tokens
        FROM until
    """,
    "op10_exact_topk": """
        WITH ints AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_prefix_trie": f"""
        WITH RECURSIVE turns AS (
            SELECT conv_id, length(coalesce(text, '')) AS chars, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format(s="conv_id::VARCHAR")} % 6 AS heads FROM (SELECT DISTINCT conv_id FROM turns)),
        rebuilt AS (
            SELECT c.conv_id, 0 AS origin, t.place, t.chars, t.mark FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.heads
            UNION ALL SELECT c.conv_id, 1, t.place, t.chars, t.mark FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.heads),
        paths AS (
            SELECT conv_id, row_number() OVER w AS depth, chars, string_agg(mark, '') OVER (w ROWS UNBOUNDED PRECEDING) AS name FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY origin, place)
            UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        ended AS (SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(name, depth) AS name FROM paths GROUP BY conv_id) GROUP BY name),
        nodes AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY name, depth),
        linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
            FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND p.name = left(n.name, (32 * p.depth)::BIGINT)
            LEFT JOIN (SELECT left(name, (32 * depth - 32)::BIGINT) AS name, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c ON c.name = n.name AND c.depth = n.depth)
        SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, count(*) FILTER (s.n_children = 0)::BIGINT AS n_leaves,
               sum((s.n_convs - 1) * s.chars)::BIGINT AS saved_tokens, sha256(coalesce(any_value(e.ids), '')) AS ends_sha256
        FROM linked n JOIN linked s ON s.depth >= n.depth AND starts_with(s.name, n.name) LEFT JOIN ended e ON e.name = n.name
        GROUP BY n.name, n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children
    """,
    "op12_quality_rules": f"""
        WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        spots AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM texts),
        windows AS (SELECT rid, spot, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v || ' ' || lead(word, 4) OVER v AS five FROM spots WINDOW v AS (PARTITION BY rid ORDER BY spot)),
        again AS (SELECT rid, spot FROM (SELECT rid, spot, count(*) OVER (PARTITION BY rid, five) AS n FROM windows WHERE five IS NOT NULL) WHERE n > 1),
        repeats AS (SELECT rid, count(DISTINCT spot + k) AS n FROM again, range(0, 5) r(k) GROUP BY rid),
        counted AS (
            SELECT x.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
                   (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                   (len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')))
                    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
                   coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM texts x LEFT JOIN repeats r USING (rid)),
        rated AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   CASE WHEN n_words > 0 THEN [100 * word_chars // n_words, 1000 * n_symbols // word_chars, 1000 * n_dup_lines // n_words, 1000 * n_repeat_words // n_words] ELSE [0, 0, 0, 0] END AS rates
            FROM counted),
        cells AS (SELECT lang, source, k, {_CELL.format(v="v")} AS cell FROM (SELECT lang, source, k, rates[k]::BIGINT AS v FROM rated, range(1, 5) r(k) WHERE n_words > 0)),
        levels AS (
            SELECT 0 AS level, lang, source, k, cell, count(*) AS n FROM cells GROUP BY ALL UNION ALL SELECT 1, lang, NULL, k, cell, count(*) FROM cells GROUP BY ALL
            UNION ALL SELECT 2, NULL, NULL, k, cell, count(*) FROM cells GROUP BY ALL),
        summed AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY level, lang, source, k) AS texts FROM levels),
        quartiles AS (SELECT level, lang, source, k, any_value(texts) AS texts, min(cell) FILTER (4 * upto >= texts) AS q1, min(cell) FILTER (4 * upto >= 3 * texts) AS q3 FROM summed GROUP BY level, lang, source, k),
        fences AS (SELECT *, q1 - 6 * (q3 - q1) AS low, q3 + 6 * (q3 - q1) AS high FROM quartiles),
        chosen AS (
            SELECT r.rid, r.k, arg_min({{'low': f.low, 'high': f.high}}, f.level) AS fence
            FROM (SELECT rid, lang, source, k FROM rated, range(1, 5) r(k)) r
            JOIN fences f ON f.k = r.k AND (f.level = 2 OR f.level = 1 AND f.texts >= 200 AND f.lang IS NOT DISTINCT FROM r.lang OR f.level = 0 AND f.texts >= 200 AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source)
            GROUP BY r.rid, r.k),
        beyond AS (SELECT DISTINCT c.rid FROM chosen c JOIN rated r USING (rid) WHERE r.rates[c.k] < c.fence.low - [100, 50, 80, 200][c.k] OR r.rates[c.k] > c.fence.high + [100, 50, 80, 200][c.k])
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM beyond) AS kept FROM rated
    """,
    "op13_structure_repair": f"""
        WITH RECURSIVE struck AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format(s="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM struck WHERE kind <> 0 UNION ALL SELECT conv_id, turn, role, text FROM struck WHERE kind = 3),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), seen) AS i, rtrim(text, {_SPACE}) AS trimmed, left(role, 1) AS initial
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged)),
        marked AS (SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
        pairs AS (SELECT conv_id, turn, fault, lag(initial) OVER w || initial AS pair, i > 1 AS has_pair FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (has_pair AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY conv_id),
        best AS (
            -- cost and audit from place i on, for the four states; 0: nothing, 1: after s, 2: after u, 3: after a
            SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS b0, {{'c': 10, 'a': 'II'}} AS b1, {{'c': 5, 'a': 'I'}} AS b2, {{'c': 0, 'a': ''}} AS b3 FROM counted
            UNION ALL
            SELECT conv_id, i, least(v0, {{'c': w2.c + 5, 'a': 'I' || w2.a}}), least(v1, {{'c': w2.c + 5, 'a': 'I' || w2.a}}), w2, w3
            FROM (
                SELECT conv_id, i, v0, v1, least(v2, {{'c': v3.c + 5, 'a': 'I' || v3.a}}) AS w2, least(v3, {{'c': v2.c + 5, 'a': 'I' || v2.a}}) AS w3
                FROM (
                    SELECT b.conv_id, b.i - 1 AS i,
                           least({{'c': b0.c + 2, 'a': 'D' || b0.a}}, {{'c': stay + b2.c + 1, 'a': 'R' || b2.a}}, {{'c': stay + CASE m.initial WHEN 'u' THEN b2.c WHEN 's' THEN b1.c ELSE 1000000 END, 'a': 'K' || CASE m.initial WHEN 's' THEN b1.a ELSE b2.a END}}) AS v0,
                           least({{'c': b1.c + 2, 'a': 'D' || b1.a}}, {{'c': stay + b2.c + 1, 'a': 'R' || b2.a}}, {{'c': stay + CASE m.initial WHEN 'u' THEN b2.c ELSE 1000000 END, 'a': 'K' || b2.a}}) AS v1,
                           least({{'c': b2.c + 2, 'a': 'D' || b2.a}}, {{'c': stay + b3.c + 1, 'a': 'R' || b3.a}}, {{'c': stay + CASE m.initial WHEN 'a' THEN b3.c ELSE 1000000 END, 'a': 'K' || b3.a}}) AS v2,
                           least({{'c': b3.c + 2, 'a': 'D' || b3.a}}, {{'c': stay + b2.c + 1, 'a': 'R' || b2.a}}, {{'c': stay + CASE m.initial WHEN 'u' THEN b2.c ELSE 1000000 END, 'a': 'K' || b2.a}}) AS v3
                    FROM best b JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000 END AS stay FROM marked) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i))),
        audits AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM best WHERE i = 0),
        edits AS (SELECT conv_id, j, audit[j] AS edit, sum((audit[j] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM audits)),
        stays AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY j) AS place FROM edits WHERE edit <> 'D'),
        met AS (
            SELECT s.conv_id, s.place, s.edit, m.role, m.text, first_value(s.edit = 'K' AND m.initial = 's') OVER (PARTITION BY s.conv_id ORDER BY s.place) AS has_s
            FROM stays s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i),
        repaired AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - has_s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole FROM met GROUP BY conv_id)
        SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
               coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
