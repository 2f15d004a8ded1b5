import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import quality_rules as q
from tests.llm.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    again = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def rates(m):
    n, chars, symbols, lines, repeats = m
    return (100 * chars // n, 1000 * symbols // chars, 1000 * lines // n, 1000 * repeats // n) if n else (0, 0, 0, 0)


def plain_cell(v):
    spare = max(0, v.bit_length() - 6)
    return v if v < 64 else v >> spare << spare


def plain_verdicts(rows, least=q.LEAST, reach=q.REACH):
    """kept of each (text, lang, source), from sorted cells of every level."""
    found = [plain(t or "") for t, _, _ in rows]
    values = defaultdict(list)
    for (_, lang, source), m in zip(rows, found, strict=True):
        if m[0]:
            for k, r in enumerate(rates(m)):
                for key in ((0, lang, source), (1, lang), (2,)):
                    values[key, k].append(plain_cell(r))
    fence = {}
    for key, v in values.items():
        v = sorted(v)
        at = lambda quarter, v=v: v[-(-quarter * len(v) // 4) - 1]
        fence[key] = len(v), at(1) - reach * (at(3) - at(1)), at(3) + reach * (at(3) - at(1))
    out = []
    for (_, lang, source), m in zip(rows, found, strict=True):
        ok = not (m[0] < 10 or 100 * m[4] > 20 * m[0])
        for k, r in enumerate(rates(m)):
            levels = [fence.get((key, k)) for key in ((0, lang, source), (1, lang))]
            f = next((x for x in levels if x and x[0] >= least), fence.get(((2,), k)))
            if f and (0, lang, source, k) and ((0, lang, source), k) in fence:
                ok = ok and f[1] - q.RATES[k][2] <= r <= f[2] + q.RATES[k][2]
        out.append((*m, ok))
    return out


PIECES = st.lists(st.sampled_from(["a", "b", "é", "日本", " ", "\n", "\t", "\x0b", "\x1c", " ", "#", "a b c d e ", "%|", "\r\n"]), max_size=40).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_measures_match_plain_ones(text):
    assert q.measure(text.encode()) == plain(text)


def test_cells(spark):
    values = [*range(200), 255, 256, 257, 1000, 4095, 4096, 10**6, 2**40 + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", q.cell(F.col("v")).alias("c")).collect()
    assert [(r.v, r.c) for r in got] == [(v, plain_cell(v)) for v in values]


def test_verdicts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    for least, reach in ((q.LEAST, q.REACH), (5, 1)):
        got = {r.doc_id: r for r in q.judged(docs, [F.col("doc_id")], least=least, reach=reach).collect()}
        want = plain_verdicts([tuple(r)[1:] for r in rows], least, reach)
        assert [(*(got[r.doc_id][n] for n in q.MEASURE_NAMES), got[r.doc_id].kept) for r in rows] == want


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(3000).selectExpr("id", "id % 3 AS lang", "id % 7 AS source", "1L AS n_words", *[f"id * {k + 1} AS {name}" for k, (name, _, _) in enumerate(q.RATES)])
    whole = q.sketches(rows, []).collect()
    parts = q.merged(q.sketches(rows.where("id % 2 = 0"), ["lang", "source"]).unionByName(q.sketches(rows.where("id % 2 = 1"), ["lang", "source"])), [])
    assert Counter(map(tuple, whole)) == Counter(map(tuple, q.merged(q.merged(q.sketches(rows, ["lang", "source"]), ["lang"]), []).collect())) == Counter(map(tuple, parts.collect()))


def test_thresholds_follow_the_source(spark):
    # long words are usual in one source and far out in the other
    rows = [(k, " ".join(["abcdefghij" * 3 if k % 2 and k < 600 or k == 600 else "abc"] * 4 + [f"w{1000 + k}x{j}" for j in range(20)]), "en", f"s{k % 2}") for k in range(601)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in q.judged(df, [F.col("doc_id")]).where("NOT kept").collect()] == [600]
    assert df.count() - q.filter_documents(df).count() == 1


def test_odd_rows(spark, docs, no_docs):
    more = docs.withColumns({"n_words": F.lit(3), "low": F.lit(1), "uid": F.lit(9), "drop": F.lit(1), "_text": F.lit("y"), "symbols": F.lit(0), "rate": F.lit(0)})
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = q.judged(more, [F.col("doc_id")]).select(*q.MEASURE_NAMES, "kept").collect()
    assert Counter(map(tuple, got)) == Counter(plain_verdicts(rows))
    kept = q.filter_documents(more)
    assert kept.columns == more.columns and kept.count() == sum(r.kept for r in got)
    assert q.judged(no_docs, [F.col("doc_id")]).count() == q.filter_documents(no_docs).count() == 0


def test_malformed_bytes_are_replaced(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF2062') AS string) AS text, 'en' AS lang, cast(NULL AS string) AS source")
    assert [r[1] for r in q.judged(df, [F.col("doc_id")]).select("n_words", "word_chars").collect()] == [3]
