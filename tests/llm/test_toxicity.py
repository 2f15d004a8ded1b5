import math
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector, vector_to_array

from pagewright.llm import toxicity
from pagewright.llm.toxicity import FEATURES, FOLDS, SECOND, drop_toxic, feature_column, features, fit, fold, learn_lexicon, scores, undone

CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{CHECK}/labels.parquet").cache()
    docs = spark.read.parquet(f"{CHECK}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").coalesce(2).cache()
    return docs, labels


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(t == p for t, p in held) / len(held) > 0.93
    assert sum(p for t, p in held if not t) <= 1


def test_fit_without_two_classes(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = scores(docs, labels).collect()
    assert len(got) == docs.count() and {r.score for r in got} <= {0.0, 0.5, 1.0}
    assert scores(no_docs, labels).count() == 0
    assert [r.score for r in scores(docs.limit(1), labels.where("false")).collect()] == [0.0]


def test_odd_rows_are_scored(spark, tables, docs, no_docs):
    model = fit(*tables, trees=3)
    assert model.trees is not None
    kept = drop_toxic(tables[0], tables[1].where("doc_id < 0"))
    assert kept.columns == tables[0].columns and kept.count() == tables[0].count()
    rows = docs.selectExpr("*", "1 AS score", "2 AS tox_vector", "3 AS features")
    got = model.score(rows, out="mark")
    assert got.columns == [*rows.columns, "mark"]
    assert {r.mark for r in got.where("text IS NULL").collect()} == {r.mark for r in got.where("text = ''").collect()}
    assert got.where("doc_id IS NULL").count() == 1 and model.score(no_docs).count() == 0
    held = {r.doc_id for r in docs.where(fold("doc_id") == 0).collect()}
    assert held == {r.doc_id for r in docs.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_features():
    f = dict(zip(FEATURES, features("You LOSER!! l0ser and abcdefgh ... sooo", {"loser": 5.0, "abcde~": 4.0}), strict=True))
    assert f["hits"] > 0 and f["stem_hits"] > 0 and f["strongest"] == 5.0 and f["near"] > 0
    assert f["odd"] > 0 and f["odd_hits"] > 0 and f["loud"] > 0 and f["runs"] > 0 and f["exclaim"] > 0
    assert len(features("", {})) == len(FEATURES) == len(features("x" * 100_000, {}))


def test_the_sample_is_bounded(spark, tables):
    assert fit(*tables, max_rows=3).trees is None


def plain_words(text):
    out, word = [], ""
    for c in text + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_features(text, strength):
    """The features from their definitions; for texts whose tokens stand between single spaces."""
    low = text.lower()
    words = plain_words(low)
    n, hits = max(1, len(words)), []
    for k, w in enumerate(words):
        if w in strength:
            hits.append((k, strength[w], w, False))
        elif len(w) > 5:
            found = [s for s in (w[:5] + "~", w[:4] + "~") if strength.get(s)]
            if found:
                hits.append((k, strength[found[0]], w[:4], True))
    you = [k for k, w in enumerate(words) if w in SECOND]
    near = sum(any(abs(k - y) <= 5 for y in you) for k, *_ in hits)
    upper = lambda c: "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ"
    lower = lambda c: "a" <= c <= "z" or "ß" <= c <= "ö" or "ø" <= c <= "ÿ"
    runs_of = "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
    loud = sum(len(w) > 2 and all(c.isalpha() and not lower(c) for c in w) for w in runs_of)
    threes, k = 0, 0
    while k + 2 < len(low):
        same = low[k] == low[k + 1] == low[k + 2] and (low[k].isalnum() or low[k] == "_")
        threes, k = threes + same, k + (3 if same else 1)
    signs = "0123456789@$!*+._-"
    odd = []
    for token in low.split(" "):
        inner = [k for k in range(1, len(token) - 1) if token[k] in signs]
        if any(token[k - 1].isalpha() and next((c for c in token[k:] if c not in signs), "").isalpha() for k in inner):
            odd.append(token)
    hidden = sum(any(x in strength for x in (w, *((w[:4] + "~", w[:5] + "~") if len(w) > 5 else ()))) for w in map(undone, odd))
    chars, letters = max(1, len(text)), max(1, sum(map(len, words)))
    n_word, n_stem = sum(not s for *_, s in hits), sum(s for *_, s in hits)
    values = [v for _, v, _, _ in hits]
    return [
        math.log(1 + len(words)), n_word / n, math.log(1 + n_word), n_stem / n, math.log(1 + n_stem), sum(values) / n, max([0.0, *values]), len(you) / n, near / (len(hits) + 1), sum(map(upper, text)) / letters, loud / n, text.count("!") / chars, text.count("?") / chars,
        sum(c in ".,;:|" for c in text) / chars, threes / n, len(odd) / n, math.log(1 + hidden), math.log(1 + len({w for _, _, w, _ in hits})),
    ]


TOKENS = st.lists(st.sampled_from(["you", "YOU", "Loser", "l0ser", "lo$er", "abcdefgh", "abcdxyz", "so", "sooo!!", "WHY?", "ÄRGER", "a.b", "e-mail", "x_y", "1234", "end.", "du,", "A1B", "---", "!", "naïve"]), max_size=25).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(TOKENS)
def test_features_match_their_definitions(text):
    strength = {"loser": 5.0, "abcde~": 4.0, "abcd~": 3.5, "so": 3.0}
    assert features(text, strength) == pytest.approx(plain_features(text, strength))


def test_the_lexicon_is_counted_plainly(spark):
    rows = [("bad words here", 1)] * 5 + [("bad things", 1)] * 3 + [("good words", 0)] * 40 + [("Terribly bad", 1)] * 4 + [(None, 1)]
    got = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 13, 40)
    counts = {}
    for text, toxic in rows:
        words = set(plain_words((text or "").lower()))
        for t in words | {w[:k] + "~" for w in words if len(w) > 5 for k in (4, 5)}:
            counts.setdefault(t, [0, 0])[1 - toxic] += 1
    odds = {t: math.log((a + 0.5) / 14) - math.log((b + 0.5) / 41) for t, (a, b) in counts.items() if a >= 4}
    want = {t: o for t, o in odds.items() if o >= 3.0}
    assert got == pytest.approx(want) and set(got) >= {"bad", "terri~"}
    best = sorted(want, key=lambda t: (-want[t], t))[:2]
    assert set(learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 13, 40, terms=2)) == set(best)


def pooled(pairs):
    """Isotonic regression by pooling neighbours that fall: mean and size of each block, in the order of x."""
    blocks = []
    for x in sorted({x for x, _ in pairs}):
        own = [y for a, y in pairs if a == x]
        blocks.append([sum(own), len(own), [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: total / n for total, n, xs in blocks for x in xs}


def test_calibration_is_isotonic(tables):
    docs, labels = tables
    model = fit(docs, labels, trees=5)
    calibrates = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(fold("doc_id") == FOLDS - 1)
    bare = model.trees.copy().setFeaturesCol("v").setProbabilityCol("p")
    rows = bare.transform(calibrates.withColumn("v", array_to_vector(feature_column("text", model.strength)))).select("doc_id", "toxic", vector_to_array("p")[1].alias("x")).collect()
    want = pooled([(r.x, r.toxic) for r in rows])
    got = {r.doc_id: r.score for r in model.score(calibrates.select("doc_id", "text")).collect()}
    assert len(rows) > 30 and all(got[r.doc_id] == pytest.approx(want[r.x], abs=1e-6) for r in rows)


def test_malformed_bytes_are_replaced(spark):
    df = spark.sql("SELECT cast(unhex('61FF2062') AS string) AS text UNION ALL SELECT CAST(NULL AS string)")
    got = [list(r[0]) for r in df.select(toxicity.feature_column("text", {})).collect()]
    assert got == [toxicity.features("a� b", {}), toxicity.features("", {})]
