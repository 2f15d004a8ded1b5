"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are densities of two learned lexicons (words, and four- and five-letter stems of longer words), how near their
hits stand to second-person words, and rates of capitals, punctuation and obfuscated spellings. Lexicons, trees and the
calibration are fitted on at most ``max_rows`` labelled rows (chosen by hash, a documented bound); rows whose
crc32(id as text) is divisible by five are never among them. Of the others, remainder four calibrates and the rest grow
the lexicons and trees. Every row's whole text is scored; labels, languages, sources and ids are not inputs of a score.

Defined cases: a null text scores as an empty one; replacement characters stand for bytes that are no UTF-8; a null id is not held out; labels without an id or a value are left out,
and of several labels of an id the largest counts; with labels of less than two classes in either part every score is the
labels' mean (0 without labels); an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import free_name, scratch, utf8, valid, written

MAX_ROWS = 20_000
TERMS = 2_000
FOLDS = 5
WORD = re.compile(r"[^\W_]+")
ODD = re.compile(r"[^\W\d_][0-9@$!*+._-]+(?=[^\W\d_])")
SIDE = re.compile(r"[\w@$!*+.-]{0,30}")
LOUD = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")
LONG_RUN = re.compile(r"(\w)\1\1")
#: Second-person words of the four languages, and the letters that digits and signs stand for.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros os vuestro".split())
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "*": None, ".": None, "_": None, "-": None})
FEATURES = ("words", "lexicon", "hits", "stems", "stem_hits", "strength", "strongest", "second", "near", "capitals", "loud", "exclaim", "ask", "points", "runs", "odd", "odd_hits", "distinct")
NEAR = 5


def stems(word: str) -> tuple[str, ...]:
    """A longer word's first four and five letters, marked as stems."""
    return (f"{word[:4]}~", f"{word[:5]}~") if len(word) >= 6 else ()


def undone(word: str) -> str:
    return word.translate(STANDS_FOR)


def odd_words(low: str) -> list[str]:
    """Words with digits or signs between letters; of longer ones the letters near those. Linear in the text."""
    out, end = [], 0
    for m in ODD.finditer(low):
        if m.start() >= end:
            left = max(m.start() - 30, end)
            left = max(left, low.rfind(" ", left, m.start()) + 1)
            end = SIDE.match(low, m.end()).end()
            out.append(low[left:end])
    return out


def features(text: str, strength: dict[str, float]) -> list[float]:
    """The values of ``FEATURES``. ``strength``: the lexicons' terms with their log odds; stems end with a tilde."""
    low = text.lower()
    words = WORD.findall(low)
    n, get = max(1, len(words)), strength.get
    at, values, kinds, n_word, n_stem = [], [], set(), 0, 0
    for k, w in enumerate(words):
        value = get(w)
        if value is not None:
            n_word += 1
        elif len(w) >= 6:
            value = get(w[:5] + "~") or get(w[:4] + "~")
            if value is None:
                continue
            n_stem += 1
            w = w[:4]
        else:
            continue
        at.append(k)
        values.append(value)
        kinds.add(w)
    second = [k for k, w in enumerate(words) if w in SECOND]
    near = 0
    if at and second:
        a, s = np.array(at), np.array(second)
        j = np.searchsorted(s, a)
        gap = np.minimum(np.abs(a - s[np.minimum(j, len(s) - 1)]), np.abs(a - s[np.maximum(j - 1, 0)]))
        near = int((gap <= NEAR).sum())
    odd = odd_words(low)
    odd_hits = sum(1 for w in map(undone, odd) if w in strength or any(x in strength for x in stems(w)))
    chars, letters = max(1, len(text)), max(1, sum(map(len, words)))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    exclaim, ask = text.count("!"), text.count("?")
    points = sum(text.count(c) for c in ".,;:|")
    return [
        math.log1p(len(words)), n_word / n, math.log1p(n_word), n_stem / n, math.log1p(n_stem), sum(values) / n, max(values, default=0.0), len(second) / n, near / (len(at) + 1), upper / letters,
        len(LOUD.findall(text)) / n, exclaim / chars, ask / chars, points / chars, len(LONG_RUN.findall(low)) / n, len(odd) / n, math.log1p(odd_hits), math.log1p(len(kinds)),
    ]


def feature_column(text: str | Column, strength: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(x, strength)) for x in texts])

    return run(valid(text))


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo five; null for null."""
    return F.pmod(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")), F.lit(FOLDS))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            words = set(WORD.findall(text.as_py().decode("utf-8", "replace").lower()))
            (toxic if label.as_py() else clean).update(words | {s for w in words for s in stems(w)})
    terms = list(toxic)  # a term of no toxic text is no candidate, but its clean counts in other tasks are
    terms += [t for t in clean if t not in toxic]
    for k in range(0, len(terms), 50_000):
        part = terms[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "toxic", "clean"])


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int, terms: int = TERMS, least: float = 3.0) -> dict[str, float]:
    """The terms with the highest log odds of toxic against clean texts; ``rows``: text, toxic. At most ``terms`` of them."""
    counts = rows.select(utf8("text").alias("text"), "toxic").mapInArrow(_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    support = max(4, round(0.02 * n_toxic))
    best = counts.where(F.col("toxic") >= support).withColumn("odds", odds).where(F.col("odds") >= least).orderBy(F.desc("odds"), "term").limit(terms)
    return {r.term: r.odds for r in best.select("term", "odds").collect()}


@dataclass
class Model:
    """A fitted scorer. Without trees it gives ``mean``."""

    strength: dict[str, float]
    mean: float
    trees: object = None
    calibration: object = None

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 for each row."""
        if self.trees is None:
            return docs.withColumn(out, F.lit(self.mean))
        vector, raw, prob, hard, chance = free_name(docs, "tox_vector", "tox_raw", "tox_probability", "tox_prediction", "tox_chance")
        rows = docs.withColumn(vector, array_to_vector(feature_column(text_col, self.strength)))
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(hard)
        rows = trees.transform(rows).withColumn(chance, vector_to_array(prob)[1]).drop(vector, raw, prob, hard)
        rows = self.calibration.copy().setFeaturesCol(chance).setPredictionCol(out).transform(rows)
        return rows.select(*docs.columns, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0)).alias(out))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trees: int = 20, depth: int = 3, seed: int = 11) -> Model:
    """Fits the lexicons, trees and calibration on at most ``max_rows`` labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id") != 0)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = written(ids.join(F.broadcast(written(chosen, "toxicity-labels")), "doc_id"), "toxicity-sample")  # at most max_rows rows
    calibrates = fold("doc_id") == FOLDS - 1
    n = {(r.c, r.toxic): r.n for r in rows.groupBy(calibrates.alias("c"), "toxic").agg(F.count("*").alias("n")).collect()}
    mean = sum(v for (_, t), v in n.items() if t) / max(1, sum(n.values()))
    if not all(n.get((c, t)) for c in (False, True) for t in (0, 1)):
        return Model({}, float(mean))
    strength = learn_lexicon(rows.where(~calibrates), n[False, 1], n[False, 0])
    path = scratch(docs.sparkSession, "toxicity-features")
    rows.select(calibrates.alias("calibrates"), F.col("toxic").cast("double").alias("label"), feature_column("text", strength).alias("x")).repartition(4).write.parquet(path)
    table = docs.sparkSession.read.parquet(path).withColumn("features", array_to_vector("x"))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, checkpointInterval=-1, maxBins=64, minInstancesPerNode=5).fit(table.where("NOT calibrates"))
    held = boosted.transform(table.where("calibrates")).select(vector_to_array("probability")[1].alias("features"), "label")
    return Model(strength, float(mean), boosted, IsotonicRegression().fit(held))


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of one half)."""
    scored = fit(docs, labels, max_rows).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without the rows that score one half or more."""
    (out,) = free_name(docs, "score")
    return fit(docs, labels, max_rows).score(docs, out=out).where(F.col(out) < 0.5).select(docs.columns)
