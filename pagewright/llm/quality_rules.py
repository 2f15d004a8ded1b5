"""Quality rules with thresholds that follow each language and source.

Every whole text is measured: words, symbols, repeated lines and repeated five-word windows. Four rates of these, as whole
numbers, go into quantile sketches for each language and source: counts of cells whose width grows with the value (exact
below 64, then within a 64th), so that sketches of tasks, sources and languages merge by adding counts, and merging in any
order gives the same sketch. From a sketch come fences far outside the quartiles. A source with fewer than ``LEAST`` texts
takes its language's sketch, a language with fewer takes that of all texts. Documents meet their fences by a join on language
and source, after the sketches' quantiles are read; only the measures, not the texts, are held between the two passes.

A text is dropped by the base rules (fewer than ten words, or more than a fifth of the words within repeated windows) or if a
rate lies beyond its fence by more than the ``SLACK`` of that rate.

Defined cases: a null text has no words; malformed bytes are replacement characters; null languages and sources are groups of
their own; repeated rows count each; texts without words have rates of zero and enter no sketch; where no sketch has texts
there is no fence; an empty table gives an empty result; other columns pass through ``filter_documents`` untouched, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import free_name, valid, written

#: The base rules' symbols, window and bounds, and white space.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEATED = b"#*$%&|<>", 5, 10, (20, 100)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURE_NAMES = [c.split()[0] for c in MEASURES.split(", ")]
#: Texts that a sketch must hold before its fences count, and the fences' distance from the quartiles in quartile ranges.
LEAST, REACH = 200, 6
#: The rates: name, SQL over the measures, and how far beyond its fence a rate may lie (for repeats as far as the base rule goes).
RATES = (
    ("word_length", "100 * word_chars DIV n_words", 100),
    ("symbols", "1000 * n_symbols DIV word_chars", 50),
    ("dup_lines", "1000 * n_dup_lines DIV n_words", 80),
    ("repeats", "1000 * n_repeat_words DIV n_words", 200),
)
#: A sketch's cells: values below 2^FINE have one each; above, each power of two has half as many.
FINE = 6


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of ``WINDOW`` words that are found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    m = n - WINDOW + 1
    name = at[:m]
    for k in range(1, WINDOW):  # a window's name: that of its first words, and its next word
        _, name = np.unique(name * len(ids) + at[k : k + m], return_inverse=True)
    again = np.bincount(name)[name] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The ``MEASURES`` of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(x.as_buffer().to_pybytes()) for x in batch.column(batch.num_columns - 1)]
        cols = np.array(found, np.int64).reshape(len(found), len(MEASURE_NAMES)).T
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, cols)], names=[*batch.schema.names[:-1], *MEASURE_NAMES])


def measured(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the ``MEASURES`` of each row's whole text."""
    rows = docs.select(*keep, valid(text_col).cast("binary").alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_measures, f"{kinds}, {MEASURES}" if kinds else MEASURES)


def base_failed() -> Column:
    part, of = MAX_REPEATED
    return (F.col("n_words") < MIN_WORDS) | (of * F.col("n_repeat_words") > part * F.col("n_words"))


def cell(value: Column) -> Column:
    """The sketch cell of a whole number of zero or more, named by its least value."""
    spare = F.greatest(F.length(F.bin(value)) - FINE, F.lit(0))
    return F.when(value < 1 << FINE, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare))


def rates() -> list[Column]:
    return [F.expr(f"CASE WHEN n_words > 0 THEN {sql} ELSE 0 END").cast("long").alias(name) for name, sql, _ in RATES]


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, rate, cell and how many texts' rates lie in it (``n``). ``rows``: ``by``, n_words and the rates."""
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), cell(F.col(name)).alias("cell")) for name, _, _ in RATES]))
    return rows.where("n_words > 0").select(*by, long.alias("x")).groupBy(*by, "x.rate", "x.cell").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of fewer keys from sketches of more: counts add up."""
    return parts.groupBy(*by, "rate", "cell").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str], reach: int = REACH) -> DataFrame:
    """by, rate, texts, low and high: ``reach`` quartile ranges below and above the quartiles' cells."""
    listed = sketch.groupBy(*by, "rate").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("n").alias("texts"))  # a few hundred cells at most

    def quantile(quarter: int) -> Column:
        # the first cell up to which a quarter's share of the texts lies
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("found"))
        step = lambda acc, x: F.struct((acc["upto"] + x["n"]).alias("upto"), F.coalesce(acc["found"], F.when(4 * (acc["upto"] + x["n"]) >= quarter * F.col("texts"), x["cell"])).alias("found"))
        return F.aggregate("cells", start, step)["found"]

    quartiles = listed.withColumn("q1", quantile(1)).withColumn("q3", quantile(3))
    span = reach * (F.col("q3") - F.col("q1"))
    return quartiles.select(*by, "rate", "texts", (F.col("q1") - span).alias("low"), (F.col("q3") + span).alias("high"))


def thresholds(rows: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """lang, source and a low and high fence for each rate (``<rate>_low``, ``<rate>_high``), by the levels' sketches."""
    own = written(sketches(rows, ["lang", "source"]), "quality-sketches")
    by_lang = written(merged(own, ["lang"]), "quality-sketches")
    levels = [fences(own, ["lang", "source"], reach), fences(by_lang, ["lang"], reach), fences(merged(by_lang, []), [], reach)]
    keys = own.select("lang", "source").distinct()
    out = keys.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(name,) for name, _, _ in RATES], "rate string")))  # four names
    for k, level in enumerate(levels):
        names = [c for c in ("lang", "source") if c in level.columns]
        level = level.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("rate").alias("_rate"), F.struct("texts", "low", "high").alias(f"f{k}"))
        same = F.col("rate") == F.col("_rate")
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(level, same, "left").drop("_rate", *[f"_{c}" for c in names])
    chosen = F.when(F.col("f0.texts") >= least, F.col("f0")).when(F.col("f1.texts") >= least, F.col("f1")).otherwise(F.col("f2"))
    pick = lambda name, side: F.max(F.when(F.col("rate") == name, F.col(f"fence.{side}"))).alias(f"{name}_{side}")
    return out.withColumn("fence", chosen).groupBy("lang", "source").agg(*[pick(name, side) for name, _, _ in RATES for side in ("low", "high")])


def within() -> Column:
    """Whether all rates lie within their fences, by their slack; where there is no fence they do."""
    out = F.lit(True)
    for name, _, slack in RATES:
        low, high = F.col(f"{name}_low") - slack, F.col(f"{name}_high") + slack
        out = out & F.coalesce(F.col(name).between(low, high), F.lit(True))
    return out


def judged(docs: DataFrame, keep: list[Column], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, reach: int = REACH) -> DataFrame:
    """The columns ``keep``, the ``MEASURES``, the rates, base_failed and kept, a row per document."""
    names = [docs.select(c).columns[0] for c in keep]
    rows = measured(docs, [*keep, F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source")], text_col)
    rows = written(rows.select("*", *rates(), base_failed().alias("base_failed")), "quality-measures")
    found = written(thresholds(rows.withColumnsRenamed({"_lang": "lang", "_source": "source"}), least, reach), "quality-thresholds")
    met = rows.join(found, F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source")), "left")
    return met.select(*names, *MEASURE_NAMES, *[name for name, _, _ in RATES], "base_failed", (~F.col("base_failed") & within()).alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that the rules drop."""
    uid, drop = free_name(docs, "uid", "drop")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "quality-rows")
    gone = judged(rows, [F.col(uid)], text_col, lang_col, source_col).where("NOT kept").select(F.col(uid).alias(drop))
    return rows.join(gone, F.col(uid) == F.col(drop), "left_anti").select(docs.columns)
