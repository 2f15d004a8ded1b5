"""Flight numbers read from handwriting, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import col

#: The words a flight number may be, longest first; labels printed beside it; and its prefix.
CODES = ("TCK", "CCK", "SPV", "SVC", "SUP", "MTC", "SV")
LABELS = r"\b(?:FLT|FLIGHT|NO|CHECK)\b"
PREFIX = "CM"
#: Letters for digits anywhere, those between two digits, those behind the whole prefix, and signs written with one stroke.
LETTERS = {"O": "0", "Q": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "Y": "4", "T": "7", "F": "7"}
BETWEEN = {"C": "0", "D": "0"}
BEHIND = LETTERS | {"A": "4", "D": "0"}
STROKES = ("0OQD", "1IL", "2Z", "3E", "4YA", "5S", "6G", "7TFJ", "8B", "9PR", "UV")
LEAST, MOST = 3, 4


def _translated(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def code_in(compact: Column) -> Column:
    """The longest word that the reading holds, with a digit right behind it; null without one."""
    return F.coalesce(*[F.when(compact.contains(c), F.concat(F.lit(c), F.regexp_extract(compact, f"{c}([0-9]?)", 1))) for c in CODES])


def digit_run(compact: Column) -> Column:
    """The run of three or four signs that read as digits with the most real digits (then the longest, then the last): a struct with ``start`` and ``digits``; null without one."""
    n = F.length(compact)

    def sign(k: Column) -> Column:
        char = F.substr(compact, k, F.lit(1))
        inner = (k > 1) & (k < n) & F.substr(compact, k - 1, F.lit(1)).rlike("^[0-9]$") & F.substr(compact, k + 1, F.lit(1)).rlike("^[0-9]$")
        read = F.when(char.rlike("^[0-9]$"), F.concat(char, F.lit("r"))).when(char.isin(*LETTERS), F.concat(_translated(char, LETTERS), F.lit("m")))
        read = F.coalesce(read, F.when(inner & char.isin(*BETWEEN), F.concat(_translated(char, BETWEEN), F.lit("m"))))
        return F.coalesce(F.concat(read, F.lpad(k.cast("string"), 4, "0")), F.lit("#"))

    signs = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), sign), "")).otherwise("")
    runs = F.regexp_extract_all(signs, F.lit("((?:[0-9][rm][0-9]{4})+)"), 1)
    scored = F.transform(
        runs, lambda r: F.struct(F.length(F.regexp_replace(r, "[^r]", "")).alias("real"), (F.length(r) / 6).cast("int").alias("length"), F.substr(r, F.lit(3), F.lit(4)).cast("int").alias("start"), F.regexp_replace(r, "([0-9])[rm][0-9]{4}", "$1").alias("digits"))
    )
    return F.array_max(F.filter(scored, lambda r: r.length.between(LEAST, MOST) & (r.real > 0)))


def code_costs(token: Column) -> Column:
    """What each word is from a reading: strokes apart if they are of one length, else edits; then the difference in length."""
    strokes = {c: group[0] for group in STROKES for c in group[1:]}
    plain = _translated(token, strokes)
    ranked = []
    for code in CODES:
        apart = sum(((F.substring(plain, k, 1) != strokes.get(c, c)).cast("int") for k, c in enumerate(code, 1)), F.lit(0))
        cost = F.when(F.length(token) == len(code), apart).otherwise(F.levenshtein(token, F.lit(code)))
        ranked.append(F.struct(cost.alias("cost"), F.abs(F.length(token) - len(code)).alias("size"), F.lit(code).alias("code")))
    return F.array_sort(F.array(*ranked))


def with_flight_number(df: DataFrame, reading: str | Column, out: str) -> DataFrame:
    """``df`` with a flight number: a word of the vocabulary, a number of up to four digits, or a prefixed number; empty if the reading is none of them.

    Its steps are columns of their own, so that none is worked out twice.
    """
    c, run, tail, read, costs = (F.col(f"_{n}") for n in ("compact", "run", "tail", "read", "costs"))
    compact = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(col(reading), F.lit(""))), LABELS, " "), "[^A-Z0-9]", "")
    rows = df.withColumn("_compact", compact)
    ends = (F.length(c) > 2) & c.rlike("[0-9]$")
    token, last = F.when(ends, F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c), F.when(ends, F.substring(c, -1, 1)).otherwise("")
    rows = rows.withColumns({"_code": code_in(c), "_run": digit_run(c), "_tail": F.regexp_extract(c, f"^{PREFIX}P?(.{{1,4}})$", 1), "_costs": code_costs(token)}).withColumn("_read", _translated(tail, BEHIND))
    plain = F.when((F.length(c) <= MOST) & ~c.rlike("^0+$"), c).otherwise("")
    before = F.regexp_replace(F.substr(c, F.lit(1), run.start - 1), "[^A-Z]", "")
    by_run = F.concat(F.when(before == "", "").when(before == "A", "A").otherwise(PREFIX), run.digits)
    prefixed = F.when((tail != "") & read.rlike("^[0-9]+$") & ((F.length(tail) >= LEAST) | tail.rlike("[0-9]")), F.concat(F.lit(PREFIX), read))
    rival = (costs[1].cost == costs[0].cost) & (costs[1].size == costs[0].size)
    nearest = F.when((F.length(token) >= 2) & (costs[0].cost <= 1) & ~rival, F.concat(costs[0].code, last))
    number = F.when(c == "", "").otherwise(F.coalesce("_code", F.when(c.rlike("^[0-9]+$"), plain), by_run, prefixed, nearest, F.lit("")))
    return rows.withColumn(out, number).drop("_compact", "_code", "_run", "_tail", "_read", "_costs")
