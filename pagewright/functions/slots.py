"""Parts of a date from the slots of a form: one reading each, digits only, and what an unclear reading may stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that a character other than a digit may stand for, with their weights.
STANDS_FOR = {
    "O": {"0": 0.90}, "Q": {"0": 0.80}, "I": {"1": 0.85}, "L": {"1": 0.70}, "Z": {"2": 0.90}, "乙": {"2": 0.85}, "二": {"2": 0.80}, "S": {"5": 0.85}, "G": {"6": 0.85},
    "C": {"6": 0.72, "0": 0.40}, "B": {"8": 0.82, "6": 0.68},
}
#: Digits that may be others at a place of a part.
MISTAKEN = {("year", 1): {"4": {"0": 0.35}}, ("day", 1): {"7": {"9": 0.35}}}
LEAST_CONFIDENCE = 0.05
DIGIT_RULES = ("day", "year", "log_number", "digits")


def decoded(rule: str, readings: Column) -> Column:
    """The text and mean confidence of slots read one by one (structs of ``char``, ``confidence``); empty with 0 if they don't make up the part.

    Slots that aren't digits count as unread. A day of two slots needs its second one, a year needs all. Only confidences above
    0 are averaged; without any there is no text.
    """
    if rule not in DIGIT_RULES:
        raise ValueError(f"no rule for slots of digits: {rule!r}")
    sure = F.filter(F.transform(readings, lambda r: r["confidence"]), lambda c: c > 0)
    mean = F.round(F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure), 3)
    digits = F.transform(readings, lambda r: F.when(r["char"].rlike(r"\A[0-9]\z"), r["char"]).otherwise(""))
    text = F.array_join(digits, "")
    lost = F.lit(False)
    if rule == "day":
        lost = (F.size(digits) == 2) & (F.get(digits, F.lit(0)) != "") & (F.get(digits, F.lit(1)) == "")
    elif rule == "year":
        lost = F.exists(digits, lambda d: d == "")
    good = (F.size(sure) > 0) & ~lost & (text != "")
    return F.struct(F.when(good, text).otherwise("").alias("text"), F.when(good, mean).otherwise(0.0).alias("confidence"))


def digit_weights(observed: Column, confidence: Column, part: str, place: int) -> Column:
    """The digits that a slot's reading may stand for, as a map to their weights: the confidence (0.05 at least) times how well a character stands for the digit."""
    table = {c + d: w for c, to in STANDS_FOR.items() for d, w in to.items()} | {f"{d}{d}": 1.0 for d in range(10)}
    table |= {c + d: w for c, to in MISTAKEN.get((part, place), {}).items() for d, w in to.items()}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    chars = F.filter(F.split(F.upper(F.trim(F.coalesce(observed, F.lit("")))), ""), lambda c: c != "")
    base = F.greatest(F.lit(LEAST_CONFIDENCE), F.coalesce(confidence.cast("double"), F.lit(0.0)))
    entries = F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.struct(d.alias("digit"), (base * F.array_max(F.transform(chars, lambda c: F.element_at(known, F.concat(c, d))))).alias("weight")))
    return F.map_from_entries(F.filter(entries, lambda e: e["weight"].isNotNull()))


def best_products(first: Column, second: Column, low: int, high: int, n: int) -> Column:
    """The ``n`` numbers of two slots from ``low`` to ``high`` with the greatest products of their digits' weights, as structs (text, weight); of equals the smaller number."""
    pairs = F.flatten(F.transform(F.map_entries(first), lambda a: F.transform(F.map_entries(second), lambda b: F.struct((-(a["value"] * b["value"])).alias("order"), F.concat(a["key"], b["key"]).alias("text")))))
    valid = F.filter(pairs, lambda p: p["text"].cast("int").between(low, high))
    return F.transform(F.slice(F.array_sort(valid), 1, n), lambda p: F.struct(p["text"].alias("text"), (-p["order"]).alias("weight")))
