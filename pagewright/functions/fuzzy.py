"""Costs and distances between noisy readings and known values, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import col

#: Digit pairs that are mistaken for each other, and integer costs.
CONFUSABLE = ("17", "27", "12", "14", "47", "49", "07", "38", "35", "58", "56", "68", "08", "06", "09")
SAME, CONFUSED, DIFFERENT, SUFFIX, LETTER, OTHER = 0, 6, 10, 5, 3, 14
#: Letters returned instead of the digit they look like.
LETTER_DIGIT = {"O": "0", "o": "0", "Q": "0", "D": "0", "U": "0", "I": "1", "i": "1", "l": "1", "L": "1", "!": "1", "|": "1", "Z": "2", "z": "2", "A": "4", "Y": "4", "y": "4", "S": "5", "s": "5", "G": "6", "b": "6", "F": "7", "T": "7", "t": "7", "J": "7", "B": "8", "g": "9", "q": "9"}
MAX_COST, MARGIN = 9, 3


def digit_table() -> list[int]:
    """The costs of all pairs of digits, row by row."""
    pairs = {frozenset(map(int, p)) for p in CONFUSABLE}
    return [SAME if a == b else CONFUSED if frozenset((a, b)) in pairs else DIFFERENT for a in range(10) for b in range(10)]


def misread_cost(left: Column, right: Column) -> Column:
    """What it costs to take one digit for another; both are texts of one digit."""
    return F.element_at(F.array(*map(F.lit, digit_table())), left.cast("int") * 10 + right.cast("int") + 1)


def char_cost(char: Column, digit: Column) -> Column:
    """What it costs to have read ``char`` where ``digit`` is written."""
    mapped = as_digits(char)
    return F.when(char.rlike("^[0-9]$"), misread_cost(char, digit)).when(mapped.rlike("^[0-9]$"), misread_cost(mapped, digit) + LETTER).otherwise(OTHER)


def weighted_hamming(left: str | Column, right: str | Column, size: int = 4) -> Column:
    """The digit costs of two numbers of ``size`` digits, summed."""
    out = F.lit(0)
    for k in range(1, size + 1):
        out = out + misread_cost(F.substring(col(left), k, 1), F.substring(col(right), k, 1))
    return out


def compacted(text: str | Column) -> Column:
    """The characters of a reading that can stand for a digit or a letter."""
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), "[^A-Za-z0-9!|]", "")


def as_digits(text: Column) -> Column:
    """Letters as the digits they look like."""
    return F.translate(text, "".join(LETTER_DIGIT), "".join(LETTER_DIGIT.values()))


def best_window_cost(text: str | Column, number: str | Column, size: int = 4) -> Column:
    """The least cost of finding ``number`` in any ``size`` characters of ``text``; null for shorter texts."""
    compact = compacted(text)

    def at(k: Column) -> Column:
        out = F.lit(0)
        for i in range(size):
            out = out + char_cost(F.substr(compact, k + i + 1, F.lit(1)), F.substring(col(number), i + 1, 1))
        return out

    return F.when(F.length(compact) >= size, F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.length(compact) - size, F.lit(0))), at)))


def lcs_length(left: str | Column, right: str | Column) -> Column:
    """The length of the longest common subsequence of two short texts, one row of the table at a time."""
    chars = lambda c: F.filter(F.split(col(c), ""), lambda x: x != "")
    zeros = F.transform(F.concat(F.array(F.lit("")), chars(right)), lambda _: F.lit(0))

    def step(row: Column, char: Column) -> Column:
        def cell(done: Column, b: Column) -> Column:
            k = F.size(done)
            met = F.element_at(row, k) + 1
            kept = F.greatest(F.element_at(row, k + 1), F.element_at(done, -1))
            return F.array_append(done, F.when(char == b, met).otherwise(kept))

        return F.aggregate(chars(right), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(chars(left), zeros, step), -1)


def matched_length(left: Column, right: Column, steps: int = 7) -> Column:
    """How many characters two texts share in longest common blocks, found left and right of each other (Ratcliff and Obershelp).

    Of equally long blocks the first in the left text counts, then the first in the right one. ``steps``: the greatest length
    of the shorter text, as each step takes a character of it at least.
    """

    def block(p: Column) -> Column:
        size = F.length(p["b"])
        every = F.transform(F.sequence(F.lit(1), size), lambda j: F.transform(F.sequence(F.lit(1), size - j + 1), lambda n: F.struct(n.alias("n"), (-F.position(F.substr(p["b"], j, n), p["a"])).alias("i"), (-j).alias("j"))))
        return F.array_max(F.filter(F.flatten(every), lambda x: x["i"] < 0))

    def step(now: Column, _: Column) -> Column:
        cut = F.filter(F.transform(now["parts"], lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), block(p).alias("m"))), lambda c: c["m"].isNotNull())
        before = lambda c: F.struct(F.substr(c["a"], F.lit(1), -c["m"]["i"] - 1).alias("a"), F.substr(c["b"], F.lit(1), -c["m"]["j"] - 1).alias("b"))
        after = lambda c: F.struct(F.substr(c["a"], c["m"]["n"] - c["m"]["i"]).alias("a"), F.substr(c["b"], c["m"]["n"] - c["m"]["j"]).alias("b"))
        parts = F.filter(F.flatten(F.transform(cut, lambda c: F.array(before(c), after(c)))), whole)
        return F.struct(parts.alias("parts"), (now["total"] + F.aggregate(cut, F.lit(0), lambda x, c: x + c["m"]["n"])).alias("total"))

    whole = lambda p: (p["a"] != "") & (p["b"] != "")
    start = F.struct(F.filter(F.array(F.struct(left.alias("a"), right.alias("b"))), whole).alias("parts"), F.lit(0).alias("total"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["total"]


def agrees_with(reading: str | Column, number: str | Column) -> Column:
    """Whether the digits of a reading (four at least say something) don't contradict a number of up to seven digits: three fifths alike."""
    digits, known = F.regexp_replace(F.coalesce(col(reading), F.lit("")), "[^0-9]", ""), F.format_string("%07d", col(number))
    return (F.length(digits) < 4) | (matched_length(digits, known) * 20 >= (F.length(digits) + F.length(known)) * 6)
