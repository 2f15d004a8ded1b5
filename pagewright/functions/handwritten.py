"""Days, months and years read from handwriting, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.dates import MONTHS, year_is_possible
from pagewright.functions.fuzzy import lcs_length
from pagewright.functions.text import col

#: Letters for misread signs inside month names, and digits for letters beside digits.
LETTER_FOR = {"0": "O", "1": "L", "5": "S", "8": "B", "I": "L"}
DIGIT_FOR = {"O": "0", "o": "0", "Q": "0", "I": "1", "i": "1", "l": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "8", "G": "6", "g": "6"}


#: Runs of one and of two digits (in groups), and the private signs that stand for a digit until all letters are read.
ONE, TWO = "(?<![0-9])([0-9])(?![0-9])", "(?<![0-9])([0-9]{2})(?![0-9])"
HELD = {digit: chr(0xE000 + k) for k, digit in enumerate(sorted(set(DIGIT_FOR.values())))}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inside(text: Column) -> Column:
    """The months with a name inside a text, sorted."""
    named = lambda n: [F.contains(text, F.lit(name)) for name, k in MONTHS.items() if k == n]
    either = lambda found: found[0] if len(found) == 1 else found[0] | either(found[1:])
    return F.array_compact(F.array(*[F.when(either(named(n)), F.lit(n)) for n in range(1, 13)]))


def _nearest(fits: Column) -> Column:
    """The months with the fewest edits among names that fit, sorted."""
    least = lambda best: F.array_sort(F.array_distinct(F.transform(F.filter(fits, lambda m: m["edits"] == best), lambda m: m["n"])))
    return _let(F.array_min(F.transform(fits, lambda m: m["edits"])), least)


def _alike(letters: Column) -> Column:
    """The months of names that are alike: one edit and two letters in place, or two edits and two letters in order."""
    place = lambda m, k: ((F.substring(letters, k, 1) == F.substring(m["name"], k, 1)) & (F.length(letters) >= k)).cast("int")
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(n).alias("n")) for name, n in MONTHS.items()])
    measured = F.transform(names, lambda m: F.struct(m["name"].alias("name"), m["n"].alias("n"), F.levenshtein(letters, m["name"]).alias("edits")))
    near = lambda all_: F.filter(all_, lambda m: (m["edits"] < 2) & (place(m, 1) + place(m, 2) + place(m, 3) >= 2))
    far = lambda all_: F.filter(all_, lambda m: (m["edits"] < 3) & (lcs_length(letters, m["name"]) >= 2))
    farther = lambda all_: F.when(F.length(letters).between(3, 5), _nearest(far(all_))).otherwise(F.array().cast("array<int>"))
    return _let(measured, lambda all_: _let(near(all_), lambda fits: F.when(F.size(fits) > 0, _nearest(fits)).otherwise(farther(all_))))


def month_candidates(c: str | Column) -> Column:
    """All months a reading may stand for, sorted.

    A number; a name inside the text; a name inside it once misread signs are letters; names one edit away with two letters
    in place; for three to five letters names two edits away that share two letters in order. Of the last two the nearest.
    """
    none = F.array().cast("array<int>")
    first = lambda found, other: _let(found, lambda months: F.when(F.size(months) > 0, months).otherwise(other))

    def numbered(raw: Column) -> Column:
        digits = F.substring(F.regexp_replace(raw, "[^0-9]", ""), 1, 3).try_cast("int")
        return _let(digits, lambda n: F.when(n.between(1, 12), F.array(n)).otherwise(none))

    def mended(raw: Column, own: Column) -> Column:
        letters = F.regexp_replace(F.translate(raw, "".join(LETTER_FOR), "".join(LETTER_FOR.values())), "[^A-Z]", "")
        short = lambda text: (F.length(text) < 2) | (raw.rlike("[0-9]") & (F.length(own) < 2))
        return _let(letters, lambda text: F.when(short(text), none).otherwise(first(_inside(text), _alike(text))))

    named = lambda raw: _let(F.regexp_replace(raw, "[^A-Z]", ""), lambda own: first(_inside(own), mended(raw, own)))
    return _let(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), lambda raw: F.when(~raw.rlike("[A-Z]"), numbered(raw)).otherwise(named(raw)))


def month_value(c: str | Column) -> Column:
    """The month if there is just one candidate."""
    return _let(month_candidates(c), lambda found: F.when(F.size(found) == 1, found[0]))


def _beside_digits(value: Column) -> Column:
    """Letters right before a digit as the digits they look like; private signs as spaces, as only digits are read later."""
    letters = lambda digit: "".join(x for x, d in DIGIT_FOR.items() if d == digit)
    out = F.translate(value, "".join(HELD.values()), " " * len(HELD))
    for digit, sign in HELD.items():
        out = F.regexp_replace(out, f"[{letters(digit)}](?=[0-9])", sign)
    return F.when(value.rlike(f"[{''.join(DIGIT_FOR)}][0-9]"), F.translate(out, "".join(HELD.values()), "".join(HELD))).otherwise(value)


def _joined(value: Column, *counts: int) -> Column:
    """As many single digits as ``counts`` names as one run."""
    several = "|".join(f"(?:[^0-9]+[0-9]){{{n - 1}}}" for n in counts)
    return F.when(value.rlike(rf"\A[^0-9]*[0-9](?:{several})[^0-9]*\z"), F.regexp_replace(value, "[^0-9]", "")).otherwise(value)


def day_value(c: str | Column) -> Column:
    """A day's digits (1 to 31); empty if the reading has none or is unclear."""
    short = lambda value: F.when((F.length(value) <= 8) & ~value.rlike("[A-Z]{3,}"), _beside_digits(value)).otherwise(value)
    digits = lambda runs: F.when(runs.rlike(TWO), F.regexp_extract(runs, TWO, 1)).when(F.regexp_count(runs, F.lit(ONE)) == 1, F.regexp_extract(runs, ONE, 1)).otherwise("")
    read = _let(F.coalesce(col(c), F.lit("")), lambda value: _let(short(value), lambda v: _let(_joined(v, 2), digits)))
    return F.regexp_extract(read, "^(0?[1-9]|[12][0-9]|3[01])$", 1)


def year_value(c: str | Column, as_of: Column) -> Column:
    """A year's two or four digits up to ``as_of``'s; three digits are kept for later repair; empty otherwise."""
    last = lambda runs, n: F.regexp_extract(runs, rf"(?s)\A.*(?<![0-9])([0-9]{{{n}}})(?![0-9])", 1)
    ok = lambda digits, century: year_is_possible(digits.try_cast("int") + century, as_of)
    of_two = lambda runs: _let(last(runs, 2), lambda two: F.when(two != "", F.when(ok(two, 2000), two).otherwise("")).otherwise(last(runs, 3)))
    of_four = lambda runs: _let(F.regexp_extract(runs, "(?<![0-9])([0-9]{4})(?![0-9])", 1), lambda four: F.when(four != "", F.when(ok(four, 0), four).otherwise("")).otherwise(of_two(runs)))
    return _let(F.coalesce(col(c), F.lit("")), lambda value: _let(_beside_digits(value), lambda v: _let(_joined(v, 2, 4), of_four)))
