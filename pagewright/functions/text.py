"""String normalisers as native column expressions: identifiers, names, noisy digits and registrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that handwriting readers return for digits, and the suffixes some numbers always take.
DIGIT_FOR = {"O": "0", "Q": "0", "I": "1", "!": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "F": "7"}
ALWAYS_WWP, ALWAYS_CMP = ("1990",), ("1522",)
#: HTML's basic entities.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
UNSAFE = r'[<>:"/\\|?*\x00-\x1F]'


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def only_digits(c: str | Column) -> Column:
    """The ASCII digits of a text; the text itself if it has none."""
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.when(digits != "", digits).otherwise(col(c))


def first_char(c: str | Column) -> Column:
    """The first character of the trimmed text in upper case if it is an ASCII letter or digit, else empty."""
    ch = F.upper(F.substring(F.trim(col(c)), 1, 1))
    return F.when(ch.rlike("^[A-Z0-9]$"), ch).otherwise("")


def upper_trim(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def log_number(c: str | Column) -> Column:
    """Seven digits once all else is taken out; null otherwise."""
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.when(digits.rlike("^[0-9]{7}$"), digits)


def book_key(c: str | Column) -> Column:
    """A book is half a hundred of numbers: the first five digits and A (00-49) or B (50-99); null for other texts."""
    half = F.when(F.substring(col(c), 6, 2) < "50", "A").otherwise("B")
    return F.when(col(c).rlike("^[0-9]{7}$"), F.concat(F.substring(col(c), 1, 5), half))


def book_of(n: str | Column) -> tuple[Column, Column]:
    """The series and half of a number."""
    return F.floor(col(n) / 100).cast("long"), F.when(col(n) % 100 < 50, "A").otherwise("B")


def strip_copy_suffix(c: str | Column) -> Column:
    """A file stem without its copy number (``name-2``)."""
    return F.regexp_replace(col(c), r"-[0-9]+$", "")


def base_name(c: str | Column) -> Column:
    """A name without the address that is appended to it."""
    return F.regexp_replace(col(c), r" - [^ @]+@[^ @]+$", "")


def run_stamp(c: str | Column) -> Column:
    """The date and time in a run's name, empty without one."""
    return F.regexp_extract(col(c), r"([0-9]{8}[_-][0-9]{4,6})", 1)


def part_name(base: str | Column, index: str | Column, total: str | Column) -> Column:
    """The base alone if there is one part, else with the part's number."""
    return F.when(col(total) <= 1, col(base)).otherwise(F.concat(col(base), F.lit(" -"), col(index).cast("string")))


def safe_file_name(c: str | Column) -> Column:
    return F.regexp_replace(col(c), UNSAFE, "_")


def squeeze(c: str | Column) -> Column:
    """White space collapsed, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"[ \t\n\r\x0B\f]+", " ")))


def unescape_html(c: str | Column) -> Column:
    """Basic entities decoded; the ampersand last, so nothing is decoded twice."""
    out = col(c)
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def normalise_name(c: str | Column) -> Column:
    """Decoded, lower case, runs of separators as one space."""
    return F.trim(F.regexp_replace(F.lower(unescape_html(c)), r"[ _\-.]+", " "))


def gated(c: str | Column, pattern: str) -> Column:
    """The value if it has the canonical form, else empty."""
    return F.when(col(c).rlike(pattern), col(c)).otherwise("")


def to_digits(c: str | Column) -> Column:
    """Look-alike characters as digits."""
    return F.translate(col(c), "".join(DIGIT_FOR), "".join(DIGIT_FOR.values()))


def _window(raw: Column) -> Column:
    """The best four characters that read as digits, as a struct of score, start, digits and real digits; null without one."""

    def at(k: Column) -> Column:
        token, tail = F.substr(raw, k + 1, F.lit(4)), F.substr(raw, k + 5)
        real = F.length(F.regexp_replace(token, "[^0-9]", ""))
        after = F.when(F.substring(tail, 1, 1).isin("C", "W"), 3).when(tail == "", 1).when(tail.rlike("^[0-9]"), -3).otherwise(-1)
        before = F.when(k == 0, 0).when(k == 1, 1).when(k == 2, 2).when(k == 3, 1).otherwise(-2)
        ok = to_digits(token).rlike("^[0-9]{4}$") & (real >= 2)
        return F.when(ok, F.struct((after + before + real).alias("score"), (-k).alias("start"), to_digits(token).alias("digits"), real.alias("real")))

    return F.when(F.length(raw) >= 4, F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) - 4, F.lit(0))), at)))


def registration(c: str | Column) -> tuple[Column, Column]:
    """A registration in canonical form (empty if no four-digit number can be found) and how it was read: clean, ambiguous, weak or none."""
    raw = F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", "")
    run = F.regexp_extract(raw, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    best = _window(raw)
    fits = (best.score >= 4) | ((best.real == 4) & (best.score >= 3))
    scattered = F.regexp_replace(raw, "[^0-9]", "")
    number = F.when(run != "", run).when(fits, best.digits).when(F.length(scattered) == 4, scattered)
    quality = F.when(run != "", "clean").when(fits, F.when(best.real == 4, "clean").otherwise("ambiguous")).when(F.length(scattered) == 4, "weak").otherwise("none")
    wwp = (raw.contains("WWP") | number.isin(*ALWAYS_WWP)) & ~number.isin(*ALWAYS_CMP)
    return F.coalesce(F.concat(F.lit("HP-"), number, F.when(wwp, "WWP").otherwise("CMP")), F.lit("")), quality
