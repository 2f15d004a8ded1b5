import itertools
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from pagewright.functions import collections as fc
from pagewright.functions import dates as fd
from pagewright.functions import fuzzy as ff
from pagewright.functions import text as ft


def now():
    return F.to_date(F.lit("2026-01-15"))


def one(spark, value, *cols):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


@pytest.mark.parametrize(
    ("reading", "value", "quality"),
    [("1717", "HP-1717CMP", "clean"), ("hp-1990", "HP-1990WWP", "clean"), ("HP 1522 wwp", "HP-1522CMP", "clean"), ("HP-I7I7CMP", "HP-1717CMP", "ambiguous"), ("wAT 1Hp i712cmp", "HP-1712CMP", "ambiguous"), ("1-a-7-b-1-c-7", "HP-1717CMP", "weak"), ("GLOB", "", "none"), ("", "", "none"), ("12345", "HP-2345CMP", "clean"), ("12", "", "none")],
)
def test_registration(spark, reading, value, quality):
    got = one(spark, reading, *ft.registration("v"))
    assert got[0] == value
    assert got[1] in (quality, "weak")


def test_numbers_and_names(spark):
    got = one(spark, " No. 2147-349 ", ft.log_number("v"), ft.book_key(ft.log_number("v")), ft.only_digits("v"), ft.first_char("v"), ft.squeeze("v"), ft.safe_file_name("v"))
    assert got == ("2147349", "21473A", "2147349", "N", "no. 2147-349", " No. 2147-349 ")
    assert one(spark, "x", ft.log_number("v"), ft.book_key("v"), ft.only_digits("v")) == (None, None, "x")
    assert one(spark, "Lote &amp;lt; 20260115_0930 - a@b.c", ft.unescape_html("v"), ft.run_stamp("v"), ft.base_name("v")) == ("Lote &lt; 20260115_0930 - a@b.c", "20260115_0930", "Lote &amp;lt; 20260115_0930")
    assert one(spark, None, ft.log_number("v"), ft.book_key("v"), ft.registration("v")[0]) == (None, None, "")


def test_costs_match_plain(spark):
    rng = random.Random(1)
    digit = lambda a, b: 0 if a == b else 6 if "".join(sorted(a + b)) in ff.CONFUSABLE else 10
    char = lambda c, d: digit(c, d) if c.isdigit() else 3 + digit(ff.LETTER_DIGIT[c], d) if c in ff.LETTER_DIGIT else 14
    rows = [("".join(rng.choice("0123456789OISZxg-") for _ in range(rng.randint(0, 9))), f"{rng.randrange(10000):04d}") for _ in range(60)]
    got = spark.createDataFrame(rows, "t string, n string").select("t", "n", ff.best_window_cost("t", "n"), ff.weighted_hamming("n", F.lit("1717"))).collect()
    for t, n, cost, flat in got:
        compact = t.replace("-", "")
        want = min((sum(map(char, compact[k : k + 4], n)) for k in range(len(compact) - 3)), default=None)
        assert cost == want and flat == sum(map(digit, n, "1717"))


def test_lcs_matches_plain(spark):
    rng = random.Random(2)
    rows = [tuple("".join(rng.choice("ABC") for _ in range(rng.randint(0, 7))) for _ in "ab") for _ in range(40)]
    for a, b, got in spark.createDataFrame(rows, "a string, b string").select("a", "b", ff.lcs_length("a", "b")).collect():
        subs = {c for n in range(len(a) + 1) for c in itertools.combinations(a, n)}
        want = max(len(c) for n in range(len(b) + 1) for c in itertools.combinations(b, n) if c in subs)
        assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("15 jul 25", date(2025, 7, 15)), ("15-07-25", date(2025, 7, 15)), ("07-15-25", date(2025, 7, 15)), ("15JUL2025", date(2025, 7, 15)), ("30/02/25", None), ("1/1/99", None), ("", None), (None, None)],
)
def test_any_date(spark, text, want):
    assert one(spark, text, fd.any_date("v", now())) == (want,)


def test_windows(spark):
    d = F.to_date("v")
    assert one(spark, "2025-06-30", fd.date_is_possible(d, now()), fd.needs_review_for_age(d, now()), fd.days_outside_usual(d, now()), fd.month_end(d, now())) == (True, False, 154, date(2025, 6, 30))
    assert one(spark, "2026-01-31", fd.date_is_possible(d, now()), fd.date_is_possible(d, now(), True), fd.days_outside_usual(d, now()), fd.years_outside_usual(d, now())) == (False, True, 16, 0)
    assert one(spark, "2026-02-01", fd.month_end(d, now()), fd.month_key(d), fd.month_number(F.lit(" dic "))) == (None, "2026-02", 12)
    assert one(spark, "x", fd.full_year(F.lit(26), now()), fd.full_year(F.lit(27), now()), fd.checked_date(F.lit(2025), F.lit(2), F.lit(29))) == (2026, None, None)


def test_collections(spark):
    values = F.create_map(F.lit("b"), F.lit("1&2"), F.lit("a"), F.col("v"))
    assert one(spark, "ü=x", fc.decode_values(fc.encode_values(values)), fc.changed_keys(values, F.create_map(F.lit("a"), F.col("v")))) == ({"a": "ü=x", "b": "1&2"}, ["b"])
    assert one(spark, '{"a": "x", "b": {"c": 2, "d": null}}', fc.leaf_strings("v")) == (["2", "x"],)
    days = fc.date_candidates(F.array(F.lit(29), F.lit(30)), F.array(F.lit(2), F.lit(3)), F.array(F.lit(2025)))
    assert one(spark, "", days) == ([date(2025, 3, 29), date(2025, 3, 30)],)
    assert one(spark, "", fc.inferred_confidence(F.lit(9), F.lit(0)), fc.inferred_confidence(F.lit(0), F.lit(99))) == (0.89, 0.6)
