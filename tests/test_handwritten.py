import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import handwritten as fh
from pagewright.functions.fuzzy import best_window_cost, weighted_hamming
from pagewright.operators import joins, registrations


@pytest.mark.parametrize(
    ("text", "want"),
    [("7", [7]), ("07", [7]), ("13", []), ("JUL", [7]), ("jul month", [7]), ("DIC", [12]), ("JU1", [7]), ("GUL", [7]), ("JTUIC", [7]), ("JUK", [6, 7]), ("50c", []), ("X", []), ("", []), (None, []), ("QQQQQQ", []), ("0CT", [10])],
)
def test_month_candidates(spark, text, want):
    got = spark.createDataFrame([(text,)], "v string").select(fh.month_candidates("v"), fh.month_value("v")).first()
    assert got[0] == want
    assert got[1] == (want[0] if len(want) == 1 else None)


@pytest.mark.parametrize(("text", "want"), [("21 0", "21"), ("2 0", "20"), ("Z0", "20"), ("8", "8"), ("32", ""), ("123", ""), ("", ""), (None, ""), ("DAY 5", "5"), ("1 2 3", "")])
def test_day_value(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(fh.day_value("v")).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("Year YR 26", "26"), ("2 6", "26"), ("2 0 2 5", "2025"), ("Z6", "26"), ("27", ""), ("216", "216"), ("8313", ""), ("", ""), (None, "")])
def test_year_value(spark, text, want):
    as_of = F.to_date(F.lit("2026-01-15"))
    assert spark.createDataFrame([(text,)], "v string").select(fh.year_value("v", as_of)).first()[0] == want


def test_registration_vote(spark):
    rows = [("b", 1, "p1", "1717", 0.9, "clean"), ("b", 1, "p2", "1714", 0.4, "clean"), ("b", 2, "p3", "1714", 0.9, "weak"), ("b", 3, "p4", "1717", 0.6, "ambiguous"), ("b", 4, "p5", "", 0.2, "none"), ("c", 9, "p6", "", 0.1, "none")]
    pages = spark.createDataFrame(rows, "book string, log int, page string, number string, confidence double, quality string")
    evidence = registrations.unique_evidence(pages, "book", "log", "number", "confidence", "quality", "page")
    assert sorted((r.log, r.number) for r in evidence.collect()) == [(1, "1717"), (2, "1714"), (3, "1717")]
    winners = registrations.book_winners(evidence, "book", "number")
    assert [tuple(r) for r in winners.collect()] == [("b", "1717", 2)]
    got = {r.page: (r.value, r.method, r.status) for r in registrations.impose(pages, winners, "book", "number", "confidence").collect()}
    assert got == {"p1": ("1717", "confirmed", "OK"), "p2": ("1717", "overwritten", "WARNING"), "p3": ("1717", "overwritten", "WARNING"), "p4": ("1717", "confirmed", "OK"), "p5": ("1717", "filled", "OK"), "p6": ("", "no_vote", "ERROR")}
    fleet = spark.createDataFrame([("1714",)], "number string")
    assert [tuple(r) for r in registrations.book_winners(evidence, "book", "number", fleet).collect()] == [("b", "1714", 1)]


def test_ranked_names(spark):
    names = spark.createDataFrame([("a-1", "a", 5), ("a-2", "a", 6), ("b", "b", 1), ("c-1", "c", 2), ("c-2", "c", 2)], "name string, base string, size int")
    wanted = spark.createDataFrame([("a-2", "a", 5), ("a", "a", 5), ("c", "c", 2), ("z", "z", 1)], "name string, base string, size int")
    got = {r.wanted: r.found for r in registrations.ranked_names(wanted, names, "name", "base", "size").collect()}
    assert got == {"a-2": "a-2", "a": "a-1", "c": None, "z": None}


def test_reading_costs_are_sums_over_readings(spark):
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", "17", "HP-1717CMP", "l7!7", "????", "1 7 1 7", "".join(rng.choice("0179OlZ-x ") for _ in range(rng.randrange(9)))])
    pages = spark.createDataFrame([(rng.choice([1, 2, 3, None]), text()) for _ in range(150)] + [(4, "12"), (4, None)], "book int, text string")
    asked = spark.createDataFrame([(b, f"v{k}", f"{rng.randrange(10000):04d}") for b in (1, 2, 3, 4) for k in range(5) for _ in range(3)], "book int, value string, option string").distinct()
    costs = registrations.reading_costs(asked, pages, "book", "value", "option", "text")
    got = {(r.book, r.value, r.option): r._cost for r in costs.collect()}
    each = asked.join(pages, "book").groupBy("book", "value", "option").agg(F.coalesce(F.sum(best_window_cost("text", "option")), F.lit(0)).alias("cost"))
    want = {(r.book, r.value, r.option): r.cost for r in each.collect()}
    assert got == want and {k for k, v in got.items() if v == 0} == {k for k in want if k[0] == 4}


def test_ties_near_and_far_are_all_options(spark):
    fleet = spark.createDataFrame([(n,) for n in ("0000", "0006", "0600", "9999", "9111", "1119", "x")], "number string")
    costs = spark.createDataFrame([(r,) for r in ("0066", "2222", "0008")], "reading string").join(fleet.where("number <> 'x'")).withColumn("cost", weighted_hamming("reading", "number"))
    near = costs.groupBy("reading").agg(F.min("cost").alias("cost"))
    got = {tuple(r) for r in joins.numbers_at(near, "reading", "cost", fleet, "number").collect()}
    assert got == {(r.reading, r.number) for r in costs.join(near, ["reading", "cost"]).collect()}
    assert near.where("cost >= 18").count() and near.where("cost < 18").count()


def test_a_reading_is_worked_out_once(spark):
    one = spark.createDataFrame([("JUL", "O5")], "m string, d string").select(fh.month_value("m").alias("month"), fh.day_value("d").alias("day"))
    plan = one._jdf.queryExecution().analyzed().toString()
    assert plan.count("levenshtein(") == 1 and plan.count("upper(") == 1


@pytest.mark.parametrize(("text", "day", "year"), [("OO5", "05", "05"), ("IO5", "05", "05"), ("lO", "", ""), ("1\ue0005", "15", "15"), ("O5\nZ1", "05", "21"), ("12 123", "12", "12"), ("1 123", "1", "123"), ("5 B G8", "", ""), ("2 0 2 7", "", "")])
def test_letters_beside_digits(spark, text, day, year):
    got = spark.createDataFrame([(text,)], "v string").select(fh.day_value("v"), fh.year_value("v", F.to_date(F.lit("2026-01-15")))).first()
    assert tuple(got) == (day, year)


def test_distinct_values_are_worked_out_once(spark):
    rows = spark.createDataFrame([(k, [None, "a", "b"][k % 3], [None, 1][k % 2]) for k in range(60)], "k int, a string, b int")
    got = joins.worked_out_once(rows, ["a", "b"], {"both": F.concat_ws("-", F.coalesce("a", F.lit("none")), F.col("b").cast("string")), "n": F.monotonically_increasing_id()})
    found = got.collect()
    assert sorted((r.k, r.both) for r in found) == [(k, f"{[None, 'a', 'b'][k % 3] or 'none'}{'-1' if k % 2 else ''}") for k in range(60)]
    assert len({r.n for r in found}) == 6
