"""Registries, registrations and jobs on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.operators import groups, jobs, registrations, registry
from pagewright.plans import catalogue


def day(n, month=1):
    return datetime.date(2024, month, n)


@pytest.mark.parametrize(
    ("stored", "observed", "action", "kept"),
    [
        ([], [(3, day(3))], "new", [(3, day(3))]),
        ([(3, day(3))], [(3, day(3))], "unchanged", [(3, day(3))]),
        ([(3, day(3))], [(9, day(5)), (12, day(6))], "extended", [(3, day(3)), (12, day(6))]),
        ([(3, day(3))], [(3, day(4))], "conflict", [(3, day(3))]),
        ([(3, day(3))], [(3, day(4)), (5, day(6))], "corrected", [(3, day(4)), (5, day(6))]),
        ([(30, day(3))], [(40, day(1))], "conflict", [(30, day(3))]),
        (None, [(1, day(1))], "new", [(1, day(1))]),
    ],
)
def test_merged_anchors(spark, stored, observed, action, kept):
    df = spark.createDataFrame([(stored, observed)], f"s {registry.ANCHORS}, o {registry.ANCHORS}")
    got = df.select(registry.merged_anchors(F.col("s"), F.col("o")).alias("m")).first().m
    assert (got.action, [tuple(a) for a in got.anchors]) == (action, kept)


def test_dates_of_two_copies_are_synchronised(spark):
    kind = f"k string, anchors {registry.ANCHORS}"
    base = spark.createDataFrame([("a", [(1, day(1))]), ("b", [(1, day(1))]), ("c", [(1, day(1))])], kind)
    local = spark.createDataFrame([("a", [(1, day(1)), (5, day(5))]), ("b", [(1, day(1)), (5, day(5))]), ("c", [(1, day(9))])], kind)
    server = spark.createDataFrame([("a", [(1, day(1))]), ("b", [(1, day(1)), (8, day(8))]), ("c", [(1, day(7))])], kind)
    got = {r.k: (r.decision, [tuple(a) for a in r.merged]) for r in registry.synchronised_dates(base, local, server, "k").collect()}
    assert got == {"a": ("local", [(1, day(1)), (5, day(5))]), "b": ("united", [(1, day(1)), (8, day(8))]), "c": ("server_wins", [(1, day(7))])}


def test_a_reading_of_another_book_is_no_misreading(spark):
    rows = [(b, f"{b}{k}", f"p{k}", n, 0.9, "clean", "OK") for b, ns in ((1, ["1717"] * 3 + ["1716", "1999", ""]), (2, ["1716"] * 3)) for k, n in enumerate(ns)]
    pages = spark.createDataFrame(rows, "book int, log string, page string, number string, confidence double, quality string, status string")
    none = spark.createDataFrame([], "book int, stored string")
    run = lambda reg, **kw: {(r.book, r.page): (r.value, r.new_status, r.method, r.conflict) for r in registrations.correct_by_book(pages, "book", "log", "page", "number", "confidence", "quality", "status", reg, **kw).collect()}
    got = run(none)
    assert got[1, "p3"] == ("1717", "WARNING", "digit_vote", True)  # book 2 claims it
    assert got[1, "p4"] == ("1717", "WARNING", "digit_vote", True)  # three digits apart
    assert got[1, "p5"] == ("1717", "OK", "digit_vote", False)
    fleet = spark.createDataFrame([("1717",), ("1716",)], "number string")
    assert run(none, fleet=fleet)[1, "p4"] == ("1717", "WARNING", "digit_vote", False)  # no number of the fleet
    against = run(spark.createDataFrame([(1, "1234")], "book int, stored string"))
    assert {v[3] for k, v in against.items() if k[0] == 1} == {True} and against[1, "p0"][:2] == ("1717", "WARNING")


def test_readings_snap_to_the_fleet(spark):
    pages = spark.createDataFrame([(1, "1777", "HP 17l7"), (2, "1717", "x"), (3, "", "9999"), (4, "1234", "")], "k int, value string, reading string")
    fleet = spark.createDataFrame([("1717",), ("1522",)], "number string")
    got = {r.k: (r.snapped, r.snap_cost) for r in registrations.snap_to_fleet(pages, "value", "reading", fleet, "number").collect()}
    assert got == {1: ("1717", 3), 2: ("1717", None), 3: ("", None), 4: ("1234", None)}


def test_the_runs_year_is_adopted_where_a_page_read_it(spark):
    df = spark.createDataFrame([(1, 2020, [2024]), (2, 2020, [2019]), (3, 2020, []), (3, 2020, [2024]), (4, 2023, [2024]), (5, None, [2024])], "book int, year int, alts array<int>")
    run = spark.createDataFrame([(2024,)], "year int")
    got = sorted((r.book, r.adopted, r.method) for r in groups.adopt_run_value(df, "book", "year", "alts", run).where("year IS NOT NULL").collect())
    assert got == [(1, 2024, "adopted"), (2, 2020, "review"), (3, 2020, "kept"), (3, 2020, "kept"), (4, 2023, "kept")]
    assert groups.adopt_run_value(df, "book", "year", "alts", run.where("false")).where("method = 'kept'").count() == 6


def test_queries_for_numbers(spark):
    df = spark.createDataFrame([("0012345",), ("0012346",), (None,)], "n string")
    count = lambda text: df.where(jobs.number_query(text)(F.col("n"))).count()
    assert [count(x) for x in (" 0012345 ", "bit: 1234", "Bitácora:345", "BITACORA : 6", "bit:0012346")] == [1, 2, 1, 1, 1]
    assert [jobs.number_query(x) for x in (" 345", "", "bit:", "bit: 12345678", "12345678")] == [None] * 5


def test_places_among_all_reports(spark):
    rows = [("b", 2), ("b", 1), (None, 5), (None, 4), ("a", 9), ("c", 1)]
    df = spark.createDataFrame(rows, "report string, n int")
    got = {(r.report, r.n): r.position for r in jobs.global_positions(df, "report", ["n"]).collect()}
    assert got == {(None, 4): 1, (None, 5): 2, ("a", 9): 3, ("b", 1): 4, ("b", 2): 5, ("c", 1): 6}


def test_groups_without_a_key_are_groups(spark):
    df = spark.createDataFrame([(None, "12", 3), (None, "12", 1), (None, "13", 1), ("x", "40", 2)], "k string, number string, w int")
    assert {(r.k, r.winner, r.support) for r in groups.digit_vote(df, "k", "number", "w", 2).collect()} == {(None, "12", 2), ("x", "40", 1)}
    assert [tuple(r) for r in groups.consensus(df, ["k"], "number").select("k", "number", "votes").collect()] == [(None, "12", 2)]


def test_pages_of_registrations_move_once(spark, tmp_path):
    rows = [(k, k * 7 % 40, k % 9, 1 + k % 6, float(k % 50)) for k in range(400)]
    spark.createDataFrame(rows + rows[:50], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.QUERIES["registration_pass"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<l_orderkey") == 1 and plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(log" not in plan
    got = df.collect()
    assert len(got) == len({(r.log, r.page) for r in got}) == 400
