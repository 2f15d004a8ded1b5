import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.operators import groups, joins, order, status
from pagewright.sources import csv_runs, json_runs
from pagewright.streaming import incremental


def test_null_keys_are_no_duplicates(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, o int")
    got = {r.o: (r.is_duplicate, r.is_first) for r in groups.flag_duplicates(df, ["k"], ["o"]).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, True), 4: (True, False), 5: (False, True)}


def test_purge_spares_a_row_that_is_not_blank(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False)], "k string, o int, blank boolean")
    got = groups.survivors(df, ["k"], ["o"], F.col("k") == "a", F.col("blank")).collect()
    assert sorted(r.o for r in got) == [2, 3]


@pytest.mark.parametrize(("k", "want"), [(1, [0]), (3, [0, 4, 9]), (20, list(range(10)))])
def test_spread_sample(spark, k, want):
    df = spark.range(10).withColumn("g", F.lit(1))
    assert sorted(r.id for r in order.spread_sample(df, ["g"], ["id"], k).collect()) == want


def test_asof_prefers_the_later_on_ties(spark):
    day = lambda n: datetime.date(2025, 1, n)
    df = spark.createDataFrame([("b", 1, None), ("b", 2, day(2)), ("b", 4, None), ("b", 6, day(6)), ("b", 7, None), ("c", 1, None), ("b", 6, None)], "b string, n int, d date")
    got = {(r.b, r.n, r.d): (r.dated, r.method) for r in joins.asof_nearest(df, ["b"], "n", "d").collect()}
    assert got["b", 1, None] == (day(2), "between")
    assert got["b", 4, None] == (day(6), "between")
    assert got["b", 7, None] == (day(31), "month_end")
    assert got["b", 6, None] == (day(6), "same_number")
    assert got["c", 1, None] == (None, "none")


def test_sort_keys(spark):
    df = spark.createDataFrame([(1, "b"), (2, "10"), (3, ""), (4, "9"), (5, "A"), (6, None), (7, "inf")], "id int, t string").withColumn("g", F.lit(1))
    place = lambda **a: [r.id for r in order.numeric_text_rank(df, ["g"], "t", "id", **a).orderBy("place").collect()]
    assert place() == [4, 2, 5, 1, 7, 3, 6]
    assert place(descending=True) == [7, 1, 5, 2, 4, 3, 6]


def test_status_without_fields(spark):
    df = spark.createDataFrame([([],)], "fields array<struct<field_id:string,value:string,status:string>>")
    assert df.select(status.page_status("fields", F.lit(False), F.lit(False), F.lit("KEEP"))).first()[0] == "KEEP"
    assert df.select(status.by_priority(F.array(F.lit("b"), F.lit("c")), ["a", "c", "b"]), status.reason(F.lit("Disk FULL"), {"full": "space", "disk": "drive"}, "other")).first()[:] == ("c", "space")


def test_status_by_what_a_page_has(spark):
    kind = "array<struct<field_id:string,value:string,status:string>>"
    cases = [
        ([("note", "x", "OK")], None, "OK"), ([("note", "x", "ERROR")], None, "WARNING"), ([("log_number", " 1234567 ", "OK")], None, "OK"), ([("log_number", "123", "OK")], None, "ERROR"),
        ([("day", "3", "OK"), ("month", "jan ", "OK"), ("year", "2024", "OK")], None, "OK"), ([("day", "33", "OK"), ("month", "1", "OK")], None, "ERROR"), ([("day", None, "OK")], "2024/01/02", "OK"),
        ([("log_number", "1234567", "OK"), ("day", "33", "OK")], None, "WARNING"), ([("log_number", "1234567", "OK"), ("x_signature", "", "ERROR"), ("day_1", "", "ERROR")], None, "OK"),
    ]
    df = spark.createDataFrame([(k, f, d) for k, (f, d, _) in enumerate(cases)], f"k int, fields {kind}, date string")
    got = df.select("k", status.page_status("fields", F.lit(False), F.lit(False), F.lit("KEEP"), F.col("date")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [s for _, _, s in cases]


def test_rules_in_order(spark):
    rule = F.struct(F.col("need").alias("required"), F.lit("Brand#1").alias("regex"), F.lit(1).alias("min_length"), F.lit(20).alias("max_length"))
    rows = [("Brand#12xyz", True, 1.0, False, "regex"), (" \t", True, 1.0, False, "required"), (None, False, 1.0, False, "optional_empty"), ("Brand#1", True, 0.1, False, "low_confidence"), ("Brand#1", True, 0.1, True, None), ("Brand#1\n", True, 1.0, False, "regex")]
    df = spark.createDataFrame([r[:4] for r in rows], "v string, need boolean, c double, s boolean")
    broken = status.first_failed_rule(F.col("v"), rule, F.col("c"), 0.3, F.col("s"))
    assert [r[0] for r in df.select(broken).collect()] == [r[4] for r in rows]
    assert [r[0] for r in df.select(status.rule_status(broken)).collect()] == ["ERROR", "ERROR", "WARNING", "WARNING", "OK", "ERROR"]


def test_csv_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", "1", "", "ñ"), ("b.pdf", "2", "x", "y")], "file string, page string, log_number string, discrepancia string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("﻿file,page,log_number,discrepancia\na.pdf,1,,ñ\nb.pdf,2,x,y\n", encoding="utf-8")
    got = csv_runs.read_run(spark, f"{tmp_path}/in/a.csv")
    assert got.columns == ["file", "page", "log_number", "disc_reason"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    csv_runs.write_run(got, f"{tmp_path}/out", one_file=True)
    assert sorted(map(tuple, csv_runs.read_run(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, rows.collect()))
    for name in ("r_completo.csv", "r.csv", "s.csv"):
        (tmp_path / "in" / name).write_text("file,page\n")
    assert {r.path.rsplit("/", 1)[-1] for r in csv_runs.preferred_files(spark, f"{tmp_path}/in").collect()} == {"a.csv", "r_completo.csv", "s.csv"}
    assert csv_runs.minimal_columns(csv_runs.wide_columns(["log_number", "sig"], ["sig"])) == ["file", "page", "log_number", "review", "dup", "disc", "disc_reason", "sig", "date", "time_ms"]
    assert csv_runs.column_field("a_conf", ["a", "a_conf"]) == "a"
    assert csv_runs.wide_columns(["day", "log_number"])[:4] == ["file", "page", "day", "day_conf"] and csv_runs.wide_columns(["day"])[-6:] == ["review", "dup", "disc", "disc_reason", "date", "time_ms"]
    assert [csv_runs.column_field(c, ["a", "a_conf", "b_conf", "date"]) for c in ("a_conf", "b_conf", "date", "page")] == ["a", "b_conf", None, None]
    columns = csv_runs.wide_columns(["log_number", "day", "note", "captain_signature"])
    assert csv_runs.important_fields(columns) == ["log_number", "captain_signature"]
    assert csv_runs.important_fields([c for c in columns if c != "date"]) == ["log_number", "day", "captain_signature"]
    assert csv_runs.important_columns(columns, ["day", "note"]) == ["file", "page", "review", "dup", "disc", "disc_reason", "note", "date", "time_ms"]
    assert csv_runs.template_fields(["date", "note_conf"], ["note", "month", "year", "other"], columns) == ["note", "month", "year"]
    assert [csv_runs.parse_range(x, 10) for x in ("3", "2-5", "7-", "-4", "9-99", "3:5", " 2 – 4 ", "-", "50-60", "12")] == [(3, 3), (2, 5), (7, 10), (1, 4), (9, 10), (3, 5), (2, 4), (1, 10), (50, 10), (12, 10)]
    assert csv_runs.parse_range("2-3", 0) == (1, 0)
    for text in ("5-2", "", " ", "0", "1-0", "x", "1-2-3", "-1-2"):
        with pytest.raises(ValueError):
            csv_runs.parse_range(text, 10)


def test_json_registries(spark):
    df = spark.createDataFrame([('{"70412B":{"61":"2024-03-09","88":"2024-04-17"},"70412A":{"61":"2024-03-09"},"3A":{"7":"2999-01-01"},"4A":{"2":"2024-08-08","6":"2024-07-07"}}',), ("broken",)], "j string")
    got = json_runs.date_registry_rows(df, "j", F.to_date(F.lit("2026-01-01"))).collect()
    assert [(r.book, r.number) for r in got] == [("70412B", 61), ("70412B", 88)]
    index = spark.createDataFrame([('{"pdf":"a","paginas":[3,1]}',), ('{"partes":[{"pdf":"b","paginas":[2]}]}',)], "j string")
    assert sorted((r.pdf, r.place, r.page) for r in json_runs.page_index(index, "j").collect()) == [("a", 0, 3), ("a", 1, 1), ("b", 0, 2)]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k": 1, "at": "2025-01-01T00:00:00Z"}\n{"k": 1, "at": "2025-01-01T00:01:00Z"}\n{"k": 2, "at": "2025-01-01T00:02:00Z"}\n')
    rows = incremental.arriving(spark, f"{tmp_path}/in", "k int, at timestamp")
    run = incremental.first_copies(rows, ["k"], "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]
    counts = incremental.progress(rows, "at", ["k"]).writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {(r.k, r.n_rows) for r in spark.table("counts").collect()} == {(1, 2), (2, 1)}
