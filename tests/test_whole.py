"""Queries and operators over whole tables."""

from pyspark.sql import functions as F

from pagewright.plans.catalogue import QUERIES
from pagewright.sources import json_runs


def test_reports_of_all_orders_are_counted(spark, tmp_path):
    rows = [(k, 1, k % 5, "R" if k % 2 else "N", 1.0) for k in range(300, 500)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["consolidated_reports"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("N", 100, 5, 100), ("R", 100, 5, 100)]


def test_each_report_is_a_row(spark):
    pages = spark.createDataFrame([("r", "a", 2), ("r", "a", 1), ("r", "b", 3), (None, "a", 4)], "run string, pdf string, n int")
    got = json_runs.consolidated(pages, "run", "pdf", ["n"], [])
    assert {(r.run, r.pdf_path): (r.total_bitacoras, r.json) for r in got.collect()} == {
        ("r", "a"): (3, '{"pdf_path":"a","pages":[{"n":1},{"n":2}]}'),
        ("r", "b"): (3, '{"pdf_path":"b","pages":[{"n":3}]}'),
        (None, "a"): (1, '{"pdf_path":"a","pages":[{"n":4}]}'),
    }


def test_files_beyond_the_200th_are_sliced(spark, tmp_path):
    spark.range(1, 251).select(F.col("id").alias("l_suppkey"), F.explode(F.sequence(F.lit(1), F.lit(2)))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_suppkey: (r.n, r.page_from, r.page_to) for r in QUERIES["page_slices"](spark, str(tmp_path)).collect()}
    assert got == {50: (2, 2, 2)} | {k: (2, 1, 2) for k in range(51, 251)}


def test_years_around_2000_are_read(spark, tmp_path):
    days = ["1998-12-31", "1999-01-02", "2000-02-29", "2001-08-01"]
    spark.createDataFrame(list(enumerate(days)), "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.named, r.numbered, r.day, r.year) for r in QUERIES["handwritten_dates"](spark, str(tmp_path)).collect()}
    assert got == {0: (12, 12, "31", "98"), 1: (1, 1, "02", "99"), 2: (2, 2, "29", "00"), 3: (8, 8, "01", "01")}


def test_all_matches_are_returned(spark, tmp_path):
    rows = [(k, "x", "a", "made") for k in range(100)] + [(200, "xde", "de", ""), (201, " DE ", "a", ""), (202, None, "a", "de\n"), (203, "x", None, "none")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["text_search_matches"](spark, str(tmp_path)).collect()]
    assert got == [(201, 0, "lang"), (202, 0, "text"), *[(k, 1, "text") for k in range(100)], (200, 1, "lang")]
