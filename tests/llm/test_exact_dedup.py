import hashlib
import os
from collections import defaultdict

import numpy as np

from pagewright.llm import exact_dedup
from pagewright.llm.exact_dedup import dedup_verdicts, drop_duplicates
from tests.llm.conftest import SMALL


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def test_verdicts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in dedup_verdicts(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        keep, n = want[text or ""]
        assert (got[doc_id].keep_id, got[doc_id].group_size, got[doc_id].kept) == (keep, n, doc_id == keep)
        assert got[doc_id].text_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows(docs, no_docs):
    got = dedup_verdicts(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in v) == 1 for v in by.values())
    assert {r.keep_id for r in got if r.doc_id in (1, 2, None)} == {2}
    assert {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 8, 9]
    assert dedup_verdicts(no_docs).count() == drop_duplicates(no_docs).count() == 0


def test_hash_ranges_change_nothing(docs):
    assert (exact_dedup.ranges(9, 32), exact_dedup.ranges(0, 32), exact_dedup.ranges(10**9)) == (3, 1, 60)
    few = sorted(map(str, dedup_verdicts(docs, max_cells=32).select("doc_id", "keep_id", "group_size").collect()))
    assert few == sorted(map(str, dedup_verdicts(docs).select("doc_id", "keep_id", "group_size").collect()))
    kept = drop_duplicates(docs, max_cells=32)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 8, 9]


def test_bit_arrays_count_to_two():
    rng = np.random.default_rng(2)
    once, twice, seen = np.zeros(32, np.uint8), np.zeros(32, np.uint8), np.zeros(256, int)
    for _ in range(6):
        cells = rng.integers(0, 256, 40)
        exact_dedup.add(once, twice, cells)
        np.add.at(seen, cells, 1)
        assert (np.unpackbits(once) == (seen > 0)).all() and (np.unpackbits(twice) == (seen > 1)).all()


def test_the_filter_has_no_false_negatives():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    seen = list(exact_dedup._count(1 << 16, 4)(iter([_batch(np.concatenate((h, h[:50])))])))
    merged = exact_dedup._merge(_frame(seen))
    bits = np.frombuffer(merged["twice"][0], np.uint8)
    for own in exact_dedup.cells_of(h[:50], 1 << 16):
        assert ((bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1).all()


def _batch(h):
    import pyarrow as pa

    at = pa.array(np.zeros(len(h), np.int32))
    return pa.RecordBatch.from_arrays([at, at, pa.array(h)], names=["part", "piece", "h"])


def _frame(batches):
    import pyarrow as pa

    return pa.Table.from_batches(batches).to_pandas()


def test_many_ranges_and_a_hot_text_in_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PIECE", 100)  # a third of all rows share a text: its range has many pieces
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' WHEN id % 50 < 2 THEN concat('t', id DIV 50) ELSE concat('own', id) END AS text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(max(d for d, t in rows if t == text) for text in {t for _, t in rows})
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for cells in (1 << 20, 1600, 400):
        spark.sparkContext.setJobGroup(f"ranges-{cells}", "")
        got = dedup_verdicts(docs, max_cells=cells)
        assert sorted(r.doc_id for r in got.where("kept").collect()) == want
        jobs.append(len(tracker.getJobIdsForGroup(f"ranges-{cells}")))
        assert sorted(r.doc_id for r in drop_duplicates(docs, max_cells=cells).collect()) == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert exact_dedup.ranges(3000, 1600) == 15 and exact_dedup.ranges(3000, 400) == 60 and jobs[1] == jobs[2]


def test_failures_and_threads_leave_no_tables_of_their_own(spark):
    import threading

    from pagewright.llm.shared import only_last, written

    place = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    made, ready, go = {}, threading.Event(), threading.Event()

    def other():
        with only_last(spark):
            made["a"] = place(written(spark.range(3), "test"))
            ready.set()
            go.wait(60)
            made["b"] = place(written(spark.range(4), "test"))

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    try:
        with only_last(spark):
            made["c"] = place(written(spark.range(5), "test"))
            raise KeyError
    except KeyError:
        pass
    assert os.path.exists(made["a"]) and not os.path.exists(made["c"])
    go.set()
    thread.join(60)
    assert not os.path.exists(made["a"]) and os.path.exists(made["b"])
    with only_last(spark):
        with only_last(spark):
            made["d"] = place(written(spark.range(1), "test"))
        made["e"] = place(written(spark.range(2), "test"))
    assert not os.path.exists(made["d"]) and os.path.exists(made["e"])


def test_only_the_last_table_stays(spark):
    from pagewright.llm.shared import only_last, written

    with only_last(spark):
        first = written(spark.range(5), "test")
        second = written(first.selectExpr("id + 1 AS id"), "test")
    assert second.count() == 5
    place = first.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert not os.path.exists(place)
