import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import fuzzy
from pagewright.operators import order, sequences
from pagewright.operators.sequences import FAR, UNSEEN, best_dates, fill_gaps, gaps_that_fit, next_fit, repair_days


@pytest.mark.parametrize("seed", range(20))
def test_repair_days_is_the_cheapest(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 5)
    months = sorted(rng.choice([0, 0, 6]) for _ in range(n))
    days, strengths = [rng.randint(1, 6) for _ in range(n)], [rng.choice([300_000, 600_000, 1_900_000]) for _ in range(n)]
    named = [rng.sample(range(1, 8), 2) for _ in range(n)]
    cost = lambda path: sum(0 if p == d else s + FAR * abs(p - d) + (0 if p in own else UNSEEN) for p, d, s, own in zip(path, days, strengths, named, strict=True))
    rising = [p for p in itertools.product(range(1, 7), repeat=n) if all(a + x <= b + y for a, x, b, y in zip(months, p, months[1:], p[1:], strict=False))]
    got = repair_days(days, months, [6] * n, strengths, named)
    assert tuple(got) in rising and cost(got) == min(map(cost, rising))


def test_repair_days_keeps_what_rises_over_months():
    assert repair_days([30, 1, 2], [0, 31, 59], [31, 28, 31], [10**6] * 3, [[]] * 3) == [30, 1, 2]
    assert repair_days([18, 8, 19], [0] * 3, [31] * 3, [10**6, 10**5, 10**6], [[], [18], []]) == [18, 18, 19]
    assert repair_days([5, 9], [59, 31], [31, 28], [10**6] * 2, [[]] * 2) == [5, 9]  # a month back begins anew
    assert repair_days([], [], [], [], []) == []


def plain_best(options, changes, outside):
    cost = lambda p: (sum(o[k] for o, k in zip(outside, p, strict=True)), sum(b[j] < a[i] for a, i, b, j in zip(options, p, options[1:], p[1:], strict=False)), sum(c[k] for c, k in zip(changes, p, strict=True)), sum(abs(b[j] - a[i]) for a, i, b, j in zip(options, p, options[1:], p[1:], strict=False)))
    read = cost([0] * len(options))
    best = min(cost(p) for p in itertools.product(*[range(len(o)) for o in options]))
    return (read if not read[1] or best[1] >= read[1] or best[:2] >= read[:2] else best), cost


@pytest.mark.parametrize("seed", range(30))
def test_best_dates(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 5)
    options = [rng.sample(range(30), rng.randint(1, 3)) for _ in range(n)]
    changes = [[0, *(rng.randint(1, 3) for _ in o[1:])] for o in options]
    outside = [[rng.choice([0, 0, 1]) for _ in o] for o in options]
    best, cost = plain_best(options, changes, outside)
    assert cost(best_dates(options, changes, outside)) == best


def test_best_dates_leaves_what_rises():
    assert best_dates([[10, 9], [12, 11]], [[0, 1]] * 2, [[5, 0]] * 2) == [0, 0]
    assert best_dates([[10], [30, 12], [15]], [[0], [0, 1], [0]], [[0], [0, 0], [0]]) == [0, 1, 0]
    assert best_dates([[10], [30, 12], [15]], [[0], [0, 1], [0]], [[0], [0, 2], [0]]) == [0, 0, 0]  # not at the price of a far year
    assert best_dates([], [], []) == [] and best_dates([[3, 1]], [[0, 1]], [[0, 0]]) == [0]


def test_gaps_that_fit():
    no = [False] * 9
    gap = lambda numbers, pages=None, blank=no, fields=[True] * 9: gaps_that_fit(pages or range(len(numbers)), numbers, blank[: len(numbers)], fields[: len(numbers)])
    assert gap([100, None, None, 103]) == [None, [0, 100, 101], [0, 100, 102], None]
    assert gap([100, None, 103]) == gap([149, None, 151]) == [None] * 3
    assert gap([100, None, 102], [1, 2, 4]) == [None] * 3
    assert gap([100, None, None, 102], blank=[False, True, False, False]) == [None, None, [0, 100, 101], None]
    assert gap([None, 5, None]) == [None] * 3
    assert gap([100, None, None, 103], fields=[True, False, True, True]) == [None] * 4  # a page without the field ends the run
    assert gap([100, None, 102, None, 104], fields=[True, False, True, True, True]) == [None, None, None, [2, 102, 103], None]


def plainly_agrees(reading, number):
    digits = "".join(c for c in reading or "" if c in "0123456789")
    return len(digits) < 4 or difflib.SequenceMatcher(None, digits, f"{number:07d}").ratio() >= 0.6


def test_readings_that_contradict(spark):
    rng = random.Random(6)
    rows = [("0101", 101), ("x", 101), (None, 101), ("9999", 101), ("", 5), ("0000000000000101", 101), ("1212121", 2121212)]
    for _ in range(1500):
        number = rng.choice([rng.randrange(10**7), int("".join(rng.choice("12") for _ in range(7)))])
        digits = [c if rng.random() < 0.7 else rng.choice("0123456789x ") for c in f"{number:07d}"]
        rng.random() < 0.4 and digits.insert(rng.randrange(8), rng.choice("0129"))
        rng.random() < 0.4 and digits.pop(rng.randrange(len(digits)))
        rows.append(("".join(digits), number))
    got = spark.createDataFrame(rows, "r string, n long").select("r", "n", fuzzy.agrees_with("r", "n").alias("ok")).collect()
    assert [(r.r, r.n, r.ok) for r in got] == [(r, n, plainly_agrees(r, n)) for r, n in rows]


def test_gaps_are_filled_once_and_never_with_known_numbers(spark):
    rows = [("a", 1, 100, None, False), ("a", 2, None, "101", False), ("a", 3, 102, None, False), ("a", 4, None, "9999", False), ("a", 5, 104, None, False)]
    rows += [("b", 1, 100, None, False), ("b", 2, None, None, False), ("b", 3, 102, None, False), ("c", 1, 104, None, False), ("c", 2, None, None, False), ("c", 3, 106, None, False), ("d", 1, 105, None, False)]
    df = spark.createDataFrame(rows, "file string, page int, number long, reading string, blank boolean")
    got = {(r.file, r.page): r.filled for r in fill_gaps(df, ["file"], "page", "number", "reading", "blank").collect()}
    assert len(got) == len(rows)
    assert (got["a", 2], got["a", 4], got["b", 2], got["c", 2]) == (101, None, None, None)


def plain_month_ends(months, days):
    """Row by row: what is filled counts for the rows after it."""
    known, out = [(m, d) if m and d else None for m, d in zip(months, days, strict=True)], list(days)
    for k, (m, d) in enumerate(zip(months, days, strict=True)):
        if m and not d:
            near = lambda places: next((known[j] for j in places if known[j]), None)
            after, before = near(range(k + 1, len(known))), near(range(k - 1, -1, -1))
            new = min(30, after[1] if after and after[0] == m else 30)
            out[k] = min(30, max(new, before[1] if before and before[0] == m else 0))
            known[k] = (m, out[k])
    return out


def test_days_to_month_end(spark):
    rng = random.Random(4)
    books = {b: ([rng.choice([None, 4, 4, 6, 9]) for _ in range(n)], [rng.choice([None, None, rng.randint(1, 30)]) for _ in range(n)]) for b, n in enumerate(rng.randint(1, 9) for _ in range(300))}
    rows = [(b, k, f"2020-{m:02d}-01" if m else None, d) for b, (ms, ds) in books.items() for k, (m, d) in enumerate(zip(ms, ds, strict=True))]
    df = spark.createDataFrame(rows, "book int, k int, m string, d int").withColumn("m", F.to_date("m"))
    got = {(r.book, r.k): r.filled_day for r in order.fill_days_to_month_end(df, ["book"], ["k"], "m", "d").collect()}
    for b, (ms, ds) in books.items():
        assert [got[b, k] for k in range(len(ms))] == plain_month_ends(ms, ds), (ms, ds)


def test_books_are_cut_out_of_any_batch(spark):
    df = spark.range(1000).selectExpr("id % 37 AS book", "id AS n", "IF(id % 37 = 5, NULL, 'x') AS mark").repartition(3)
    want = {(r.book, r.n): r.n // 37 for r in df.collect()}
    for least in (1, 10, 10_000):
        got = sequences.by_book(df, ["book"], ["n"], ["n"], "place long", lambda n: list(range(len(n))), least)
        assert {(r.book, r.n): r.place for r in got.collect()} == want
    assert sequences.by_book(df.where("false"), ["book"], ["n"], ["n"], "place long", lambda n: n).count() == 0
