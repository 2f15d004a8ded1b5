"""Each step of the date pass against a plain version, over many random books at once."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.operators import datepass

SCHEMA = "book int, number long, page int, blank boolean, aligned boolean, " + ", ".join(f"{p} int, {p}_ok boolean, {p}_alts array<int>" for p in ("day", "month", "year")) + ", strength double"
KEYS = ["book"]
N = 400


def make_books(seed):
    rng = random.Random(seed)
    books = {}
    for b in range(N):
        rows = []
        for page in range(rng.randint(1, 9)):
            part = lambda values, p=0.75: (rng.choice(values) if rng.random() < p else None)
            month, year = part([4, 4, 4, 5, 5, 3]), part([2020, 2020, 2020, 2021, 2019, 2024])
            rows.append({
                "book": b, "number": None if rng.random() < 0.05 else 100 + rng.choice([page, page, page + 1, page * 3]), "page": page, "blank": rng.random() < 0.05, "aligned": rng.random() < 0.9, "day": part(list(range(1, 29)) + [7, 8, 9] * 3), "day_ok": rng.random() < 0.8, "day_alts": [],
                "month": month, "month_ok": month is not None and rng.random() < 0.8, "month_alts": rng.sample([3, 4, 5, 6], 2) if rng.random() < 0.4 else [], "year": year, "year_ok": year is not None and rng.random() < 0.8, "year_alts": [], "strength": 0.5,
            })
        books[b] = rows
    return books


@pytest.fixture(scope="module")
def books():
    return make_books(5)


def frame(spark, books):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for rows in books.values() for r in rows], SCHEMA)
    return df.withColumns({f"{p}_how": F.when(F.col(p).isNotNull(), "read").otherwise("none") for p in datepass.PARTS})


def parts(df, part):
    return {(r.book, r.page): (r[part], r[f"{part}_how"]) for r in df.collect()}


def ordered(rows, blanks=False):
    return sorted((r for r in rows if r["number"] is not None and (blanks or not r["blank"])), key=lambda r: (r["number"], r["page"]))


def check(books, got, part, plain):
    for b, rows in books.items():
        want = {r["page"]: (r[part], "read" if r[part] is not None else "none") for r in rows} | plain(rows)
        assert {r["page"]: got[b, r["page"]] for r in rows} == want, rows


def plain_consensus(rows):
    seen = [r for r in ordered(rows) if r["year"] is not None]
    ranked = Counter(r["year"] for r in seen).most_common()
    if len(seen) < 3 or ranked[0][1] < 2 or (len(ranked) > 1 and ranked[1][1] == ranked[0][1]) or ranked[0][1] / len(seen) < 0.6:
        return {}
    major = ranked[0][0]
    at = [k for k, r in enumerate(seen) if r["year"] == major]
    keeps = lambda k, y: y == major or (y - major == -1 and k < at[0]) or (y - major == 1 and k > at[-1])
    return {r["page"]: (major, "consensus") for k, r in enumerate(seen) if not keeps(k, r["year"])}


def test_year_consensus(spark, books):
    check(books, parts(datepass.year_consensus(frame(spark, books), KEYS), "year"), "year", plain_consensus)


def date_of(r, month=None):
    try:
        return datetime.date(r["year"], month or r["month"], r["day"])
    except (TypeError, ValueError):
        return None


def plain_ambiguous(rows):
    trusted = [r for r in ordered(rows) if r["aligned"] and r["day_ok"] and r["month_ok"] and r["year_ok"] and date_of(r)]
    out = {}
    for r in ordered(rows):
        left, right = [t for t in trusted if t["number"] < r["number"]], [t for t in trusted if t["number"] > r["number"]]
        if r["month"] is None and len(r["month_alts"]) > 1 and r["aligned"] and r["day_ok"] and r["year_ok"] and left and right:
            fits = {m for m in r["month_alts"] if (d := date_of(r, m)) and date_of(left[-1]) <= d <= date_of(right[0])}
            if len(fits) == 1:
                out[r["page"]] = (fits.pop(), "candidates")
    return out


def test_ambiguous_months(spark, books):
    check(books, parts(datepass.ambiguous_months(frame(spark, books), KEYS), "month"), "month", plain_ambiguous)


def plain_bracket(rows):
    seen, ok, out = [r for r in ordered(rows) if r["month"] is not None], {}, {}
    ok = {r["page"]: r["month_ok"] and r["aligned"] for r in seen}
    for a, r, b in zip(seen, seen[1:], seen[2:], strict=False):
        years = {x["year"] for x in (a, r, b)} - {None}
        if ok[a["page"]] and ok[b["page"]] and a["month"] == b["month"] != r["month"] and len(years) < 2:
            out[r["page"]] = (a["month"], "bracket")
            ok[r["page"]] = False
    return out


def test_bracketed_months(spark, books):
    check(books, parts(datepass.bracketed_months(frame(spark, books), KEYS), "month"), "month", plain_bracket)


def anchors(rows, part):
    return [r for r in ordered(rows, True) if r[f"{part}_ok"] and r["aligned"] and r[part] is not None]


def plain_between(part):
    def plain(rows):
        known, out = anchors(rows, part), {}
        for r in ordered(rows, True):
            left, right = [a for a in known if a["number"] < r["number"]], [a for a in known if a["number"] > r["number"]]
            if not r["aligned"] or not left or not right or left[-1][part] != right[0][part] or (part == "month" and left[-1]["year"] != right[0]["year"]):
                continue
            inner = [a for a in known if a["number"] == r["number"] and a is not r]
            if all(a[part] == left[-1][part] for a in inner) and r[part] != left[-1][part]:
                out[r["page"]] = (left[-1][part], "interval")
        return out

    return plain


@pytest.mark.parametrize("part", ["month", "year"])
def test_between_anchors(spark, books, part):
    check(books, parts(datepass.between_anchors(frame(spark, books), KEYS, part), part), part, plain_between(part))


def plain_beyond(part):
    def plain(rows):
        known, out = anchors(rows, part), {}
        if len(known) < 2:
            return out
        for pair, before in ((known[:2], True), (known[-2:], False)):
            edge = pair[0] if before else pair[1]
            for r in ordered(rows, True) if pair[0][part] == pair[1][part] else []:
                gap = (edge["number"] - r["number"]) * (1 if before else -1)
                if not r["aligned"] or not 0 < gap <= 10:
                    continue
                sign = 1 if before else -1
                if part == "year":
                    wrong = r["year"] is not None and (abs(r["year"] - edge["year"]) > 1 or (r["year"] - edge["year"]) * sign > 0)
                else:
                    wrong = None not in (r["month"], r["year"], edge["year"]) and (((r["year"], r["month"]) > (edge["year"], edge["month"])) if before else ((r["year"], r["month"]) < (edge["year"], edge["month"])))
                if r[part] is None or wrong:
                    out[r["page"]] = (edge[part], "edge")
        return out

    return plain


@pytest.mark.parametrize("part", ["month", "year"])
def test_beyond_anchors(spark, books, part):
    check(books, parts(datepass.beyond_anchors(frame(spark, books), KEYS, part), part), part, plain_beyond(part))


def plain_sole(rows):
    values = [a["month"] for a in anchors(rows, "month")]
    return {r["page"]: (values[0], "book") for r in rows if not r["blank"] and r["month"] is None} if len(values) > 1 and len(set(values)) == 1 else {}


def test_sole_values(spark, books):
    df = frame(spark, books)
    check(books, parts(datepass.fill_sole(df, KEYS, "month", datepass.sole_anchor_value(df, KEYS, "month")), "month"), "month", plain_sole)


def plain_tens(rows):
    dated, out = [r for r in ordered(rows) if date_of(r)], {}
    for k, r in enumerate(dated):
        month = (r["year"], r["month"])
        near = [(x["day"] if x and (x["year"], x["month"]) == month else None) for x in (dated[k - 1] if k else None, dated[k + 1] if k + 1 < len(dated) else None)]
        days = [d for d in near if d is not None]
        if r["day"] >= 10 or not days:
            continue
        gap = lambda v: min(abs(v - d) for d in days)
        last = (datetime.date(month[0] + month[1] // 12, month[1] % 12 + 1, 1) - datetime.timedelta(1)).day
        fits = [v for v in (r["day"] + t for t in (10, 20, 30)) if (near[0] or 1) <= v <= (near[1] if near[1] is not None else last) and gap(v) < gap(r["day"])]
        if gap(r["day"]) > 7 and fits:
            out[r["page"]] = (min(fits, key=gap), "tens")
    return out


def test_lost_tens(spark, books):
    check(books, parts(datepass.lost_tens(frame(spark, books), KEYS), "day"), "day", plain_tens)


def test_the_whole_pass(spark):
    books = {b: rows for b, rows in make_books(9).items() if b < 120}
    for rows in books.values():
        for r in rows:
            r["page"], r["day_alts"] = r["page"], [r["page"] + 10]
    as_of = F.to_date(F.lit("2021-04-20"))
    df = frame(spark, books).drop("day_how", "month_how", "year_how")
    registry = spark.createDataFrame([(b, 100, datetime.date(2020, 4, 1), 120, datetime.date(2020, 4, 30)) for b in range(0, 120, 3)], "book int, first_number long, first_date date, last_number long, last_date date")
    got = datepass.date_pass(df, KEYS, as_of, registry=registry).collect()
    assert len(got) == sum(map(len, books.values()))
    for r in got:
        if r.date:
            assert r.date <= datetime.date(2021, 4, 20) or r.day_how == "month_end"
        assert r.unresolved == (r.date is None and not r.blank)
    read = {(r.book, r.page): r for r in got}
    fixed = [r for r in got if r.date and not date_of(next(x for x in books[r.book] if x["page"] == r.page))]
    assert len(fixed) > 50
    assert datepass.date_pass(df.where("false"), KEYS, as_of).count() == 0
    assert {h for r in read.values() for h in (r.day_how, r.month_how, r.year_how)} >= {"read", "consensus", "interval", "edge", "book", "month_end"}
