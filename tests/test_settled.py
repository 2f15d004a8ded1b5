"""Ledgers, nested searches, arbitration, tilings, bands, thresholds and exact batches on small tables."""

import datetime
import itertools
import json
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagewright.functions import nested, slots
from pagewright.operators import arbitration, evaluate, fullbatches, records, tiling
from pagewright.sources import guarded, manifests
from pagewright.streaming import ledger

START = datetime.datetime(2025, 1, 1)


def plain_ledger(rows, lease):
    """The ledger of (key, id, minute, end) rows by walking each key's attempts in order."""
    out = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2], r[1])), key=lambda r: r[0]):
        sender, held = None, None
        counts = dict(sent=0, rejected=0, held=0, refused=0, expired=0)
        for _, name, at, end in group:
            if held is not None and held <= at:
                counts["expired"] += 1
                held = None
            if sender is not None or held is not None:
                counts["refused"] += 1
            elif end == "ok":
                sender = name
                counts["sent"] += 1
            elif end == "rejected":
                counts["rejected"] += 1
            else:
                held = at + lease
                counts["held"] += 1
        counts["expired"] += held is not None
        out[key] = (sender, *counts.values())
    return out


def test_ledger_of_files_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), 2**60 + k, rng.randrange(300), rng.choice(["ok", "rejected", "unknown", None])) for k in range(60)]
    rows = [(key, name, at, end if key != "a" or rng.random() < 0.2 else "unknown") for key, name, at, end in rows]
    schema = "key string, name long, at timestamp, ended string"
    frame = lambda part: spark.createDataFrame([(k, n, START + datetime.timedelta(minutes=m), e) for k, n, m, e in part], schema)
    order = rows + rows
    rng.shuffle(order)
    for k in range(0, 120, 20):
        frame(order[k : k + 20]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ledger.journal(ledger.archiving(spark, f"{tmp_path}/in", f"{tmp_path}/archive", schema, per_batch=2), ["key"], "at", "name", "ended", late="1 day", lease_seconds=3600)
    ledger.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    closing = [(None, None, START + datetime.timedelta(days=3), None)]
    spark.createDataFrame(closing, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    journal = ledger.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r.key: (r.sender, r.sent, r.rejected, r.held, r.refused, r.expired) for r in ledger.ledger(journal, ["key"]).collect()}
    assert got == plain_ledger(rows, 60)
    said = journal.where("action <> 'expired'").groupBy("attempt").count().collect()
    assert len(said) == 60 and all(r["count"] == 1 for r in said)  # every attempt once, however often it came
    assert any(f.endswith(".parquet") for _, _, files in os.walk(tmp_path / "archive") for f in files)


def test_a_late_attempt_is_left_out(spark, tmp_path):
    schema = "key string, name long, at timestamp, ended string"
    put = lambda *rows: spark.createDataFrame([("k", n, START + datetime.timedelta(minutes=m), "ok") for n, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put((1, 100))
    stream = ledger.journal(ledger.archiving(spark, f"{tmp_path}/in", f"{tmp_path}/archive", schema), ["key"], "at", "name", "ended", late="10 minutes")
    for rows in ([(2, 300)], [(3, 50)], [(4, 900)]):
        ledger.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/c")
        put(*rows)
    got = {(r.attempt, r.action) for r in ledger.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/c").collect()}
    assert got == {(1, "sent"), (2, "refused")}


def test_keys_of_a_ledger_share_states(spark, tmp_path):
    rng = random.Random(5)
    keys = [2**60 + k for k in range(40)] + [None]
    rows = [(rng.choice(keys), k, rng.randrange(300), rng.choice(["ok", "rejected", "unknown"])) for k in range(200)]
    made = [(k, None if n % 2 else "", n, START + datetime.timedelta(minutes=m), e) for k, n, m, e in rows]
    schema = "user long, kind string, name long, at timestamp, ended string"
    for part in (made, made[::-1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ledger.journal(ledger.archiving(spark, f"{tmp_path}/in", f"{tmp_path}/archive", schema, per_batch=1), ["user", "kind"], "at", "name", "ended", late="1 day", lease_seconds=3600, shards=4)
    ledger.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/c").count() <= 4  # not one for each of the 80 keys
    spark.createDataFrame([(None, None, None, START + datetime.timedelta(days=3), None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    journal = ledger.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    got = {str((r.user, r.kind)): (r.sender, r.sent, r.rejected, r.held, r.refused, r.expired) for r in ledger.ledger(journal, ["user", "kind"]).collect()}
    assert got == plain_ledger([(str((k, None if n % 2 else "")), n, m, e) for k, n, m, e in rows], 60)


def plain_innermost(value, wanted, path="$", depth=0):
    """Paths of the smallest objects that hold a text or number, up to six levels down."""

    def leaves(v, d):
        if d > 6 or isinstance(v, bool) or v is None:
            return []
        if isinstance(v, dict | list):
            return [x for y in (v.values() if isinstance(v, dict) else v) for x in leaves(y, d + 1)]
        return [str(v).strip()]

    if depth > 6 or not isinstance(value, dict | list):
        return []
    steps = [(f"{path}.{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{k}]", v) for k, v in enumerate(value)]
    inside = [x for p, v in steps for x in plain_innermost(v, wanted, p, depth + 1)]
    return inside or ([path] if isinstance(value, dict) and wanted and wanted in leaves(value, 0) else [])


def test_innermost_objects(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.random()
        if depth > 8 or kind < 0.3:
            return rng.choice([1, "1", " 1 ", 2, "x", True, None, 11, "2"])
        if kind < 0.6:
            return [made(depth + 1) for _ in range(rng.randrange(3))]
        return {k: made(depth + 1) for k in rng.sample("abc", rng.randrange(1, 4))}

    def chain(n, leaf):
        return leaf if not n else {"a": chain(n - 1, leaf)} if n % 2 else [chain(n - 1, leaf)]

    docs = [{"a": made(0), "b": made(1)} for _ in range(150)] + [chain(n, 1) for n in range(14)] + [{"k": chain(n, "1"), "j": 1} for n in range(14)]
    rows = [(k, json.dumps(d), "1") for k, d in enumerate(docs)] + [(1000, "no json", "1"), (1001, None, "1"), (1002, '{"a":1}', None), (1003, '{"a":""}', " "), (1004, "{}", "1"), (1005, "1", "1")]
    got = nested.innermost_objects(spark.createDataFrame(rows, "k long, doc string, wanted string"), "k", "doc", "wanted")
    want = sorted((k, p) for k, d in enumerate(docs) for p in plain_innermost(d, "1"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_arbitration(spark):
    book = lambda n: F.floor(n / 50)
    own = [("b", 1, 101, "P"), ("b", 2, 102, "P"), ("b", 3, 203, "Q"), ("b", 9, 120, "R"), ("b", 8, 260, None), (None, 1, 101, "P"), ("c", 1, 101, "Q"), ("b", 20, 400, "S"), ("b", 21, 400, "P")]
    other = [("b", 30, 310, "P"), ("b", 31, 360, "P"), ("b", 32, 361, "Q")]
    asked = [("b", 9, "P", 120, 130), ("b", 10, "P", 205, 131), ("b", 11, "P", 140, 205), ("b", 12, "P", 101, 205), ("b", 13, "P", 320, 206), ("b", 14, "P", 365, 900), ("b", 15, None, 120, 130), ("b", 16, "P", None, 130), (None, 4, "P", 110, 210), ("b", 17, "P", 410, 140), ("c", 5, "P", 110, 910)]
    df = spark.createDataFrame(asked, "batch string, page int, plane string, own int, other int")
    kind = "batch string, page int, number int, plane string"
    got = arbitration.arbitrated(df, spark.createDataFrame(own, kind), spark.createDataFrame(other, kind), "batch", "page", "plane", "own", "other", book)
    assert {(r.batch, r.page): (r.verdict, r.why) for r in got.collect()} == {
        ("b", 9): (None, "both"),  # a disputed page doesn't speak for itself
        ("b", 10): ("other", "book"), ("b", 11): ("own", "book"), ("b", 12): (None, "neither"), ("b", 13): ("own", "book"), ("b", 14): (None, "neither"), ("b", 15): (None, "no plane"), ("b", 16): (None, "no number"),
        (None, 4): ("own", "book"), ("b", 17): ("other", "book"), ("c", 5): (None, "neither"),
    }


def plain_tiles(tokens, manifests):
    at, used, out = 0, set(), []
    while at < len(tokens):
        fits = [m for m, t in manifests.items() if m not in used and t and None not in t and tokens[at : at + len(t)] == t]
        if len(fits) != 1:
            return []
        out.append((at, len(manifests[fits[0]]), fits[0]))
        used.add(fits[0])
        at += len(manifests[fits[0]])
    return out if len(out) >= 2 else []


def test_tilings(spark):
    rng = random.Random(5)
    sequences, manifests = {}, {}
    for b in range(120):
        pieces = [[rng.choice("ab") if rng.random() < 0.5 else f"{b}-{rng.randrange(9)}" for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        sequences[b] = sum(pieces, [])
        manifests[b] = {f"m{k}": p if rng.random() < 0.95 else [*p, "z"] for k, p in enumerate(pieces)}
        if rng.random() < 0.3:
            manifests[b]["more"] = rng.choice(pieces)
        if rng.random() < 0.2:
            sequences[b][rng.randrange(len(sequences[b]))] = None
    manifests[0]["null"] = [None]
    seq = spark.createDataFrame([(b, k, t) for b, v in sequences.items() for k, t in enumerate(v)], "b int, place int, token string")
    man = spark.createDataFrame([(b, m, k, t) for b, ms in manifests.items() for m, v in ms.items() for k, t in enumerate(v)], "b int, m string, place int, token string")
    got = sorted(map(tuple, tiling.tiled(seq, man, "b", "place", "token", "m").select("b", "start", "length", "m").collect()))
    want = sorted((b, *x) for b in sequences for x in plain_tiles(sequences[b], manifests[b]))
    assert got == want and len({x[0] for x in want}) > 20
    assert tiling.tiled(seq.where("false"), man, "b", "place", "token", "m").count() == 0


def plain_band(true, false, width):
    true, false = sorted(true), sorted(false)
    if len(true) < 3 or len(false) < 3:
        return None, None, "few"
    widest = None
    for dropped in range(5):
        for t in range(3):
            f = dropped - t
            if not 0 <= f <= 2 or len(true) - t < 3 or len(false) - f < 3:
                continue
            low, high = false[-1 - f], true[t]
            if high > low and high - low >= width:
                return low, high, "wide"
            if high > low and (widest is None or high - low > widest[1] - widest[0]):
                widest = low, high
    return (*widest, "narrow") if widest else (None, None, "overlap")


def test_bands(spark):
    rng = random.Random(2)
    rows = [(k if k else None, rng.randrange(0, 60) + (rng.choice([20, 45, 58, 62, 70]) if label else 0), label) for k in range(80) for label in [rng.choice([True, False, None]) for _ in range(rng.randrange(0, 16))]]
    groups = {}
    for k, score, label in rows:
        if label is not None:
            groups.setdefault(k, ([], []))[0 if label else 1].append(score)
    df = spark.createDataFrame([*rows, (5, None, True)], "k int, score int, label boolean")
    whys = set()
    for width in (4, 14):
        got = {r.k: (r.low, r.high, r.why) for r in evaluate.confident_bands(df, "k", "score", "label", F.lit(width)).collect()}
        assert got == {k: plain_band(*v, width) for k, v in groups.items()}
        whys |= {v[2] for v in got.values()}
    assert whys == {"few", "overlap", "wide", "narrow"}


def test_thresholds_are_the_best_pair(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(12) + 3 * label * rng.randrange(2), label) for k in range(40) for label in [rng.randrange(2) for _ in range(rng.randrange(1, 30))]]
    got = {r.k: tuple(r)[1:] for r in evaluate.best_thresholds(spark.createDataFrame(rows, "k int, score int, label int"), "k", "score", "label", 5, 4, 1).collect()}
    for k in {r[0] for r in rows}:
        own = [(s, y) for g, s, y in rows if g == k]
        grid = sorted({s for s, _ in own})
        best = None
        for p, a in itertools.product(grid, grid):
            if a <= p:
                fp, fa = sum(s >= p and not y for s, y in own), sum(s <= a and s < p and y for s, y in own)
                unsure = sum(a < s < p for s, _ in own)
                if (len(own) - unsure) * 5 >= len(own) * 4:
                    best = min(best or (1e9,), (5 * fp + 4 * fa + unsure, p, a, fp, fa, unsure))
        assert got[k] == (best[2], best[1], *best[3:], len(own), best[0] / len(own))


def plain_batches(heads, limit):
    header, now = [], None
    for k, h in enumerate(heads):
        now = k if h else now
        header.append(now)
    out, at = [], 0
    while at < len(heads):
        copy = [header[at]] if header[at] not in (None, at) else []
        end = min(len(heads), at + (limit if limit > 0 else len(heads) + 1) - len(copy))
        out.append([(k, True) for k in copy] + [(k, False) for k in range(at, end)])
        at = end
    return out


@pytest.mark.parametrize("limit", [0, 2, 3, 7])
def test_batches_are_full_and_begin_with_their_header(spark, limit):
    rng = random.Random(limit)
    groups = {g: [rng.random() < 0.25 for _ in range(rng.randrange(1, 40))] for g in range(60)}
    df = spark.createDataFrame([(g, k, h) for g, v in groups.items() for k, h in enumerate(v)], "g int, page int, head boolean")
    got = {}
    for r in fullbatches.full_batches(df, ["g"], "page", "head", limit).orderBy("g", "batch", "place").collect():
        got.setdefault(r.g, {}).setdefault(r.batch, []).append((r.page, r.repeated))
    assert {g: list(v.values()) for g, v in got.items()} == {g: plain_batches(v, limit) for g, v in groups.items()}


def test_batches_of_one_page_have_no_room(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, None)], "g int, page int, head boolean")
    with pytest.raises(Exception, match="two at least"):
        fullbatches.full_batches(df, ["g"], "page", "head", 1).collect()
    assert fullbatches.full_batches(df.where("head"), ["g"], "page", "head", 1).count() == 1


def test_medians_of_ragged_vectors(spark):
    rng = random.Random(8)
    rows = [(k if k else None, [rng.choice([None, *range(-4, 5)]) for _ in range(rng.randrange(5))] if rng.random() < 0.9 else None) for k in range(12) for _ in range(rng.randrange(12))]
    got = {r.k: r.medians for r in evaluate.vector_medians(spark.createDataFrame(rows, "k int, v array<int>"), "k", "v").collect()}
    want = {}
    for k, v in rows:
        for place, x in enumerate(v or []):
            if x is not None:
                want.setdefault(k, {}).setdefault(place, []).append(x)
    assert got == {k: [statistics.median(v[p]) if len(v[p]) >= 3 else None for p in sorted(v)] for k, v in want.items()}


def test_slots(spark):
    cases = [
        ("day", [("2", 0.5), ("5", 0.7)], ("25", 0.6)), ("day", [("2", 0.5), ("", 0.7)], ("", 0.0)), ("day", [("?", 0.5), ("5", 0.0)], ("5", 0.5)), ("year", [("2", 0.5), ("x", 0.9)], ("", 0.0)), ("year", [("2", 0.4), ("4", 0.4)], ("24", 0.4)),
        ("digits", [("x", 0.9), ("", 0.2)], ("", 0.0)), ("log_number", [("1", 0.0), ("2", 0.0)], ("", 0.0)), ("digits", [], ("", 0.0)), ("digits", [("٣", 0.5), ("12", 0.5), ("7", 0.5)], ("7", 0.5)),
    ]
    for rule, readings, want in cases:
        df = spark.createDataFrame([(readings,)], "r array<struct<char:string,confidence:double>>")
        assert tuple(df.select(slots.decoded(rule, F.col("r"))).first()[0]) == want, (rule, readings)
    with pytest.raises(ValueError):
        slots.decoded("month", F.col("r"))
    row = spark.createDataFrame([(" c1", 0.5, None)], "seen string, c double, none string")
    weights = lambda text, c, part, place: dict(row.select(slots.digit_weights(text, c, part, place)).first()[0])
    assert weights(F.col("seen"), F.col("c"), "day", 0) == {"0": 0.2, "1": 0.5, "6": 0.36}
    assert weights(F.lit("7"), F.lit(None), "day", 1) == {"7": 0.05, "9": 0.05 * 0.35} and weights(F.lit("7"), F.lit(1.0), "day", 0) == {"7": 1.0}
    assert weights(F.lit("4"), F.lit(1.0), "year", 1) == {"4": 1.0, "0": 0.35} and weights(F.col("none"), F.lit(1.0), "day", 0) == weights(F.lit("?"), F.lit(1.0), "day", 0) == {}


def test_guarded_partitions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id int, v string, p int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    rows = [(1, "a", 0), (1, "a", 0), (2, None, 0), (3, "c", 1), (4, "d", 2)]
    digest = lambda df: {r.p: r.digest for r in guarded.digests(df, "p").collect()}
    assert digest(frame(rows)) == digest(frame(rows[::-1]).repartition(4)) and digest(frame(rows))[0] != digest(frame(rows[1:]))[0]
    guarded.write_partitions(frame(rows), path, "p")
    read = lambda: sorted(map(tuple, guarded.read_partitions(spark, path, schema).collect()), key=str)
    seen = spark.createDataFrame(list(digest(frame(rows)).items()), "p int, digest string")
    guarded.write_partitions(frame([(9, "other", 1)]), path, "p")
    journal, backup = guarded.overwritten(spark, path, schema, "p", frame([(1, "new", 0), (3, "new", 1), (7, "new", 5)]), seen)
    assert {(r.p, r.action) for r in journal.collect()} == {(0, "written"), (1, "refused"), (5, "written")}
    assert read() == sorted([(1, "new", 0), (9, "other", 1), (4, "d", 2), (7, "new", 5)], key=str)
    guarded.write_partitions(frame([(8, "foreign", 0)]), path, "p")
    assert {(r.p, r.action) for r in guarded.restored(spark, path, schema, "p", backup).collect()} == {(0, "refused"), (5, "removed")}
    assert read() == sorted([(8, "foreign", 0), (9, "other", 1), (4, "d", 2)], key=str)
    journal, backup = guarded.overwritten(spark, path, schema, "p", frame([(6, "x", 2)]), spark.createDataFrame([(2, digest(frame(rows))[2])], "p int, digest string"))
    assert guarded.restored(spark, path, schema, "p", backup).first().action == "restored" and (4, "d", 2) in read()


def test_records_of_odd_rows(spark):
    day = F.to_date(F.lit("2025-03-10"))
    rows = spark.createDataFrame([(1, None, None, " hp-17 17cmp", "a1234567", "2025/03/31", None), (2, "f", "x", "HP-1717CMPX", "12", "2025/04/01", "x"), (3, "f", "7", "HP-9911WWP", None, "2025/02/30", "TRUE"), (4, "f", "8", None, None, None, None)], "k int, file string, page string, matricula string, log_number string, date string, dup string")
    fleet = spark.createDataFrame([("HP-1717CMP", "NG", None), ("HP-9911WWP", "", None)], "matricula string, fleet string, lessor string")
    inferred = spark.createDataFrame([("f", 7, datetime.date(2024, 5, 5), "between"), ("f", 8, datetime.date(2024, 6, 6), "edge"), ("", 0, datetime.date(2020, 1, 1), "no")], "file string, page int, day date, method string")
    got = {r.seq: (r.file, r.page, r.matricula, r.log_number, r.date, r.inferred, r.fleet, r.fleet_inferred, r.duplicate, r.reason) for r in records.index_records(rows, "k", fleet, inferred, day, "HP-[0-9]{4}(CMP|WWP)", {}, {"HP-99": "MAX"}, "XX", {"a": "b"}).collect()}
    assert got == {
        1: ("", 0, "HP-1717CMP", "1234567", "2025/03/31", "", "NG", False, False, ""), 2: ("f", 0, "", "", "", "", "", False, False, ""),
        3: ("f", 7, "HP-9911WWP", "", "2024/05/05", "between", "MAX", True, True, ""), 4: ("f", 8, "", "", "2024/06/06", "edge", "", False, False, ""),
    }
    ends = records.index_records(rows.withColumn("unsure", F.col("k") == 4), "k", fleet, inferred, day, "HP-[0-9]{4}(CMP|WWP)", {}, {}, "XX", {"a": "b"}, month_end=True, doubtful="unsure")
    assert {r.seq: (r.date, r.inferred) for r in ends.collect()} == {1: ("2025/03/31", ""), 2: ("", ""), 3: ("2024/05/31", "between"), 4: ("", "")}


def test_templates_are_checked(spark, tmp_path):
    field = {"id": "a", "type": "signature", "x": 0, "y": 0, "w": 1, "h": 1}

    def load(*fields):
        (tmp_path / "t.json").write_text(json.dumps({"name": "t", "fields": fields}, indent=1))
        return manifests.template_fields(spark, f"file://{tmp_path}/t.json").orderBy("place").collect()

    got = load(field, {**field, "id": "b", "type": None, "required": True, "max_length": 3})
    assert [(r.id, r.type, r.required, r.max_length) for r in got] == [("a", "signature", False, None), ("b", "ocr", True, 3)]
    for wrong, why in (([field, field], "stands twice"), ([{**field, "w": 0}], "not on the page"), ([{**field, "x": None}], "not on the page"), ([{**field, "min_length": -1}], "below 0"), ([{**field, "id": None}], "no id")):
        with pytest.raises(Exception, match=why):
            load(*wrong)


def test_manifests_below_a_root(spark, tmp_path):
    pages = [{"file": "f", "page": 1, "separator": True}, {"file": "f", "page": 2}]
    files = {"a/manifest.json": {"job": "x", "batch": "r", "part": 2, "pages": pages}, "b/c/manifest_2.json": {"job": "y", "batch": "r", "review": True, "part": 1}, "manifest.json": {"job": "z", "batch": "r", "part": 1, "pages": []}, "d/other.json": {"job": "no"}, "e/manifest.json": {"batch": "r"}}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/manifest.json").write_text('{"job": "broken", ')
    found = manifests.manifests(spark, f"file://{tmp_path}")
    got = sorted(tuple(r) for r in manifests.delivery_parts(found, "batch").select("place", "job", "review", "index", "of", "n_pages", "n_logs").collect())
    assert got == [(1, "z", False, 1, 2, 0, 0), (2, "x", False, 2, 2, 2, 1), (3, "y", True, 1, 1, 0, 0)]


def test_unclear_verdicts_are_reviewed(spark):
    rows = [("k", s, v, s > 50, None) for s, v in ((1, "absent"), (2, "absent"), (3, "absent"), (60, "present"), (70, "present"), (80, "present"), (65, "unclear"), (2, None), (30, "unclear"))] + [("few", 1, "unclear", False, None), (None, 5, "unclear", None, None)]
    df = spark.createDataFrame(rows, "k string, s int, v string, label boolean, x int")
    seen = evaluate.reviewed_by_band(df, "k", "s", "v", F.lit(4))
    assert sorted((r.s, r.reviewed) for r in seen.where("k = 'k' AND coalesce(v, 'unclear') = 'unclear'").collect()) == [(2, "absent"), (30, "unclear"), (65, "present")]
    assert seen.count() == len(rows)
    tally = {r.k: tuple(r)[1:] for r in evaluate.tallies(seen, ["k"], "label", "reviewed").collect()}
    assert tally == {"k": (9, 8, 0, 0, 0, 1), "few": (1, 0, 0, 0, 0, 1)}
