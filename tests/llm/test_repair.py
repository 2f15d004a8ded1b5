import hashlib
import itertools
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import queries, repair
from tests.llm.conftest import SMALL

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def plain(rows):
    """Cost, audit and repaired turns of (role, text) rows, by trying all edits place by place."""
    seen, codes = set(), []
    for role, text in rows:
        t = text.strip(SPACE)
        fault = 2 if not t or (role, text) in seen else 1 if t[-1] not in ".!?" else 0
        seen.add((role, text))
        codes.append((role[:1], fault))
    best = {(0, 0): (0, "", ())}  # (row, state) to the best edits so far
    ends = {}
    for i in range(len(rows) + 1):
        for _ in range(4):  # inserted turns
            for s in range(4):
                if (i, s) in best:
                    c, a, made = best[i, s]
                    t, name = (3, "assistant") if s == 2 else (2, "user")
                    new = (c + 5, a + "I", (*made, (name, "")))
                    best[i, t] = min(best.get((i, t), new), new)
        if i == len(rows):
            ends = {s: best[i, s] for s in (0, 3) if (i, s) in best}
            break
        role, text = rows[i]
        kind, fault = codes[i]
        for s in range(4):
            if (i, s) not in best:
                continue
            c, a, made = best[i, s]
            ways = [(2, "D", s, made)]
            if fault < 2:
                t, name = (3, "assistant") if s == 2 else (2, "user")
                ways.append((1 + 5 * fault, "R", t, (*made, (name, text))))
                keep = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}.get((kind, s))
                if keep is not None:
                    ways.append((5 * fault, "K", keep, (*made, (role, text))))
            for cost, letter, t, then in ways:
                new = (c + cost, a + letter, then)
                best[i + 1, t] = min(best.get((i + 1, t), new), new)
    c, a, made = min(ends.values())
    return c, a, made


def damage(conv, rows):
    """Rows (turn, role, text) after damage, in order."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))


def expected(conv, rows):
    rows = damage(conv, rows)
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), [0, 0, 0]
    for _, role, text in rows:
        t = text.strip(SPACE)
        if not t:
            faults[0] += 1
        elif (role, text) in seen:
            faults[1] += 1
        elif t[-1] not in ".!?":
            faults[2] += 1
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, made = plain([(r, t) for _, r, t in rows])
    whole = "\n".join(f"{r}:{t}" for r, t in made)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())


CODES = st.lists(st.integers(0, 11), max_size=9).map(bytes)
SAID = {0: "x.", 1: "x", 2: ""}


@settings(max_examples=400, deadline=None)
@given(CODES, st.integers(1, 4))
def test_cheapest_edits_match_brute_force(codes, block):
    rows = [(repair.ROLES[c // 3], SAID[c % 3] and f"{k}{SAID[c % 3]}") for k, c in enumerate(codes)]
    cost, audit, _ = plain(rows)
    assert repair.cheapest(codes) == repair.cheapest(codes, block) == (cost, audit)


def got_of(df):
    rows = repair.ordered(queries.damaged(df), "gone")
    got = repair.digests(rows, repair.plan_repairs(rows)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def by_conv(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return {k: expected(k, v) for k, v in out.items()}


def test_whole_table_matches_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert got_of(df) == by_conv([tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def odd():
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (None, 0, 1, 2, 2, 5) for r, x in (("user", "a."), ("assistant", None), (None, "b"), ("", "c."), ("system", "é! "), ("User", " \t"))]
    rows += rows[:9] + [(3, None, None, None), (4, 7, "user", "x" * 200_000 + "."), (5, -3, "us", "ok?"), (5, 2**40, "assistant", "ok")]
    return rows + [(6, k, "user" if k % 2 == 0 else "assistant", f"{k}." if k % 7 else "same.") for k in range(900)]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame(odd, ROWS).selectExpr("*", "1 AS mark", "2 AS head", "3 AS audit", "4 AS Gone", "5 AS fault")
    assert got_of(df) == by_conv(odd)
    assert got_of(df.where("false")) == {}


def test_malformed_bytes_are_replaced(spark):
    df = spark.sql("SELECT 1L AS conv_id, 50L AS turn, 'user' AS role, cast(unhex('61FF2E') AS string) AS text UNION ALL SELECT 1L, 51L, cast(unhex('61FF') AS string), 'ok.'")
    assert got_of(df) == by_conv([(1, 50, "user", "a�."), (1, 51, "a�", "ok.")])


def test_repaired_turns_are_what_the_digest_says(spark, odd):
    rows = repair.ordered(queries.damaged(spark.createDataFrame(odd, ROWS)), "gone")
    planned = repair.plan_repairs(rows)
    texts = {}
    for r in repair.repaired_turns(rows, planned).orderBy("conv_id", "place").collect():
        texts.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for r in repair.digests(rows, planned).collect():
        turns = texts.get(r.conv_id, [])
        assert [k for k, _ in turns] == list(range(len(turns)))
        assert hashlib.sha256("\n".join(t for _, t in turns).encode()).hexdigest() == r.repaired_sha256
