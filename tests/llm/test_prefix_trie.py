import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pagewright.llm import prefix_trie, queries
from tests.llm.conftest import SMALL

ROWS = "conv_id long, turn long, role string, text string"


def plain(convs):
    """The nodes of conversations (id to turns) by walking every prefix."""
    members, last, ends, children = defaultdict(set), {}, defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            p = tuple(turns[:d])
            members[p].add(c)
            if d:
                children[p[:-1]].add(p)
        ends[tuple(turns)].append(c)
    out = []

    def down(p):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [down(q) for q in children[p]]
        leaves, saved = sum(x for x, _ in below) if below else 1, own + sum(x for _, x in below)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(below), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
        return leaves, saved

    if convs:
        down(())
    return sorted(out, key=str)


def in_order(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t, r or "", x or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    return {c: [(r, x) for _, r, x in sorted(v, key=key)] for c, v in convs.items()}


def rebuilt(rows):
    convs, out = in_order(rows), {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + convs[c][h:]
    return out


def query(df):
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    turns = prefix_trie.turns_of(df)
    return sorted([tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt_turns(turns, F.expr("conv_id - conv_id % 100"), heads, most=5)).drop("node").collect()], key=str)


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert sorted([tuple(r) for r in queries.op11_prefix_trie(spark, SMALL).collect()], key=str) == plain(rebuilt(rows))


def odd_rows():
    rows = [(c, t, r, x) for c in (0, 1, 2, 100, 101, -5, -100, 350, None) for t, r, x in ((None, "user", "a"), (0, None, "b"), (0, "", "b"), (1, "assistant", None), (1, "assistant", ""), (9, "user", "é" * 30_000))]
    rows += [(c, 0, "user", "a") for c in range(400, 420)] + [(c, k, "user", str(k)) for c in (600, 601) for k in range(700)]
    return rows + rows[:5] + [(2**60 + 100 + k, 0, "user", "a") for k in range(3)]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS node", "2 AS mark", "3 AS Depth", "4 AS place")
    assert query(df) == plain(rebuilt(rows))
    assert query(df.where("false")) == [] == query(df.where("conv_id IS NULL"))


def test_deep_branches_and_small_partial_tries(spark, monkeypatch):
    # each conversation leaves the one before a turn later, so owners' paths hang off one another
    rows = [(c, k, "user", "same" if k < c else f"{c}") for c in range(1, 40) for k in range(c + 2)]
    df = spark.createDataFrame(rows, ROWS)
    want = plain(in_order(rows))
    run = lambda: sorted([tuple(r) for r in prefix_trie.trie(prefix_trie.own_turns(prefix_trie.turns_of(df))).drop("node").collect()], key=str)
    assert run() == want
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)  # many lists for a node
    same = spark.createDataFrame([(c, 0, "user", "x") for c in range(-9, 30)], ROWS)
    got = [tuple(r) for r in prefix_trie.trie(prefix_trie.own_turns(prefix_trie.turns_of(same))).drop("node").collect()]
    assert sorted(got, key=str) == plain({c: [("user", "x")] for c in range(-9, 30)})


def test_partial_tries_that_are_handed_on_early_merge_to_the_same():
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    rows = [(c, d, bytes([d]) * 16, bytes([d - 1]) * 16 if d else None, 3, d == 2) for c in range(50) for d in range(3)]
    batch = lambda x: prefix_trie._batch(x, prefix_trie.PATHS, kinds)

    def totals(held):
        prefix_trie.HELD, before = held, prefix_trie.HELD
        try:
            out = [r for b in prefix_trie._partial(iter([batch(rows[k : k + 30]) for k in range(0, 150, 30)])) for r in b.to_pylist()]
        finally:
            prefix_trie.HELD = before
        return len(out), {d: sum(r["members"] for r in out if r["depth"] == d) for d in range(3)}, sorted(x for r in out for x in r["ended"] or [])

    many, few = totals(1 << 17), totals(4)
    assert many[1:] == few[1:] == ({0: 50, 1: 50, 2: 50}, list(range(50))) and few[0] > many[0]


def test_malformed_bytes_are_replaced(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, cast(unhex('FF') AS string) AS role, cast(unhex('61FF2E') AS string) AS text UNION ALL SELECT 2L, 0L, '�', 'a�.'")
    assert query(df) == plain(rebuilt([(1, 0, "�", "a�."), (2, 0, "�", "a�.")]))
