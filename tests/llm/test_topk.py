import numpy as np
import pytest

from pagewright.llm.topk import Index, integer_vectors, top_k
from tests.llm.conftest import SMALL


def brute(queries, rows, k):
    out = []
    for q, v in queries:
        scores = sorted((-int(np.dot(v, w)), c) for c, w in rows if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 100])
def test_whole_table(spark, block):
    df = integer_vectors(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    rows = [(r.vec_id, np.array(r.v)) for r in df.collect()]
    raw = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert all((np.floor(64 * np.array(raw[k], float)) == v).all() for k, v in rows)
    got = top_k(df.where("vec_id % 20 = 0"), df, 20, block, 10)
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] % 20 == 0], rows, 20)


@pytest.mark.parametrize("seed", range(4))
def test_index_with_ties_and_copies(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, (600, 8))
    vectors[200:400] = vectors[0]
    ids = rng.permutation(600)
    index = Index(ids, vectors)
    for q in (vectors[0], vectors[5], np.zeros(8, np.int64), -np.ones(8, np.int64)):
        got = list(zip(*[x.tolist() for x in index.top(int(ids[0]), q, 20)], strict=True))
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[0])[:20]
        assert got == [(i, -s) for s, i in want]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]), (20, [1.0])]
    df = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS rank", "3 AS least"))
    got = top_k(df.where("vec_id % 20 = 0"), df, 3).collect()
    assert sorted(map(tuple, got)) == sorted([(0, 1, 1, 64 * 32 + 128 * 32), (0, 2, 1, 64 * 32 + 128 * 32), (0, 3, 20, 64 * 64), (20, 1, 0, 64 * 64), (20, 2, 1, 64 * 32), (20, 3, 1, 64 * 32)])
    assert top_k(df.where("false"), df).count() == top_k(df.where("false"), df.where("false")).count() == 0


def test_any_finite_component_takes_part(spark):
    rows = [(0, [-1e30, 1.0]), (1, [-1e30, 0.0]), (2, [1.0, 1.0]), (3, [1.7e308, 0.0])]
    df = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.vec_id, r.score) for r in top_k(df.where("vec_id = 0"), df, 4).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, -(2**63)), (3, -(2**63))]


@pytest.mark.parametrize("clustered", [True, False])
def test_few_rows_are_rescored(clustered):
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 8, (8000, 64))
    if clustered:
        vectors = rng.normal(0, 8, (40, 64))[rng.integers(0, 40, 8000)] + rng.normal(0, 2, (8000, 64))
    vectors = np.floor(vectors)
    index = Index(np.arange(8000), vectors)
    for q in range(0, 400, 10):
        scores = vectors @ vectors[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:20]
        assert list(zip(*[x.tolist() for x in index.top(q, vectors[q], 20)], strict=True)) == [(i, -s) for s, i in want]
    assert 0 < index.rescored < 0.1 * index.seen


def test_a_known_bound_loses_nothing_above_it():
    rng = np.random.default_rng(12)
    vectors = rng.integers(-9, 10, (3000, 16))
    index = Index(np.arange(3000), vectors)
    for q in range(20):
        want = index.top(q, vectors[q], 20)
        for least in (int(want[1][-1]), int(want[1][5])):
            got = index.top(q, vectors[q], 20, least)
            keep = want[1] >= least
            assert [x[: keep.sum()].tolist() for x in got] == [x[keep].tolist() for x in want]


def test_large_components_take_part(spark):
    big = 2.0**18
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [big, 0.0]), (20, [big, -1.0]), (3, [2.0**40, 1.0]), (40, [-(2.0**50), 0.25])]
    df = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = [(i, [int(64 * x) for x in v]) for i, v in rows]
    long = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q, v in ints[0], ints[3], ints[5]:
        scores = sorted((-long(sum(a * b for a, b in zip(v, w, strict=True))), c) for c, w in ints if c != q)[:4]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    assert sorted(map(tuple, top_k(df.where("vec_id % 20 = 0"), df, 4).collect())) == sorted(want)
    assert df.count() == len(rows)


def test_far_rows_beside_an_index():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-3, 4, (600, 8))
    vectors[::100] *= 2**30
    index = Index(np.arange(600), vectors)
    for q in (vectors[1], vectors[0], vectors[100] * 2**30):
        scores = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in enumerate(vectors) if i != 1)[:20]
        assert list(zip(*[x.tolist() for x in index.top(1, q, 20)], strict=True)) == [(i, -s) for s, i in scores]
