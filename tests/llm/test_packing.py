import random
from collections import defaultdict

import pytest

from pagewright.llm import tokens
from pagewright.llm.packing import best_fit, pack, sequences
from tests.llm.conftest import SMALL


def plain_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(capacity - used - n, b) for b, (used, ss, cc) in enumerate(bins) if used + n <= capacity and not (s is not None and s in ss) and not (c is not None and c in cc)]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((0, set(), set()))
        used, ss, cc = bins[b]
        bins[b] = (used + n, ss | {s}, cc | {c})
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_matches_plain_search(seed):
    rng = random.Random(seed)
    n = 300
    lengths = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
    sources = [rng.choice([None, "a", "a", "b", "c", "d"]) for _ in range(n)]
    clusters = [rng.choice([None, *range(80)]) for _ in range(n)]
    assert best_fit(lengths, sources, clusters, 100) == plain_best_fit(lengths, sources, clusters, 100)


def holds(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for own in bins.values():
        assert sum(r.n_tokens for r in own) <= capacity
        for kind in ("source", "cluster"):
            named = [getattr(r, kind) for r in own if getattr(r, kind) is not None]
            assert len(named) == len(set(named))
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
    return bins


def decoded(rows):
    """Each document's text from its pieces' token ids."""
    v, ids = tokens.load(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        assert len(r.token_ids) == r.n_tokens
        ids[r.doc_id] += r.token_ids
    return {k: v.decode(x).decode() for k, x in ids.items()}


@pytest.mark.parametrize("shard_rows", [4096, 50])
def test_whole_table(spark, shard_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = pack(docs, 512, shard_rows).collect()
    holds(rows, 512)
    found = decoded(rows)
    assert found == {r.doc_id: r.text for r in docs.collect()}
    if shard_rows == 4096:
        part = [r for r in sorted(rows, key=lambda r: (-r.n_tokens, r.doc_id, r.piece)) if 0 < r.n_tokens < 512]
        want = plain_best_fit([r.n_tokens for r in part], [r.source for r in part], [r.cluster for r in part], 512)
        number = {}
        assert [number.setdefault(r.bin_id, len(number)) for r in part] == want


def test_odd_rows(docs, no_docs):
    packed = pack(docs.selectExpr("*", "1 AS shard", "2 AS piece"), 1000)
    rows = packed.collect()
    bins = holds(rows, 1000)
    assert sorted(str(r.doc_id) for r in rows if r.bin_id is None) == ["3", "4"]
    assert decoded([r for r in rows if r.doc_id == 7]) == {7: "x " * 50_000}
    eights = [r.bin_id for r in rows if r.doc_id == 8]
    assert len(eights) == 2 and len(set(eights)) == 2
    for r in sequences(packed).collect():
        own = sorted(bins[r.bin_id], key=lambda p: p.bin_offset)
        assert r.token_ids == [k for p in own for k in p.token_ids] and r.n_tokens == len(r.token_ids)
        assert [(p.doc_id, p.bin_offset) for p in r.pieces] == [(p.doc_id, p.bin_offset) for p in own]
    assert pack(no_docs).count() == 0


def test_one_source_gives_a_bin_a_piece(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    rows = pack(docs, 100).collect()
    assert len({r.bin_id for r in rows}) == len(rows) == 300
