import re

import numpy as np
import pytest
import xxhash

from pagewright.llm import simhash
from pagewright.llm.simhash import components, drop_near_duplicates, fingerprint, near_duplicate_classes
from tests.llm.conftest import SMALL


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps):
    """Component ids over (id, fingerprint) rows by comparing all pairs."""
    ids = list(fps)
    root = {x: x for x in ids}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                ra, rb = sorted((up(a), up(b)))
                root[rb] = ra
    return {x: up(x) for x in ids}


@pytest.mark.parametrize("text", ["", "One", "two Words", "ÄÖ a\tb\nc d", "a b c " * 700])
def test_fingerprint(text):
    assert fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize(("tile", "most"), [(2048, 64), (3, 64), (2, 2)])
def test_classes_match_all_pairs(spark, tile, most):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in near_duplicate_classes(docs, tile=tile, most=most).collect()}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == classes(fps)


@pytest.mark.parametrize("step", [1, 7, 1024])
def test_tiles_skip_no_link(step):
    rng = np.random.default_rng(8)
    fp = np.unique(np.concatenate([np.bitwise_xor(x, np.left_shift(1, rng.integers(0, 63, 40))) for x in rng.integers(0, 2**63, 5)]))
    pc = np.bitwise_count(fp)
    order = np.argsort(pc, kind="stable")
    u, v = simhash.tile_links(pc[order].astype(np.int32), fp[order], step)
    want = classes({int(x): int(x) for x in fp})
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert {int(x): root.get(int(x), int(x)) for x in fp} == want


@pytest.mark.parametrize(("tile", "most"), [(2048, 64), (8, 64), (8, 2)])
def test_links_among_close_fingerprints(spark, tile, most):
    rng = np.random.default_rng(3)
    near = [int(rng.integers(2**63))] * 60
    for k in range(60):
        for _ in range(rng.integers(0, 6)):
            near[k] ^= 1 << int(rng.integers(64))
    fps = {k: x for k, x in enumerate(dict.fromkeys(near + [int(x) for x in rng.integers(2**63, size=40)]))}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps.values()]
    got = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(spark.createDataFrame(signed, "fp long"), tile, most)).collect()}
    want = classes(fps)
    for a in fps:
        for b in fps:
            assert (want[a] == want[b]) == (got.get(fps[a], fps[a]) == got.get(fps[b], fps[b]) or a == b)


def test_long_paths(spark):
    path = spark.range(200).selectExpr("id AS u", "id + 1 AS v").union(spark.range(1000, 1050).selectExpr("id AS u", "1000L AS v"))
    got = {r.node: r.root for r in components(path).collect()}
    assert {got[k] for k in range(201)} == {0}
    assert {got[k] for k in range(1000, 1050)} == {1000}


def test_odd_rows(docs, no_docs):
    got = {(r.doc_id, r.fp): r.component_id for r in near_duplicate_classes(docs).collect()}
    assert got[(3, 0)] == got[(4, 0)] == 3
    assert {v for (k, _), v in got.items() if k in (1, 2, None)} == {1}
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == {1, 3, 7, 8, 9, None}
    assert near_duplicate_classes(no_docs).count() == drop_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("rows", [10, 10**7, 10**10, 10**14])
def test_masks_cover_radius(rows):
    rng = np.random.default_rng(5)
    masks = simhash.bucket_masks(rows)
    for _ in range(200):
        diff = 0
        for b in rng.choice(64, 3, replace=False):
            diff |= 1 << int(b)
        assert any(diff & m & (1 << 64) - 1 == 0 for m in masks)


FULL = (1 << 64) - 1


def plain_mixed(x):
    x = (x ^ x >> 30) * int(simhash.MIX_1) & FULL
    x = (x ^ x >> 27) * int(simhash.MIX_2) & FULL
    return x ^ x >> 31


def plain_wide(text):
    """256 bits over distinct five-word shingles, and the smallest shingle hashes, word by word."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0, []
    at = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    hashes = set()
    for k in range(max(1, len(words) - 4)):
        hashes.add(plain_mixed(sum(plain_mixed(h * int(p) & FULL) for h, p in zip(at[k : k + 5], simhash.PLACES, strict=False)) & FULL))
    bits = 0
    for lane in range(4):
        own = [plain_mixed(h + int(simhash.STARTS[lane]) & FULL) for h in hashes]
        bits |= sum(1 << b for b in range(64) if sum(x >> b & 1 for x in own) * 2 > len(own)) << 64 * lane
    return bits, sorted(hashes)[: simhash.ANCHORS]


def second_pass(texts, chosen=simhash.CHOSEN):
    """The ids that stay among texts by id: smallest of each component of texts that share a chosen anchor and lie within the radius."""
    got = {k: plain_wide(t) for k, t in texts.items()}
    df = {}
    for _, anchors in got.values():
        for a in anchors:
            df[a] = df.get(a, 0) + 1
    signed = lambda a: a - (1 << 64) if a >> 63 else a
    buckets = {}
    for k, (_, anchors) in got.items():
        for a in sorted(anchors, key=lambda a: (df[a], signed(a)))[:chosen]:
            if df[a] > 1:
                buckets.setdefault(a, []).append(k)
    root = {k: k for k in texts}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for v in buckets.values():
        for i, a in enumerate(v):
            for b in v[:i]:
                if (got[a][0] ^ got[b][0]).bit_count() <= simhash.WIDE_RADIUS:
                    ra, rb = sorted((up(a), up(b)))
                    root[rb] = ra
    return {up(k) for k in texts}


def first_pass(texts):
    ids = classes({k: plain_fingerprint(t) for k, t in texts.items()})
    return {k: t for k, t in texts.items() if ids[k] == k}


@pytest.mark.parametrize("text", ["", "One", "two Words", "ÄÖ a\tb\nc d e f g h", "a b c d e f g " * 300])
def test_wide_sketch(text):
    bits, anchors = plain_wide(text)
    got, own = simhash.wide_sketch(text.encode(), {})
    assert (int.from_bytes(got, "little"), [a & FULL for a in own.tolist()]) == (bits, anchors)


@pytest.mark.parametrize("tile", [2048, 3])
def test_both_passes_match_brute_force(spark, tile):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in drop_near_duplicates(docs, tile=tile).collect()} == second_pass(first_pass(texts))


def near_copies(n, words, changed, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for k in range(n - 1):
        own = list(base)
        for at in rng.choice(words, changed, replace=False):
            own[at] = f"x{k}y{at}"
        out.append(" ".join(own))
    return out


def test_recall_of_near_copies_and_clean_texts(spark):
    # a copy with 2 of 100 words changed shares 0.8 of its shingles with the original
    rows, clean, n = [], [], 0
    for seed in range(60):
        for text in near_copies(2, 100, 2, seed):
            rows.append((n, text))
            n += 1
    rng = np.random.default_rng(99)
    passage = " ".join(f"p{k}" for k in range(25))
    for _ in range(60):  # clean texts that quote a passage
        clean.append(n)
        rows.append((n, " ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) + " " + passage))
        n += 1
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(clean) <= kept
    caught = sum(2 * k + 1 not in kept for k in range(60))
    assert caught >= 54 and all(2 * k in kept for k in range(60))


def test_large_buckets_go_through_rounds_and_pairs(spark, monkeypatch):
    texts = dict(enumerate(near_copies(120, 150, 3, 1)))
    df = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r.doc_id for r in drop_near_duplicates(df(texts), tile=8).collect()} == second_pass(first_pass(texts)) == {0}
    monkeypatch.setattr(simhash, "PAIRED", 1)
    kept = {r.doc_id for r in drop_near_duplicates(df(texts), tile=8).collect()}
    assert 0 in kept and len(kept) <= 4  # a text that is near to dropped ones only may stay
    # texts that meet in one bucket without being alike: rounds don't help, all pairs of tiles are compared
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{k}" for k in range(60))
    other = {k: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) + " " + passage for k in range(40)}
    other |= {k + 100: other[k] + " end" for k in range(0, 40, 4)}
    monkeypatch.setattr(simhash, "CHOSEN", 16)
    assert {r.doc_id for r in drop_near_duplicates(df(other), tile=4).collect()} == second_pass(first_pass(other), 16)


@pytest.mark.parametrize(("tile", "paired"), [(2048, 16), (8, 16), (8, 1), (6, 3)])
def test_wide_links_do_not_depend_on_a_buckets_size(spark, monkeypatch, tile, paired):
    """Rows in one bucket: chains that hang together by neighbours only, one large class, and rows apart."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(11)
    flipped = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(256, n, replace=False))
    new = lambda: int.from_bytes(rng.bytes(32), "little")
    rows = []
    for length in (70, 20, 3):
        rows.append(new())
        for _ in range(length - 1):
            rows.append(flipped(rows[-1], 30))
    centre = new()
    rows += [flipped(centre, 6) for _ in range(90)] + [new() for _ in range(25)]
    rows = {int(k): x for k, x in zip(rng.permutation(len(rows)), rows, strict=True)}
    root = {k: k for k in rows}
    up = lambda k: k if root[k] == k else up(root[k])
    for a in rows:
        for b in rows:
            if a < b and (rows[a] ^ rows[b]).bit_count() <= simhash.WIDE_RADIUS:
                ra, rb = sorted((up(a), up(b)))
                root[rb] = ra
    want = {k: up(k) for k in rows}
    assert len(set(want.values())) == 29
    leaders = spark.createDataFrame([(k, x.to_bytes(32, "little"), [5] if k % 3 else [5, 6]) for k, x in rows.items()], "doc_id long, wide binary, anchors array<long>")
    got = {r.node: r.root for r in components(simhash.second_links(leaders, tile)).collect()}
    assert {k: got.get(k, k) for k in rows} == want
