import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import mixing
from tests.llm.conftest import SMALL


def plain_deal(given_tokens, children):
    """children: name -> (supply, weight). Deals round by round: who can't take its share is filled and taken out."""
    out, left, open_ = {k: 0 for k in children}, given_tokens, {k: v for k, v in children.items() if v[1]}
    while open_:
        total = sum(w for _, w in open_.values())
        full = {k for k, (s, w) in open_.items() if s * total <= left * w}
        if not full:
            out |= {k: left * w // total for k, (_, w) in open_.items()}
            over = left - sum(out[k] for k in open_)
            for k in sorted(open_, key=lambda k: (-(left * open_[k][1] % total), k))[:over]:
                out[k] += 1
            return out
        for k in full:
            out[k] = open_[k][0]
        left -= sum(open_[k][0] for k in full)
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def plain_mix(rows, share, epochs, seed, weights):
    """rows: (doc_id, domain, lang, source, tokens). Draws of each row, in order."""
    budgets = {(): min(sum(r[4] for r in rows) * share[0] // share[1], sum(r[4] for r in rows) * epochs)}
    for depth, level in enumerate(("domain", "lang", "source"), 1):
        supply = defaultdict(int)
        for r in rows:
            supply[r[1 : 1 + depth]] += r[4] * epochs
        new = {}
        for parent, tokens in budgets.items():
            own = {k: (s, weights.get(level, {}).get(k[-1], 1)) for k, s in supply.items() if k[:-1] == parent}
            new |= plain_deal(tokens, own)
        budgets = new
    out = [(0, None)] * len(rows)
    for leaf, budget in budgets.items():
        own = [k for k, r in enumerate(rows) if r[1:4] == leaf]
        tokens = sum(rows[k][4] for k in own)
        whole, rest = divmod(budget, tokens) if tokens else (epochs, 0)
        name = lambda k: "none" if rows[k][0] is None else rows[k][0]
        key = lambda k: (hashlib.md5(f"{seed}:{whole + 1}:{name(k)}".encode()).hexdigest(), rows[k][4])
        used = 0
        for k in sorted(own, key=key):
            left = rest - used
            used += rows[k][4]
            out[k] = whole + (rest > 0 and (used <= rest or left > 0)), left if used > rest and left > 0 else None
    return out


@pytest.mark.parametrize(("share", "epochs", "seed", "weights"), [((3, 4), 2, 7, mixing.WEIGHTS), ((3, 1), 2, 2, {"domain": {"d0": 0}, "lang": {"en": 50}})])
def test_draws_match_plain_mix(spark, share, epochs, seed, weights):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.mix(docs, share, epochs, seed, weights).select("doc_id", *[c.alias(f"_{n}") for n, c in mixing.leaf_columns().items()], "n_draws", "prefix_tokens").collect()
    want = plain_mix([tuple(r)[:5] for r in got], share, epochs, seed, weights)
    assert [(r.n_draws, r.prefix_tokens) for r in got] == want
    assert len(got) == docs.count()
    tokens = sum(r._n_tokens for r in got)
    assert sum(r._n_tokens * r.n_draws - (r._n_tokens - r.prefix_tokens if r.prefix_tokens else 0) for r in got) == min(tokens * share[0] // share[1], supply(got, epochs, weights))


def supply(rows, epochs, weights):
    """What the leaves with a weight hold."""
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    return epochs * sum(r._n_tokens for r in rows if weight("domain", r._domain) and weight("lang", r._lang))


@pytest.mark.parametrize("bpe", [False, True])
def test_the_cut_row_holds_its_first_tokens(spark, bpe):
    count = mixing.vocabulary_tokens(spark) if bpe else mixing.WORDS
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = mixing.mixed(docs, (1, 2), 1, count=count, length_col="n_chars").withColumn("n", count[0]("text")).collect()
    total = sum(r.n for r in docs.select(count[0]("text").alias("n")).collect())
    cut = [r for r in rows if r.text != before[r.doc_id]]
    assert cut and all(before[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in cut)
    assert abs(sum(r.n for r in rows) - total // 2) <= (2 * len(cut) if bpe else 0)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 500), st.dictionaries(st.text("abc", min_size=1, max_size=3), st.tuples(st.integers(0, 100), st.integers(0, 5)), min_size=1, max_size=6))
def test_plain_deal_is_whole(tokens, children):
    tokens = min(tokens, sum(s for s, w in children.values() if w))
    out = plain_deal(tokens, children)
    assert all(0 <= out[k] <= children[k][0] for k in children)
    assert sum(out.values()) == tokens or not any(w for _, w in children.values())


def test_odd_rows(docs, no_docs):
    rows = docs.selectExpr("*", "1 AS domain", "2 AS epochs", "3 AS n_tokens", "4 AS n_draws")
    drawn = mixing.mix(rows, (1, 1), 1, out="times")
    assert drawn.columns == [*rows.columns, "times", "prefix_tokens"]
    assert [r.times for r in drawn.collect()] == [1] * rows.count()
    assert mixing.mixed(rows, (2, 1), 2).count() == 2 * rows.count()
    assert mixing.mixed(rows, (1, 1), 1).columns == rows.columns
    assert mixing.mix(no_docs, (1, 2), 2).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [(k, "w " * n, lang, source, 0) for k, (n, lang, source) in enumerate([(10, "en", "src0")] * 2 + [(10, "en", "src4")] * 20 + [(10, "de", "src0")] * 20 + [(10, "en", "src1")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = defaultdict(int)
    for r in mixing.mix(docs, (400, 820), 1, weights={}).where("n_draws > 0").collect():
        got[r.source, r.lang] += r.prefix_tokens or 10
    # half of 400 for d0 and d1 each; en and de 100 each; src0's shortage (20 of 50) goes to src4
    assert got == {("src1", "en"): 200, ("src0", "en"): 20, ("src4", "en"): 80, ("src0", "de"): 100}
