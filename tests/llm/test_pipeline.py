import hashlib
from collections import defaultdict

import corpus_pipeline
from pagewright.llm import mixing
from pagewright.llm.shared import written
from tests.llm.conftest import SMALL
from tests.llm.test_mixing import plain_mix
from tests.llm.test_packing import decoded, holds
from tests.llm.test_simhash import classes, plain_fingerprint, second_pass


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic, exact, near, mix, pack = [f for _, f in corpus_pipeline.STAGES]
    columns = docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    clean = written(toxic(spark, docs, SMALL), "test")
    labels = rows(spark.read.parquet(f"{SMALL}/labels.parquet"))
    gone = set(rows(docs)) - set(rows(clean))
    wrong = [k for k in gone if k in labels and not labels[k].toxic]
    assert clean.columns == columns and len(wrong) <= 2, wrong  # of 87 labels

    once = written(exact(spark, clean, SMALL), "test")
    texts = defaultdict(list)
    for k, r in rows(clean).items():
        texts[hashlib.sha256((r.text or "").encode()).digest()].append(k)
    assert once.columns == columns and set(rows(once)) == {max(v) for v in texts.values()}

    single = written(near(spark, once, SMALL), "test")
    ids = classes({k: plain_fingerprint(r.text) for k, r in rows(once).items()})
    assert single.columns == columns and set(rows(single)) == second_pass({k: r.text for k, r in rows(once).items() if ids[k] == k})

    mixed = written(mix(spark, single, SMALL), "test")
    count = mixing.vocabulary_tokens(spark)
    plain = [tuple(r) for r in single.select("doc_id", *[c.alias(n) for n, c in mixing.leaf_columns(count=count).items()]).collect()]
    want = {r[0]: n for r, n in zip(plain, plain_mix(plain, corpus_pipeline.SHARE, 1, corpus_pipeline.SEED, mixing.WEIGHTS), strict=True) if n[0]}
    got, before = rows(mixed), rows(single)
    assert mixed.columns == columns and set(got) == set(want)
    for k, (_, prefix) in want.items():
        assert (got[k] == before[k]) if prefix is None else (before[k].text.startswith(got[k].text) and got[k].n_chars == len(got[k].text))

    packed = pack(spark, mixed, SMALL).collect()
    holds(packed, 2048)
    assert decoded(packed) == {k: r.text or "" for k, r in got.items()}


def test_odd_rows_go_through_all_stages(spark, docs):
    rows = docs.unionByName(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, SMALL), "test")
        assert rows.columns == docs.columns, name
    left = sorted((r.doc_id for r in rows.collect() if r.doc_id is not None))
    assert set(left) <= {2, 4, 7, 8, 9} and len(left) == len(set(left))
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows.collect()}


def test_run_and_empty_input(spark):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_a_failing_stage_leaves_no_tables(spark, monkeypatch, tmp_path):
    import os

    import pytest

    from pagewright.llm import mixing, shared

    def fails(*a, **b):
        raise KeyError

    monkeypatch.setattr(shared, "scratch_root", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(mixing, "mixed", fails)
    with pytest.raises(KeyError):
        corpus_pipeline.run(spark, SMALL)
    assert os.listdir(tmp_path) == []


def test_malformed_bytes_go_through_all_stages(spark):
    docs = spark.sql("SELECT id AS doc_id, CASE WHEN id < 3 THEN cast(unhex('61FF206220632064206520') AS string) ELSE concat('text ', id, ' is here') END AS text, 'en' AS lang, 's1' AS source, 9L AS n_chars FROM range(40)")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test")
        assert docs.where("doc_id = 2").count() == 1 or stage is corpus_pipeline.mix_sources
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()
