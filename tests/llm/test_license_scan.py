import random
import re
import time

import pytest

from pagewright.llm.license_scan import PHRASES, TEMPLATES, Scanner, build, chain, maximal, notices, scan_documents, statistics, words
from tests.llm.conftest import SMALL


def plain_places(text):
    run = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in PHRASES.items() for k in range(len(run)) if run[k : k + len(phrase.split())] == phrase.split()]
    return len(run), found


def test_documents_match_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in scan_documents(docs).collect()}
    for r in docs.collect():
        n, found = plain_places(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base) == (n, len(found))
        assert (g.first_word, g.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert g.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
        assert 0 <= g.score <= 1


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
    templates, phrases, text = [draw(8), draw(12)], [draw(2), draw(3)], [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(200)]
    a = build(templates, phrases)
    holds = lambda run: any(t[k : k + len(run)] == run for t in templates + phrases for k in range(len(t)))
    got = {at: (state, n) for at, state, n in statistics(a, text, frozenset(a.step[0]))}
    for at in range(len(text)):
        want = max((n for n in range(at + 2) if holds(text[at + 1 - n : at + 1])), default=0)
        assert got.get(at, (0, 0))[1] == want
        if want:
            state = got[at][0]
            ends = {k for k, n in a.phrases[state] if n <= want}
            assert ends == {k for k, p in enumerate(phrases) if text[max(0, at + 1 - len(p)) : at + 1] == p}
            run = text[at + 1 - want : at + 1]
            assert a.places[state] == {t: ends for t, x in enumerate(templates) if (ends := [k + want - 1 for k in range(len(x)) if x[k : k + want] == run])}


def test_spans_bridge_small_changes():
    scanner = Scanner(TEMPLATES, PHRASES)
    text = TEMPLATES["bsd"][0].replace("binary forms", "binaries")
    n, n_base, *_, base, labels, score, spans = scanner.scan(f"some head. {text} and a tail".encode())
    assert (n_base, base, labels, [s["label"] for s in spans]) == (0, "", "bsd", ["bsd"])
    assert spans[0]["start"] == 2 and spans[0]["end"] == n - 4 and 0.6 < score < 1
    assert scanner.scan(" ".join(reversed(text.split())).encode())[-1] == []
    assert maximal([], 3) == []


def test_odd_rows(docs, no_docs):
    got = {r.doc_id: r for r in scan_documents(docs).collect()}
    assert len(scan_documents(docs).collect()) == docs.count()
    assert (got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels) == (2, 0, 3, "apache,mit")
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0)
    assert got[7].n_words == 50_000
    assert scan_documents(no_docs).count() == 0
    assert words("Ä-b_C\x7f9".encode()) == ["Ä".encode(), b"b", b"c", b"9"]


def test_each_copy_is_a_span():
    scanner = Scanner(TEMPLATES, PHRASES)
    text = TEMPLATES["bsd"][0]
    n = len(text.split())
    for other, apart in (("some words of code", 4), ("", 0)):
        spans = scanner.scan(f"{text} {other} {text} {other} {text}".encode())[-1]
        assert [(s["label"], s["start"], s["end"], s["covered"]) for s in spans] == [("bsd", k * (n + apart), k * (n + apart) + n - 1, 1.0) for k in range(3)]
    changed = text.replace("binary forms", "binaries")
    assert [s["covered"] < 1 for s in scanner.scan(f"{changed} {text} {changed}".encode())[-1]] == [True, False, True]
    short = TEMPLATES["unlicense"][0]
    assert len(scanner.scan(" ".join([short] * 2000).encode())[-1]) == 2000


def test_spans_of_a_template_do_not_cross():
    scanner = Scanner(TEMPLATES, PHRASES)
    run = TEMPLATES["bsd"][0].split()
    half = len(run) // 2
    spans = scanner.scan(" ".join([*run[:half], *run, *run[half:]]).encode())[-1]
    assert [(s["start"], s["end"]) for s in spans] == [(half, half + len(run) - 1)]
    rng = random.Random(1)
    for _ in range(200):
        parts = [run[a : a + rng.randint(5, len(run))] for a in (rng.choice([0, 0, 3, half]) for _ in range(12))]
        spans = [s for s in scanner.scan(" ".join(w for p in parts for w in p).encode())[-1] if s["label"] == "bsd"]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))


def best_subset(matches, end, gap):
    """The most covered words of any rising run of matches that ends with ``matches[end]``, by trying all."""
    best = 0
    for bits in range(1 << end):
        own = [m for k, m in enumerate(matches[:end]) if bits >> k & 1] + [matches[end]]
        covered, ok = own[0][2], True
        for (xj, yj, nj), (x, y, n) in zip(own, own[1:], strict=False):
            new = min(n, x + n - xj - nj, y + n - yj - nj)
            ok = ok and x - xj - nj <= gap and new > 0 and yj < y
            covered += new
        best = max(best, covered if ok else 0)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_chains_are_the_best_of_all_subsets(seed):
    rng = random.Random(seed)
    matches = sorted(((rng.randint(0, 40), rng.randint(0, 30), rng.randint(1, 8)) for _ in range(9)), key=lambda m: (m[0] + m[2], m))
    assert [c for c, _, _ in chain(matches, 5)] == [best_subset(matches, k, 5) for k in range(len(matches))]


def test_notices_and_ids():
    scanner = Scanner(TEMPLATES, PHRASES, notices())
    for text, label in (
        ("some prose. Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("# SPDX-License-Identifier: Apache-2.0", "apache"), ("Released under the ISC License", "isc"),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 work", "cc-by-nc-sa"), ("CC BY 4.0", "cc-by"), ("under the terms of the Eclipse Public License", "epl"),
    ):
        n, n_base, *_, base, labels, score, spans = scanner.scan(text.encode())
        assert (labels, score, {s["label"] for s in spans}) == (label, 1.0, {label}) and n_base == 0
    assert scanner.scan(b"Released under the GNU Lesser General Public License")[4:6] == ("gpl", "gpl,lgpl")
    assert scanner.scan(b"by the way, 4.0 of the public license")[5:7] == ("", 0.0)
    whole = scanner.scan(f"x {TEMPLATES['mit'][0]} y".encode())
    assert [(s["label"], s["start"], s["covered"]) for s in whole[-1]] == [("mit", 1, 1.0)]


def test_a_text_of_broken_phrases_is_scanned_in_linear_time():
    scanner = Scanner(TEMPLATES, PHRASES, notices())
    part = "permission is hereby granted free of charge the software is furnished to do so "
    began = time.time()
    assert scanner.scan((part * 100_000).encode())[0] == 1_400_000
    assert time.time() - began < 60
