"""Flight numbers against a plain version."""

import random
import re

from pagewright.functions.flights import BEHIND, BETWEEN, CODES, LETTERS, STROKES, with_flight_number


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text):
    compact = re.sub("[^A-Z0-9]", "", re.sub(r"\b(FLT|FLIGHT|NO|CHECK)\b", " ", text.upper()))
    for code in CODES:
        if code in compact:
            tail = compact[compact.index(code) + len(code) :][:1]
            return code + (tail if tail.isdigit() else "")
    if not compact:
        return ""
    if compact.isdigit():
        return compact if len(compact) < 5 and compact.strip("0") else ""
    read = []
    for k, c in enumerate(compact):
        inner = 0 < k < len(compact) - 1 and compact[k - 1].isdigit() and compact[k + 1].isdigit()
        read.append(c if c.isdigit() else LETTERS.get(c) or (BETWEEN.get(c) if inner else None) or " ")
    runs = [(sum(c.isdigit() for c in compact[m.start() : m.end()]), m.end() - m.start(), m.start(), m[0]) for m in re.finditer("[0-9]+", "".join(read))]
    runs = [r for r in runs if r[0] and r[1] in (3, 4)]
    if runs:
        *_, start, digits = max(runs)
        letters = re.sub("[0-9]", "", compact[:start])
        return ("" if not letters else "A" if letters == "A" else "CM") + digits
    tail = re.fullmatch("CMP?(.{1,4})", compact)
    if tail and (len(tail[1]) > 2 or re.search("[0-9]", tail[1])) and all(c.isdigit() or c in BEHIND for c in tail[1]):
        return "CM" + "".join(BEHIND.get(c, c) for c in tail[1])
    token, last = (compact[:-1], compact[-1]) if len(compact) > 2 and compact[-1].isdigit() else (compact, "")
    stroke = lambda c: next((g[0] for g in STROKES if c in g), c)
    costs = sorted((sum(stroke(a) != stroke(b) for a, b in zip(token, c, strict=True)) if len(c) == len(token) else edits(token, c), abs(len(c) - len(token)), c) for c in CODES)
    if len(token) > 1 and costs[0][0] < 2 and costs[0][:2] != costs[1][:2]:
        return costs[0][2] + last
    return ""


def test_flight_numbers(spark):
    rng = random.Random(6)
    made = ["".join(rng.choice(["C", "M", "CM", "P", "A", "S", "5", "7", "0", "1", "8", "T", "K", "V", "U", "D", "9", " ", "-", "flt ", "no", "TCK", "SV", "O", "I"]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    texts = [*made, "7S8", "cmIO3", "CMPBA3", "4C2", "cm 40", "S9V", "52V", "JCK", "ZCC", "SVCVISIT", "SV3", "A123", "0000", "12345", "é758"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "k int, reading string").selectExpr("*", "1 AS code")
    got = {r.k: r.flight for r in with_flight_number(df, "reading", "flight").collect()}
    assert got.pop(-1) == ""
    assert {texts[k]: v for k, v in got.items()} == {t: plain(t) for t in texts}
