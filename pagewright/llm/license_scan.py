"""Licence scans by a generalised suffix automaton over licence tokens.

The automaton holds every run of words of every template. A text's words stream through it: at each word it knows the
longest run ending there that some template holds (the matching statistics), and a phrase ends at a word exactly when the
phrase's state is an ancestor of the current one in the suffix-link tree. Long maximal matches are then chained, template by
template, into spans in the template's order, from every place of the template that a match may stand for; a label is given
when a chain covers enough of its template, and each further chain beside it that does is a span too. Short notices are
phrases, found like those that always count. A word that no template holds resets the automaton, so only runs of known words are
walked.

Defined cases: a null or empty text has no words, no places, empty labels and score zero; texts are read whole; repeated
rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import utf8

#: The phrases that always count, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts of public licences, or the notices that stand for long ones, with their labels.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ],
}

#: Names of licences and their labels, the sentences that name one, and licence ids.
NAMES = {
    "MIT License": "mit", "Apache License": "apache", "GNU General Public License": "gpl", "GNU Lesser General Public License": "lgpl", "GNU Affero General Public License": "agpl",
    "Mozilla Public License": "mpl", "Eclipse Public License": "epl", "BSD License": "bsd", "ISC License": "isc", "Boost Software License": "boost", "zlib License": "zlib",
}
SENTENCES = ("licensed under the {}", "released under the {}", "distributed under the {}", "under the terms of the {}")
IDS = {"MIT": "mit", "Apache-2.0": "apache", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl", "EPL-2.0": "epl", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "BSL-1.0": "boost", "Zlib": "zlib", "Unlicense": "unlicense", "CC0-1.0": "cc0"}
TERMS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
VARIANTS = ((), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND"))
VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def notices() -> dict[str, list[str]]:
    """Short notices by label: sentences that name a licence, SPDX lines, and the Creative Commons family by its terms and versions."""
    out: dict[str, list[str]] = {}
    for name, label in NAMES.items():
        out.setdefault(label, []).extend(sentence.format(name) for sentence in SENTENCES)
    for name, label in IDS.items():
        out.setdefault(label, []).append(f"SPDX-License-Identifier: {name}")
    for variant in VARIANTS:
        label = "-".join(["cc-by", *(x.lower() for x in variant)])
        short, long = "-".join(["BY", *variant]), "-".join(["Attribution", *(TERMS[x] for x in variant)])
        for version in VERSIONS:
            out.setdefault(label, []).extend([f"CC {short} {version}", f"Creative Commons {long} {version}"])
    return out


_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LONG = 5
COVERED = 0.6
GAP = 30
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"


def words(text: bytes) -> list[bytes]:
    """Lower-case words: digits, letters and all bytes beyond ASCII."""
    return text.translate(_KEEP).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over words; state 0 is the root. ``places``: for each template that holds the state, the last word's position of all its occurrences."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)

    def _new(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.step) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, word: bytes) -> int:
        """The state of the run that ends in ``last`` with one word more."""
        if word in self.step[last]:
            q = self.step[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new


def build(templates: list[list[bytes]], phrases: list[list[bytes]]) -> Automaton:
    """The automaton of all templates and phrases. ``phrases[state]`` lists the phrases (number, length) that are suffixes of what the state stands for."""
    a = Automaton()
    for run in (*templates, *phrases):
        last = 0
        for word in run:
            last = a.extend(last, word)
    for t, run in enumerate(templates):
        state = 0
        for at, word in enumerate(run):
            state = up = a.step[state][word]
            while up > 0:
                a.places[up].setdefault(t, []).append(at)
                up = a.link[up]
    ends: dict[int, list[tuple[int, int]]] = {}
    for number, run in enumerate(phrases):
        state = 0
        for word in run:
            state = a.step[state][word]
        ends.setdefault(state, []).append((number, len(run)))
    a.phrases = [[] for _ in a.step]
    for state in sorted(range(1, len(a.step)), key=a.length.__getitem__):
        a.phrases[state] = a.phrases[a.link[state]] + ends.get(state, [])
    return a


def statistics(a: Automaton, text: list[bytes], known: frozenset[bytes]) -> Iterator[tuple[int, int, int]]:
    """For each known word: its position, the state and length of the longest match ending there."""
    state = length = 0
    before = -2
    for at in [k for k, w in enumerate(text) if w in known]:
        if at != before + 1:
            state = length = 0
        before, word = at, text[at]
        while state and word not in a.step[state]:
            state = a.link[state]
            length = a.length[state]
        state, length = a.step[state][word], length + 1
        yield at, state, length


def maximal(stats: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """The matches of ``least`` words or more that the next word doesn't lengthen: last position, state, length."""
    follows = [*stats, (-1, 0, 0)][1:]
    return [s for s, n in zip(stats, follows, strict=True) if s[2] >= least and not (n[0] == s[0] + 1 and n[2] == s[2] + 1)]


def chain(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """For each match the best chain that ends with it, of matches (text start, template start, length) that advance in the text and the template: covered words, first and last position in the text."""
    best: list[tuple[int, int]] = []
    for k, (x, y, n) in enumerate(matches):
        covered, start = n, x
        for j in range(k - 1, -1, -1):
            xj, yj, nj = matches[j]
            if x - (xj + nj) > gap:
                break
            new = min(n, x + n - (xj + nj), y + n - (yj + nj))
            if yj + nj <= y + n and new > 0 and yj < y and best[j][0] + new > covered:
                covered, start = best[j][0] + new, best[j][1]
        best.append((covered, start))
    return [(covered, start, x + n - 1) for (covered, start), (x, _, n) in zip(best, matches, strict=True)]


def outside(matches: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The matches' parts outside the taken ranges of the text (first and last word), by their ends."""
    out = []
    for x, y, n in matches:
        stop = x + n
        k = max(0, bisect(taken, (x,)) - 1)
        while k < len(taken) and taken[k][0] < stop:
            first, last, _ = taken[k]
            if last >= x:
                if first > x:
                    out.append((x, y, first - x))
                x, y = last + 1, y + last + 1 - x
            k += 1
        if x < stop:
            out.append((x, y, stop - x))
    return sorted(out, key=lambda m: (m[0] + m[2], m))


def chains(matches: list[tuple[int, int, int]], size: int, gap: int, least: float) -> list[tuple[int, int, int]]:
    """The best chain, then the best beside it as long as one covers ``least`` of the template: first and last word, covered words; in the text's order."""
    taken: list[tuple[int, int, int]] = []
    again = True
    while again and matches:
        again = False
        between = [list(part) for _, part in groupby(matches, key=lambda m: bisect(taken, (m[0],)))]
        for covered, start, end in sorted((c for part in between for c in chain(part, gap)), key=lambda c: -c[0]):
            covered = min(covered, size)
            if taken and covered / size < least:
                break
            k = bisect(taken, (start + 1,))
            if k and taken[k - 1][1] >= end:
                continue
            if (k and taken[k - 1][1] >= start) or (k < len(taken) and taken[k][0] <= end):
                again = True
                break
            taken.insert(k, (start, end, covered))
        if again:
            matches = outside(matches, taken)
    return taken


class Scanner:
    """Scans texts for templates, phrases and notices. ``long``: least length of a match that is chained; ``covered``: share of a template that gives its label.

    Notices are phrases too, found wherever they stand whole; they give spans and labels, but don't count as base.
    """

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], short: dict[str, list[str]] | None = None, long: int = LONG, covered: float = COVERED, gap: int = GAP):
        runs = [(label, words(text.encode())) for label, texts in templates.items() for text in texts]
        self.template_labels, self.sizes = [x for x, _ in runs], [len(x) for _, x in runs]
        also = [(label, text) for label, texts in (short or {}).items() for text in texts]
        self.n_phrases = len(phrases)
        self.phrase_labels = [*phrases.values(), *(label for label, _ in also)]
        self.a = build([x for _, x in runs], [words(x.encode()) for x in [*phrases, *(text for _, text in also)]])
        self.known = frozenset(self.a.step[0])
        self.long, self.covered, self.gap = long, covered, gap

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score and spans."""
        run = words(text)
        stats = list(statistics(self.a, run, self.known))
        n, first, last, base, spans = 0, None, None, set(), []
        for at, state, length in stats:
            for number, size in self.a.phrases[state]:
                if size > length:
                    continue
                start = at - size + 1
                if number >= self.n_phrases:
                    spans.append({"label": self.phrase_labels[number], "start": start, "end": at, "covered": 1.0})
                else:
                    n, first, last = n + 1, start if first is None else min(first, start), start if last is None else max(last, start)
                    base.add(self.phrase_labels[number])
        by: dict[int, list[tuple[int, int, int]]] = {}
        for at, state, length in maximal(stats, self.long):
            for t, ends in self.a.places[state].items():
                by.setdefault(t, []).extend((at - length + 1, end - length + 1, length) for end in ends)
        score = 1.0 if base or spans else 0.0
        for t, matches in sorted(by.items()):
            for start, end, covered in chains(matches, self.sizes[t], self.gap, self.covered):
                share = covered / self.sizes[t]
                score = max(score, share)
                if share >= self.covered:
                    spans.append({"label": self.template_labels[t], "start": start, "end": end, "covered": share})
        labels = base | {s["label"] for s in spans}
        return len(run), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, short: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document, by ``SCHEMA``. Positions count words from 0; spans are inclusive."""
    templates, phrases, short = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, notices() if short is None else short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, short)
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            cols = list(zip(*found, strict=True)) if found else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, SCHEMA)
