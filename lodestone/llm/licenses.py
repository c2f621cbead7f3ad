"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates' words (lower case, letters and figures alone) give hashes of K-word windows; winnowing keeps the least of
each run of WINDOW of them, at its last place. The index of those, hash to template and place, is small and fixed, and
goes to every worker with the code. A document's windows that are in the index are hits (its own windows aren't
winnowed, so a template's fingerprint is found wherever its words stand). Hits of a template that lie near one diagonal
make a candidate; the document's part around it is aligned with the template inside a band around that diagonal, which
gives the matched words, the coverage of the template and the span in the text. A short notice has fewer words than a
fingerprint run; its windows are all kept.

A template of more than SHORT words whose parts lie on several diagonals, as where more than BAND words were put into
it, is then chained: of its windows outside the matches found so far the longest run that rises in text and template,
and the words between them, near them. Coverage is that of the whole chain, whatever lies between its parts.
A template that names a license matches only where the license's name and version stand in the matched parts (TELLING)
and no word denies it there or just before (DENIALS).

Rows are independent: no shuffle, one row in memory; a band's cells are bounded by the template's length.

Defined results: null, empty and wordless texts have no match; texts of any length are searched whole; an empty table
gives no rows; repeated rows give repeated results; a text that holds a
template several times gives a match for each place; of matches whose parts overlap the one with more matched words
stays, of equal ones the first template by name; a match between the parts of another stays too. Other columns aren't
looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_columns, span_hashes, table

K, WINDOW, BAND = 3, 4, 8
#: Share of a template's words that a match has at least.
COVERAGE = 0.7
#: Templates of so many words or fewer have to stand in one band.
SHORT = 16

# Public texts of licenses and of the notices that refer to them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved",
    "all-rights-reserved-work": "All rights reserved. No part of this work may be reproduced without permission",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _named(name: str, version: str | None = None) -> re.Pattern:
    """A name and, if given, the first number after it, or one of a list of numbers there, as a whole; 2 is 2.0."""
    if version is None:
        return re.compile(rf"(?<![^\W_])(?:{name})(?![^\W_])", re.IGNORECASE)
    words, listed = r"(?:[\W_]+[^\W\d_]+){0,16}?[\W_]*", r"(?:\d+(?:\.\d+)*[\W_]+(?:(?:or|and|versions?|v)[\W_]*)*)*"
    return re.compile(rf"(?<![^\W_])(?:{name})(?![^\W\d_]){words}(?<!\d)(?<!\d\.){listed}{version}(?:\.0)*(?!\.?\d)", re.IGNORECASE)


_GAP = r"[\W_]+"
_APACHE, _MIT = _named("apache", "2"), _named("mit")
_GPL = rf"gnu{_GAP}(?:general{_GAP}public{_GAP}licen[sc]e|gpl)"
# The name and version that must stand in a match of these templates.
TELLING = {
    "apache-2.0-notice": _APACHE,
    "apache-2.0-header": _APACHE,
    "cc-by-4.0-notice": _named(rf"cc{_GAP}by(?!{_GAP}(?:nc|sa|nd)(?![^\W_]))", "4"),
    "cc-by-nc-4.0-notice": _named(rf"cc{_GAP}by{_GAP}nc(?!{_GAP}(?:sa|nd)(?![^\W_]))", "4"),
    "cc-by-sa-4.0-notice": _named(rf"cc{_GAP}by{_GAP}sa", "4"),
    "cc-by-4.0-work": _named(rf"creative{_GAP}commons{_GAP}attribution(?!{_GAP}(?:non[\W_]*commercial|share[\W_]*alike|no[\W_]*deriv))", "4"),
    "gpl-2.0-notice": _named(_GPL, "2"),
    "gpl-3.0-notice": _named(_GPL, "3"),
    "gpl-3.0-work": _named(_GPL, "3"),
    "mit-notice": _MIT,
    "mit-licensed": _MIT,
    "mpl-2.0-notice": _named(rf"mozilla{_GAP}public{_GAP}licen[sc]e|mpl", "2"),
}

# Words that turn a notice round, put into it or just before it.
DENIALS = frozenset("not never isn aren wasn cannot nicht pas".split())
_TOKEN = re.compile(r"(?<![^\W_])[vV](?=\d)|[^\W_]+")  # v2 is v, 2
_NUMBER = re.compile(r"(?:\.?\d)*")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words of letters and figures in lower case, with their starts and ends in code points of the text."""
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    return [text[a:b].lower() for a, b in at], [a for a, _ in at], [b for _, b in at]


def token_hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    sizes = np.array([len(w.encode()) for w in words], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    return span_hashes(np.frombuffer(data, np.uint8), start, start + sizes) if words else np.zeros(0, np.uint64)


def windows(h: np.ndarray, k: int = K) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * _STEP + h[i : len(h) - k + 1 + i]
    return out


def winnow(g: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: of each run of window hashes the least, the last of equal ones; all of a short list."""
    if len(g) <= 2 * window:
        return list(range(len(g)))
    runs = np.lib.stride_tricks.sliding_window_view(g, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(1)).tolist()


class Index:
    """Templates by fingerprint."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [tokens(templates[n])[0] for n in self.names]
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.telling = [TELLING.get(n) if templates[n] == TEMPLATES.get(n) else None for n in self.names]
        self.grams: set[tuple[str, ...]] = set()  # the fingerprints' words
        self.places: list[dict[tuple[str, ...], list[int]]] = []  # of each template, all windows' words with their places
        for t, words in enumerate(self.words):
            g = windows(token_hashes(words))
            for i in winnow(g):
                self.at[int(g[i])].append((t, i))
            self.grams.update(tuple(words[i : i + K]) for i in winnow(g))
            self.places.append(defaultdict(list))
            for i in range(len(words) - K + 1):
                self.places[t][tuple(words[i : i + K])].append(i)
        self.keys = np.sort(np.array(list(self.at), np.uint64))


def align(doc: list[str], template: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, and the first and last matched place of doc: the longest common subsequence inside a band.

    Template word j may be matched with doc word j + shift + d, |d| <= band. A cell's value is (matches, start, -end), so
    of equal matches the tightest is kept: the one that starts last, and of those the one that ends first.
    """
    width = 2 * band + 1
    prev: list[tuple[int, int, int]] = [(0, 0, 1)] * width
    for j, w in enumerate(template):
        now: list[tuple[int, int, int]] = []
        for d in range(width):
            i = j + shift + d - band
            best = prev[d + 1] if d + 1 < width else (0, 0, 1)  # this template word has no match
            if d and now[d - 1] > best:
                best = now[d - 1]  # this word of the text has none
            if 0 <= i < len(doc) and doc[i] == w:
                m, s, _ = prev[d]
                hit = (m + 1, s if m else i, -i)
                best = max(best, hit)
            now.append(best)
        prev = now
    m, s, e = max(prev)
    return m, s, -e


def common(doc: list[str], template: list[str]) -> list[int]:
    """The places in doc of a longest common subsequence with template, late ones first."""
    size = [[0] * (len(template) + 1) for _ in range(len(doc) + 1)]
    for i, w in enumerate(doc):
        for j, x in enumerate(template):
            size[i + 1][j + 1] = size[i][j] + 1 if w == x else max(size[i][j + 1], size[i + 1][j])
    out, i, j = [], len(doc), len(template)
    while i and j:
        if doc[i - 1] == template[j - 1] and size[i][j] == size[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(i)
        elif size[i - 1][j] >= size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def chain(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The longest run of hits (place in text, place in template) that rises in both; of equal ones the one that starts last."""
    best: list[tuple[int, int, int]] = [(0, 0, 1)] * size  # by place in the template, of the runs that end there: hits, start, last hit negated
    before = [-1] * len(hits)
    for at, (i, j) in enumerate(hits):  # by i, of equal ones the greatest j first
        n, start, last = max(best[:j], default=(0, 0, 1))
        before[at] = -last
        best[j] = max(best[j], (n + 1, start if n else i, -at))
    out, at = [], -max(best)[2]
    while at >= 0:
        out.append(hits[at])
        at = before[at]
    return out[::-1]


def chained(words: list[str], template: list[str], hits: list[tuple[int, int]]) -> list[int]:
    """The places in the text that a chain of hits matches: its windows' words, and those between and beside them.

    Between two windows as many words of the text as the template has there, and BAND more, are compared at either end.
    """
    run = chain(hits, len(template))
    got = {i + k for i, _ in run for k in range(K)}
    bounds = [(-1, -1), *((i + k, j + k) for i, j in run for k in range(K)), (len(words), len(template))]
    seen: list[tuple[int, int]] = []
    for x in sorted(set(bounds)):
        if not seen or (x[0] > seen[-1][0] and x[1] > seen[-1][1]):
            seen.append(x)
    got &= {i for i, _ in seen}
    for (i, j), (p, q) in zip(seen, seen[1:], strict=False):
        room = q - j - 1 + BAND
        if q - j > 1 and p - i > 1:
            at = list(range(i + 1, p))
            if i < 0:
                at = at[-room:]
            elif p == len(words):
                at = at[:room]
            elif len(at) > 2 * room:
                at = at[:room] + at[-room:]
            got.update(at[k] for k in common([words[k] for k in at], template[j + 1 : q]))
    return sorted(got)


def parts_of(places: list[int]) -> list[tuple[int, int]]:
    """First and last places of the parts: runs with no more than BAND words between two of them."""
    cut = [k for k in range(1, len(places)) if places[k] - places[k - 1] > BAND + 1]
    return [(places[a], places[b - 1]) for a, b in zip([0, *cut], [*cut, len(places)], strict=True)]


def matches(text: str | None, index: Index, least: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(template, start, end, matched words, coverage): places in code points of the text, in order."""
    if not text:
        return []
    said = _TOKEN.findall(text.lower())
    if index.grams.isdisjoint(zip(*(said[i:] for i in range(K)), strict=False)):
        return []  # no fingerprint's words stand here
    words, starts, ends = tokens(text)
    g = windows(token_hashes(words))
    found = []
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in np.flatnonzero(np.isin(g, index.keys)).tolist():
        for t, j in index.at[int(g[i])]:
            hits[t].append((i - j, i))

    def put(t: int, m: int, parts: list[tuple[int, int]]) -> None:
        if telling := index.telling[t]:
            there = " ".join(text[starts[a] : _NUMBER.match(text, ends[e]).end()] for a, e in parts)
            if not telling.search(there):
                return
            own = set(index.words[t])
            if any(w in DENIALS and w not in own for a, e in parts for w in words[max(0, a - 4) : e + 1]):
                return
        found.append((index.names[t], starts[parts[0][0]], ends[parts[-1][1]], m, m / len(index.words[t]), parts))

    for t, diagonals in hits.items():
        template, last, near = index.words[t], None, []
        for shift, _ in sorted(diagonals):
            if last is not None and shift - last <= BAND // 2:
                continue  # the band around the last candidate holds this one
            last = shift
            m, a, e = align(words, template, shift)
            if m >= least * len(template):
                put(t, m, [(a, e)])
                near.append((a, e))
        if len(template) <= SHORT:
            continue
        near.sort()
        heads, places = [a for a, _ in near], index.places[t]
        reach = np.maximum.accumulate([e for _, e in near]).tolist() if near else []
        inside = lambda i: (k := bisect_right(heads, i + K - 1)) and reach[k - 1] >= i  # noqa: E731, B023
        left = [(i, j) for i, w in enumerate(zip(*(words[k:] for k in range(K)), strict=False)) if w in places and not inside(i) for j in reversed(places[w])]
        while K * len({j for _, j in left}) >= least * len(template) / 2 and len({i - j for i, j in left}) > 1:
            at = chained(words, template, left)
            if len(at) < least * len(template):
                break
            put(t, len(at), parts_of(at))
            used = set(at)
            left = [(i, j) for i, j in left if used.isdisjoint(range(i, i + K))]
    kept: list[tuple] = []
    taken: list[tuple[int, int]] = []  # the parts of those kept, in order; they don't overlap
    for x in sorted(found, key=lambda x: (-x[3], -x[4], x[0], x[1])):
        at = [bisect_right(taken, (b, len(words))) for _, b in x[5]]
        if all(not k or taken[k - 1][1] < a for k, (a, _) in zip(at, x[5], strict=True)):
            kept.append(x)
            for part in x[5]:
                insort(taken, part)
    return [x[:5] for x in sorted(kept, key=lambda x: (x[1], x[0]))]


_BUILT: dict[int, Index] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """doc_id and licenses: an array of name, start, stop, matched, coverage."""
    given = templates or TEMPLATES
    name = hash(tuple(sorted(given.items())))

    def run(c: dict) -> dict:
        if name not in _BUILT:
            _BUILT[name] = Index(given)
        return {"doc_id": c["doc_id"], "licenses": [[{"name": n, "start": a, "stop": b, "matched": m, "coverage": v} for n, a, b, m, v in matches(t, _BUILT[name], least)] for t in c["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, licenses array<struct<name string, start long, stop long, matched long, coverage double>>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names or holds."""
    got = scan_licenses(table(spark, sf_dir, "documents"))
    said = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["stop"].cast("string"), F.format_number(x["coverage"], 3)))
    return got.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(said, ",").alias("licenses"))
