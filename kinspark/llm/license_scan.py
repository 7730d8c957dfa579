"""Licence scans with a generalised suffix automaton of licence templates.

The automaton is built over the words of all templates. A document streams through it word by word, which gives its
matching statistics: at each word the longest stretch ending there that stands in a template. Stretches that cannot be
extended and are long enough are chained, in document order, into covered spans of each template they stand in; a
template of which enough words are covered, in order, gives its label.

A word pair that stands in no template ends every stretch, so pairs are looked up first as array operations and only
what lies between two such breaks walks through the automaton.

Cases: a null or empty text has no words and no labels; texts of any length are read whole; repeated rows are judged
alike; a tie between templates gives both labels; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import arrow_rows, rows_of

# Phrases that give a label wherever their words stand one after another.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Public licence texts and notices, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved.",
    ],
}

#: Shortest stretch that counts (a whole template always does) and the share of a template that must be covered.
LEAST_MATCH, LEAST_COVER = 4, 0.75
#: Words that may stand between two stretches of a chain, beside twice what the template has there.
GAP = 24

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters than ASCII, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_KEEP).split() if text else []


class LicenceAutomaton:
    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None):
        self.phrases = BASE_PHRASES if phrases is None else phrases
        self.texts = [(label, words_of(t)) for label, ts in sorted((TEMPLATES if templates is None else templates).items()) for t in ts]
        words = sorted({w for _, ws in self.texts for w in ws} | {w for p in self.phrases.values() for w in words_of(p)})
        self.ids = {w: i for i, w in enumerate(words)}
        self.none = len(words)
        self.coded = [[self.ids[w] for w in ws] for _, ws in self.texts]
        self.pairs = np.zeros((self.none + 1, self.none + 1), bool)
        for c in self.coded:
            self.pairs[c[:-1], c[1:]] = True
        self.base = {label: [self.ids[w] for w in words_of(p)] for label, p in self.phrases.items()}
        self.least = min([3, *(len(c) for c in self.coded if c)])  # words of a run that is worth a walk
        self.nexts: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # for each state, the places (template, last word) of its stretches
        for t, c in enumerate(self.coded):
            last = 0
            for i, w in enumerate(c):
                last = self._add(last, w)
                self.ends[last].setdefault(t, []).append(i)
        for s in sorted(range(1, len(self.nexts)), key=lambda s: -self.length[s]):
            for t, where in self.ends[s].items():
                self.ends[self.link[s]].setdefault(t, []).extend(where)

    def _add(self, last: int, c: int) -> int:
        """The state of the stretch that ends with c, after the one of `last`."""
        nexts, link, length = self.nexts, self.link, self.length
        if c in nexts[last]:
            q = nexts[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nexts[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, out: dict[int, int]) -> int:
        self.nexts.append(out)
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.nexts) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.nexts[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.nexts[p].get(c) == q:
            self.nexts[p][c] = clone
            p = self.link[p]
        return clone

    def matches(self, coded: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(last word, length, state) of the stretches that cannot be extended."""
        ok = self.pairs[coded[:-1], coded[1:]]
        at = np.flatnonzero(ok)
        if not len(at):
            return
        breaks = np.flatnonzero(np.diff(at) > 1)
        starts, stops = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + 1
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a + 1 < self.least:
                continue
            state = size = 0
            for i in range(a, b + 1):
                c = int(coded[i])
                if c not in self.nexts[state]:
                    if size:
                        yield i - 1, size, state
                    while state and c not in self.nexts[state]:
                        state = self.link[state]
                        size = self.length[state]
                if c in self.nexts[state]:
                    state = self.nexts[state][c]
                    size += 1
            if size:
                yield b, size, state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """(base places (first word, label), spans (first word, end, label, share of the template))."""
        if len(words) < 2:
            return [], []
        get, none = self.ids.get, self.none
        coded = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        places = []
        for label, p in self.base.items():
            n = len(coded) - len(p) + 1
            if n > 0 and len(at := np.flatnonzero(coded[:n] == p[0])):
                for i, w in enumerate(p[1:], 1):
                    at = at[coded[at + i] == w]
                places += [(int(i), label) for i in at]
        chains: dict[int, Chains] = {}
        for last, size, state in self.matches(coded):
            for t, where in self.ends[state].items():
                if size < min(LEAST_MATCH, len(self.coded[t])):
                    continue
                for e in where:
                    chains.setdefault(t, Chains(len(self.coded[t]))).add(last - size + 1, last + 1, e - size + 1, e + 1)
        spans = []
        for t, found in chains.items():
            total = len(self.coded[t])
            spans += [(a, b, self.texts[t][0], covered / total) for a, b, covered in found.spans(LEAST_COVER * total)]
        return sorted(places), sorted(spans)


class Chains:
    """Best chains of stretches of one template, in document and template order; each ends with another stretch.

    A chain is (covered words, first word, end, place in the template).
    """

    def __init__(self, words: int):
        self.reach = 2 * words + GAP  # no stretch that begins further on can go on with a chain
        self.open: list[tuple[int, int, int, int]] = []
        self.done: list[tuple[int, int, int, int]] = []

    def add(self, a: int, b: int, ta: int, tb: int) -> None:
        """A stretch goes on with the chain that then covers most, or begins one. Stretches come in the order of their ends."""
        if self.open and a - self.open[0][2] > self.reach:
            self.done += [c for c in self.open if a - c[2] > self.reach]
            self.open = [c for c in self.open if a - c[2] <= self.reach]
        best = (tb - ta, a)
        for covered, first, end, place in self.open:
            if place < tb and end <= b and a - end <= 2 * (ta - place) + GAP:
                best = max(best, (covered + tb - max(ta, place), first))
        self.open.append((*best, b, tb))

    def spans(self, least: float) -> list[tuple[int, int, int]]:
        """(first word, end, covered) of chains that cover at least so much; of those that share words the one that covers most."""
        out: list[tuple[int, int, int]] = []  # apart from each other, in the order of the text
        for covered, first, end, _ in sorted((c for c in self.done + self.open if c[0] >= least), key=lambda c: (-c[0], c[1], c[2])):
            at = bisect.bisect_left(out, (first,))
            if (at == 0 or out[at - 1][1] <= first) and (at == len(out) or end <= out[at][0]):
                out.insert(at, (first, end, covered))
        return out


@functools.lru_cache(maxsize=1)
def automaton() -> LicenceAutomaton:
    return LicenceAutomaton()


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places array<struct<start, label>>, spans array<struct<start, end, label, cover>>). No shuffle."""
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton()

        def rows():
            for batch in batches:
                for key, text in rows_of(batch, "k", "t"):
                    words = words_of(text)
                    places, spans = own.scan(words)
                    yield key, len(words), [{"start": s, "label": x} for s, x in places], [{"start": a, "end": b, "label": x, "cover": c} for a, b, x, c in spans]

        yield from arrow_rows(rows(), schema)

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(run, f"`{id_col}` long, n_words long, places array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string,cover:double>>")
