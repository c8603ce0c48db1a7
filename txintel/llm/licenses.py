"""License scans by a generalised suffix automaton of licence texts.

The automaton accepts every run of tokens of every template. A file streams through it once: for each token it gives the
length of the longest run ending there that some template holds (the matching statistic) and, from the state and its suffix
links, all templates and places where that run or a shorter end of it stands. Runs that can't be longer become matches; of
each template, the matches that follow each other in file and template and cover most tokens are chained, and the chain's
tokens over the template's are its coverage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.bpe import _schema
from txintel.llm.text import remembered, slices
from txintel.runtime import ship_package, table

# Phrases of the contract and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Whole texts of common public licences, a file each; a file's name up to its first hyphen or full stop is the label.
TEXTS = Path(__file__).parent / "license_texts"
#: Words of a file that a chain may take, as a multiple of its template's.
STRETCH = 2

# Short public licence notices, by label. Numbers of versions are tokens like any other.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license. See the LICENSE file for details."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def templates() -> list[tuple[str, str]]:
    """(label, text) of the short notices and of the whole texts."""
    return [*TEMPLATES, *((re.split(r"[-.]", f.name)[0], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt")))]


#: A-Z to a-z, what else is ASCII and neither digit nor letter to a space; words then are what bytes.split() finds.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_CHUNK = 1 << 20


def license_words(text: bytes | None) -> Iterator[list[bytes]]:
    """Lists of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    folded, at = (text or b"").translate(_FOLD), 0
    while len(folded) - at > _CHUNK:
        cut = folded.find(b" ", at + _CHUNK)
        if cut < 0:
            break
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()


@dataclass
class Automaton:
    """Generalised suffix automaton over token ids. ends: for each state, (template, end) of every place of its runs."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the runs through p only."""
        twin = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = twin
            p = self.link[p]
        return twin

    def extend(self, last: int, token: int) -> int:
        if token in self.step[last]:
            q = self.step[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for at, token in enumerate(tokens):
            last = self.extend(last, token)
            self.ends[last].append((template, at + 1))

    def finish(self, shortest: int) -> None:
        """Hands places up the suffix links: a shorter run ends wherever a longer one that it closes does. Runs under shortest
        tokens make no matches and get none."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= shortest:
                self.ends[self.link[s]] += self.ends[s]

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run ending here) for each token."""
        at, length = 0, 0
        for token in tokens:
            while at and token not in self.step[at]:
                at = self.link[at]
                length = self.length[at]
            if token in self.step[at]:
                at, length = self.step[at][token], length + 1
            yield at, length


class Scanner:
    """Templates, their tokens and automaton; built where it is used."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], shortest: int, covered: float):
        self.labels, self.shortest, self.covered = [x for x, _ in templates], shortest, covered
        cut = [list(chain.from_iterable(license_words(t.encode()))) for _, t in templates]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(cut)), 1)}
        self.tokens = [[self.ids[w] for w in c] for c in cut]
        self.sizes = [len(c) for c in cut]
        self.least = min(shortest, *self.sizes)
        self.automaton = Automaton()
        for k, c in enumerate(self.tokens):
            self.automaton.add(k, c)
        self.automaton.finish(self.least)
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.lasts = {p[-1] for p, _ in self.phrases}
        self.before = max(len(p) for p, _ in self.phrases) - 1

    def possible(self, runs: list[tuple[list[int], int]]) -> set[int]:
        """Templates that chains of the runs could cover enough of: no chain has more of a template than all that its matches, at
        whatever place of the file, have of it together. Takes the runs' tokens once and then each state of the automaton once,
        however often a text repeats itself."""
        a, most = self.automaton, {}
        for tokens, _ in runs:
            for state, length in a.statistics(tokens):
                if length >= self.least and length > most.get(state, 0):
                    most[state] = length
        for state in list(most):
            state = a.link[state]
            while a.length[state] >= self.least and most.get(state, 0) < a.length[state]:
                most[state] = a.length[state]
                state = a.link[state]
        marks: dict[int, np.ndarray] = {}
        for state, length in most.items():
            for template, end in a.ends[state]:
                if template not in marks:
                    marks[template] = np.zeros(self.sizes[template] + 1, np.int64)
                marks[template][max(0, end - length)] += 1
                marks[template][end] -= 1
        return {k for k, m in marks.items() if np.count_nonzero(np.cumsum(m)) >= self.covered * self.sizes[k]}

    def matches(self, tokens: list[int], at: int, only: set[int] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(template, start in file, start in template, tokens) of all runs of tokens, from place at on, that stand in a template
        (of only, where given) and can be made longer there at neither end."""
        a = self.automaton
        for k, (state, length) in enumerate(a.statistics(tokens)):
            after, seen = tokens[k + 1] if k + 1 < len(tokens) else 0, set()
            while length >= self.least:
                for place in a.ends[state]:
                    if place not in seen:
                        seen.add(place)
                        template, end = place
                        if only is not None and template not in only:
                            continue
                        size = self.sizes[template]
                        if length >= min(self.shortest, size) and (end == size or self.tokens[template][end] != after):
                            yield template, at + k + 1 - length, end - length, length
                state = a.link[state]
                length = a.length[state]

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, coverage) of chains of matches that cover enough of their template.

        A match follows one that starts before it in file and template, what they share counting once, and a chain takes at most
        STRETCH times its template's words of the file. Of each template the chains that cover most come first; others that
        share words of the file with them are left out.
        """
        out = []
        by: dict[int, list] = {}
        for template, *match in found:
            by.setdefault(template, []).append(match)
        for template, matches in by.items():
            size = self.sizes[template]
            start, there, n = np.array(sorted(matches), np.int64).T
            best, first = n.copy(), start.copy()
            low = 0
            for i in range(1, len(n)):
                while start[i] - start[low] > STRETCH * size:
                    low += 1
                w = slice(low, i)
                skip = np.maximum(0, np.maximum(there[w] + n[w] - there[i], start[w] + n[w] - start[i]))
                gain = np.where((there[w] < there[i]) & (start[w] < start[i]) & (skip < n[i]) & (start[i] + n[i] - first[w] <= STRETCH * size), best[w] + n[i] - skip, 0)
                if len(gain):
                    top = gain.max()
                    if top > best[i]:
                        k = low + int(np.argmax(np.where(gain == top, first[w], -1)))  # the shortest such chain
                        best[i], first[i] = top, first[k]
            taken: list[tuple[int, int]] = []
            for i in np.lexsort((start, -best)).tolist():
                a, b = int(first[i]), int(start[i] + n[i])
                if best[i] < self.covered * size:
                    break
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((template, a, b - 1, min(1.0, float(best[i]) / size)))
        return sorted(out)

    def scan(self, text: bytes | None) -> dict:
        """Words, phrase places (label, first word) and covered template spans (label, first, last, coverage) of one text."""
        n, places, runs, spans, held, run, run_at = 0, [], [], [], [], [], 0
        apart = STRETCH * max(self.sizes)

        def chained() -> None:
            """Chains of the runs held, of templates that there can be any of."""
            if only := self.possible(runs):
                spans.extend(self.chains([m for tokens, at in runs for m in self.matches(tokens, at, only)]))
            runs.clear()

        def closed(tokens: list[int], at: int) -> None:
            """Holds a run of known tokens, after chaining what lies too far back to be chained with it."""
            if runs and at - runs[-1][1] - len(runs[-1][0]) > apart:
                chained()
            runs.append((tokens, at))

        for some in license_words(text):
            ids = np.fromiter((self.ids.get(w, 0) for w in some), np.int64, len(some))
            if not self.lasts.isdisjoint(some):
                all_ = held + some
                for k in range(len(held), len(all_)):
                    if all_[k] in self.lasts:
                        places += [(label, n - len(held) + k + 1 - len(p)) for p, label in self.phrases if k + 1 >= len(p) and all_[k + 1 - len(p) : k + 1] == p]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
            for a, b in edge.reshape(-1, 2).tolist():
                if a == 0 and run and run_at + len(run) == n:
                    run += ids[a:b].tolist()
                else:
                    if len(run) >= self.least:
                        closed(run, run_at)
                    run, run_at = ids[a:b].tolist(), n + a
                if b < len(ids) and len(run) < self.least:
                    run = []
            n += len(some)
            held = (held + some)[-self.before :] if self.before else []
        if len(run) >= self.least:
            closed(run, run_at)
        chained()
        return {"n_words": n, "places": places, "spans": [(self.labels[t], a, b, c) for t, a, b, c in spans]}


def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, shortest: int = 4, covered: float = 0.8, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_words, places, spans) for every row.

    known: (label, text) of the templates, by default the notices and whole texts here. places: (label, word) of every phrase,
    where its words stand consecutively; spans: (label, first_word, last_word, coverage) of chains of runs of at least shortest
    tokens (or a whole shorter template) that cover at least the share covered of a template. A null or empty text has no words, places or spans. Rows keep their number and repeats.
    """
    ship_package(docs.sparkSession)
    rest, said = list(keep), tuple((phrases or PHRASES).items())
    shared = docs.sparkSession.sparkContext.broadcast((tuple(map(tuple, known or templates())), said))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = remembered(("licenses", *shared.value, shortest, covered), lambda: Scanner(list(shared.value[0]), dict(shared.value[1]), shortest, covered))
        place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
        for part, texts in slices(batches, text_col):
            got = [scanner.scan(t) for t in texts]
            places = pa.array([[{"label": a, "word": w} for a, w in g["places"]] for g in got], place_type)
            spans = pa.array([[{"label": a, "first_word": x, "last_word": y, "coverage": c} for a, x, y, c in g["spans"]] for g in got], span_type)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array([g["n_words"] for g in got], pa.int64()), places, spans], names=[*rest, "n_words", "places", "spans"])

    schema = _schema(docs.select(*rest), "n_words bigint, places array<struct<label: string, word: bigint>>, spans array<struct<label: string, first_word: bigint, last_word: bigint, coverage: double>>")
    return docs.select(*rest, text_col).mapInArrow(run, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """The contract's columns. score: 1 where a phrase stands, else the best coverage of a template, else 0."""
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(c)["label"] for c in cols)))), ",")
    return license_scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.col("places")["word"]).alias("first_word"),
        F.array_max(F.col("places")["word"]).alias("last_word"),
        labels("places").alias("base_labels"),
        labels("places", "spans").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("spans")["coverage"]), F.lit(0.0))).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["first_word"].alias("first_word"), s["last_word"].alias("last_word"))).alias("spans"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and covered licences in every document of the whole table; license_scan says what odd rows give."""
    return license_report(table(spark, sf_dir, "documents"))
