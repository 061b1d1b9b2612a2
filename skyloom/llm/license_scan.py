"""License scans by template-markup matching.

A template is wording with two kinds of markup, as in public license templates: `<<opt>>..<</opt>>` encloses words that
may be missing, `<<var:n>>` stands for up to n words that may be replaced by any others. It is compiled into an automaton
over tokens; the automaton accepts a run of words exactly if all mandatory wording is there, in order, with nothing else
between than the markup allows. All templates share one automaton, which is started only at words that can begin one.
An attempt reads at most the longest template's length, so a text is scanned in time proportional to its words.

Beside the templates, base phrases are counted wherever their words stand consecutively.

Null text counts as empty: no words, no places, null first_word and last_word, empty labels, score 0. Repeated rows
each get their row; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices, spread, table, utf8

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Well-known license texts and the notices that apply a license, with their optional and replaceable parts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<opt>>"<</opt>>Software<<opt>>"<</opt>>), to deal in the Software without restriction"""
_MIT_REST = """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
    IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and<<opt>>/or<</opt>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_ISC_REST = """. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
    IN NO EVENT SHALL <<var:10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = """: <<opt>>1<</opt>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<opt>>2<</opt>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """ <<opt>>3<</opt>> Neither the name of <<var:10>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_REST = """ THIS SOFTWARE IS PROVIDED BY <<var:10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL <<var:10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var:3>> except in compliance with the License. You may obtain a copy of the License at
    <<opt>>http<</opt>><<opt>>https<</opt>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This <<var:4>> is free software<<opt>>:<</opt>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
    either version {0} of the License, or (at your option) any later version. This <<var:4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
#: (label, template). A label alone stands for the whole text of a license or, with `notice`, of the notice that applies it;
#: `grant` for the first sentence of a license only, `mention` for a statement that names one.
TEMPLATES = (
    ("mit", _MIT + _MIT_REST),
    ("mit-grant", _MIT),
    ("isc", _ISC + _ISC_REST),
    ("isc-grant", _ISC),
    ("bsd-2-clause", _BSD + _BSD_TWO + _BSD_REST),
    ("bsd-3-clause", _BSD + _BSD_TWO + _BSD_THREE + _BSD_REST),
    ("bsd-grant", _BSD),
    ("apache-2.0-notice", _APACHE_NOTICE),
    ("gpl-2.0-notice", _GPL_NOTICE.format(2)),
    ("gpl-3.0-notice", _GPL_NOTICE.format(3)),
    ("mit-mention", "<<opt>>This <<var:3>> is<</opt>> <<opt>>released<</opt>> <<opt>>licensed<</opt>> under the MIT License"),
    ("apache-2.0-mention", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0-mention", "<<opt>>This <<var:3>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> GNU General Public License, <<opt>>version 3<</opt>>"),
    ("gpl-3.0-mention", "GNU General Public License<<opt>> as published by the Free Software Foundation<</opt>>, <<opt>>either<</opt>> version 3<<opt>> of the License<</opt>>"),
    ("gpl-2.0-mention", "GNU General Public License<<opt>> as published by the Free Software Foundation<</opt>>, <<opt>>either<</opt>> version 2<<opt>> of the License<</opt>>"),
    ("lgpl-mention", "GNU Lesser General Public License"),
    ("lgpl-mention", "GNU Library General Public License"),
    ("mpl-2.0-mention", "subject to the terms of the Mozilla Public License, <<opt>>v. 2.0<</opt>><<opt>>version 2.0<</opt>>"),
    ("cc-by-nc-4.0", "<<opt>>Licensed under<</opt>> CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "<<opt>>Licensed under<</opt>> CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "<<opt>>Licensed under<</opt>> CC BY-ND 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 <<opt>>International<</opt>> <<opt>>Public<</opt>> License"),
    ("cc0-1.0", "CC0 1.0 <<opt>>Universal<</opt>>"),
    ("copyright", "Copyright <<opt>>(c)<</opt>> <<var:24>> All rights reserved"),
)

#: Byte table: A-Z to lower case, ASCII that isn't a letter or digit to a blank; other bytes (of non-ASCII characters) stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

ANY = None


def words_of(text: bytes) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, as UTF-8."""
    return text.translate(FOLD).split()


def parse(template: str) -> list:
    """Nested items: a word, ("opt", items) or ("var", n). Punctuation vanishes as in texts."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<[^<>]*>>|<</opt>>)", template):
        if part == "<<opt>>":
            stack.append([])
        elif part == "<</opt>>":
            if len(stack) < 2:
                raise ValueError(f"markup closes what isn't open: {template}")
            items = stack.pop()
            if items:
                stack[-1].append(("opt", items))
        elif m := re.fullmatch(r"<<var:(\d+)>>", part):
            stack[-1].append(("var", int(m[1])))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            stack[-1] += words_of(part.encode())
    if len(stack) > 1:
        raise ValueError(f"markup isn't closed: {template}")
    return stack[0]


class Automaton:
    """A nondeterministic token automaton without empty moves, run with sets of states that are cached as one deterministic state."""

    def __init__(self, templates=TEMPLATES):
        self.moves: list[dict] = [{}]  # state -> {word or ANY: [next states]}
        self.empty: list[list[int]] = [[]]
        self.accept: dict[int, tuple[str, int]] = {}
        for label, template in templates:
            items = parse(template)
            need = sum(isinstance(x, bytes) for x in items)
            if not need:
                raise ValueError(f"no mandatory wording: {template}")
            self.accept[self._add(items, 0)] = (label, need)
        self.start = self._close({0})
        self.known: dict = {}
        self.first = {w for s in self.start for w in self.moves[s]}
        if ANY in self.first:
            raise ValueError("a template must not begin with replaceable words")

    def _state(self) -> int:
        self.moves.append({})
        self.empty.append([])
        return len(self.moves) - 1

    def _add(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                self.moves[at].setdefault(x, []).append(n := self._state())
                at = n
            elif x[0] == "opt":
                inner = self._state()
                self.empty[at].append(inner)
                end = self._add(x[1], inner)
                out = self._state()
                self.empty[at].append(out)
                self.empty[end].append(out)
                at = out
            else:
                out = self._state()
                self.empty[at].append(out)
                for _ in range(x[1]):
                    self.moves[at].setdefault(ANY, []).append(n := self._state())
                    self.empty[n].append(out)
                    at = n
                at = out
        return at

    def _close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in states:
                    states.add(n)
                    todo.append(n)
        return frozenset(states)

    def step(self, states: frozenset[int], word: bytes):
        """The next states and what they accept; cached by the words that the states name, so the cache is bounded by the templates."""
        named = self.known.get(states)
        if named is None:
            named = self.known[states] = ({w for s in states for w in self.moves[s]}, {})
        word = word if word in named[0] else ANY
        if word not in named[1]:
            nxt = self._close({n for s in states for w in {word, ANY} for n in self.moves[s].get(w, ())})
            named[1][word] = nxt, [self.accept[s] for s in nxt if s in self.accept]
        return named[1][word]

    def matches(self, words: list[bytes], start: int) -> list[tuple[str, int, int]]:
        """(label, mandatory words, end) of each acceptance of a run from `start`."""
        states, found = self.start, []
        for i in range(start, len(words)):
            states, accepted = self.step(states, words[i])
            if not states:
                break
            found += [(label, need, i + 1) for label, need in accepted]
        return found


@lru_cache(8)
def compiled(templates=TEMPLATES) -> Automaton:
    return Automaton(templates)


def scan(text: bytes, automaton: Automaton, phrases: list[tuple[list[bytes], str]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of (label, start, end)."""
    words = words_of(text)
    starts = automaton.first
    by_first: dict[bytes, list] = {}
    for p in phrases:
        by_first.setdefault(p[0][0], []).append(p)
    places, base, labels, best, spans = [], set(), set(), 0, []
    for i in [i for i, w in enumerate(words) if w in starts or w in by_first]:
        for p, label in by_first.get(words[i], ()):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
                best = max(best, len(p))
        if words[i] in starts:
            for label, need, end in automaton.matches(words, i):
                labels.add(label)
                best = max(best, need)
                spans.append((label, i, end))
    both = ",".join(sorted(base | labels))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), both, best / (best + 2), spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """A row of SCHEMA, with spans of template matches in words, for every row of docs. score: m / (m + 2), m being the mandatory words of the longest match."""
    ship(docs.sparkSession)
    split = [(words_of(p.encode()), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))]
        for b in slices(batches):
            rows = [scan(t, automaton, split) for t in utf8(b.column(1))]
            cols = list(zip(*rows)) if rows else [()] * 8
            cols[7] = [[{"label": x, "start": s, "stop": e} for x, s, e in v] for v in cols[7]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return spread(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")).mapInArrow(run, SCHEMA + ", spans array<struct<label string, start long, stop long>>")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def pattern(items: list) -> str:
    """A template's items as a regular expression over words that each end in a blank."""
    part = lambda x: f"{x.decode()} " if isinstance(x, bytes) else f"(?:{pattern(x[1])})?" if x[0] == "opt" else f"(?:[^ ]+ ){{0,{x[1]}}}"
    return "".join(map(part, items))


def _oracle() -> str:
    """DuckDB SQL: templates as regular expressions over the words."""
    items = [(label, parse(t)) for label, t in TEMPLATES]
    found = [(label, sum(isinstance(x, bytes) for x in i), f"regexp_matches(s, ' {pattern(i)}')") for label, i in items]
    split = [([x.decode() for x in words_of(p.encode())], label) for p, label in PHRASES]
    longest = max(len(p) for p, _ in split)
    leads = ", ".join(f"lead(w0, {k}) OVER (PARTITION BY rid ORDER BY i) AS w{k}" for k in range(1, longest))
    places = " UNION ALL ".join(f"SELECT rid, i, '{label}' AS label, {len(p)} AS n FROM k WHERE {' AND '.join(f"w{j} = '{x}'" for j, x in enumerate(p))}" for p, label in split)
    labels = ", ".join(f"CASE WHEN {c} THEN '{label}' END" for label, _, c in found)
    best = ", ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for _, n, c in found)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS (SELECT *, {leads} FROM (SELECT rid, unnest(w) AS w0, unnest(range(0, len(w))) AS i FROM t)),
b AS (SELECT rid, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, list(DISTINCT label) AS base, max(n) AS best FROM ({places}) GROUP BY rid),
u AS (SELECT *, list_filter([{labels}], lambda x: x IS NOT NULL) AS found, greatest({best}) AS most FROM (SELECT rid, doc_id, len(w)::BIGINT AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t))
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(found, coalesce(base, [])))), ',') AS labels, greatest(most, coalesce(best, 0))::DOUBLE / (greatest(most, coalesce(best, 0)) + 2) AS score
FROM u LEFT JOIN b USING (rid)"""


ORACLE = _oracle()
