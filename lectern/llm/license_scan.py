"""License statements in texts: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER_AZ, in_small_batches

#: Words of a lower-cased text as UTF-8: digits, small letters, and every character beyond ASCII.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Templates and their labels. <<opt>> ... <<end>> may be left out; <<var:n>> stands for up to n words.
#: The licences and notices with their whole mandatory wording, then sentences that
#: name one, whatever they say of it, with labels of their own (-mention); a notice that holds such a sentence has both labels.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the <<var:8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<opt>> 3 <<end>> neither the name of <<var:12>> nor the names of <<var:8>> contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
        "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
        "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<var:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache-2.0",
        "licensed under the apache license <<opt>> version <<end>> 2 0 the license you may not use this <<var:3>> except in compliance with the license you may obtain a copy of the license at <<opt>> http <<end>> <<opt>> https <<end>> www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation <<opt>> either version <<var:1>> of the license or at your option any later version <<end>>"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v <<opt>> <<end>> 2 0"),
    ("notice", "copyright <<opt>> c <<end>> <<var:40>> all rights reserved"),
    ("mit-mention", "<<opt>> released <<end>> <<opt>> licensed <<end>> under the <<opt>> terms of the <<end>> mit license"),
    ("bsd-mention", "<<opt>> released <<end>> <<opt>> licensed <<end>> under the <<opt>> 2 clause <<end>> <<opt>> 3 clause <<end>> bsd license"),
    ("cc-by-nc", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by nc <<opt>> <<var:1>> 0 <<end>>"),
    ("cc-by-sa", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by sa <<opt>> <<var:1>> 0 <<end>>"),
    ("cc-by", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> creative commons attribution <<var:2>> license"),
    ("gpl-3-mention", "licensed under the gnu general public license <<opt>> version <<end>> 3"),
    ("apache-2.0-mention", "under the <<opt>> terms of the <<end>> apache license <<opt>> version <<end>> 2 0"),
    ("gpl-2-mention", "licensed under the gnu general public license <<opt>> version <<end>> 2"),
)


@dataclass(frozen=True)
class LicenseConfig:
    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)
    phrases: tuple[tuple[str, str], ...] = field(default=PHRASES)


class Automaton:
    """A template as states with word moves, free moves and any-word moves. State 0 is the start, the last one accepts."""

    def __init__(self, label: str, template: str):
        self.label, self.words = label, 0
        self.moves: list[dict[bytes, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        opened, mandatory = [], set()

        def state() -> int:
            self.moves.append({})
            self.free.append([])
            self.any.append(None)
            return len(self.moves) - 1

        at = 0
        for part in re.findall(r"<<[^>]*>>|[^\s<]+", template.lower()):
            if part == "<<opt>>":
                opened.append(at)
            elif part == "<<end>>":
                self.free[opened.pop()].append(at)
            elif part.startswith("<<var:"):
                stops = []
                for _ in range(int(part[6:-2])):
                    stops.append(at)
                    self.any[at] = after = state()
                    at = after
                for stop in stops:
                    self.free[stop].append(at)
            else:
                word = part.encode()
                self.moves[at][word] = after = state()
                at = after
                self.words += 1
                if not opened:
                    mandatory.add(word)
        if opened:
            raise ValueError(f"an optional region of {label} has no end")
        self.mandatory = frozenset(mandatory)
        self.first = frozenset(w for s in self._reached({0}) for w in self.moves[s])
        self.open_start = any(self.any[s] is not None for s in self._reached({0}))

    def _reached(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from start; start itself if none is accepted."""
        states, end, last = self._reached({0}), start, len(self.moves) - 1
        for k in range(start, len(words)):
            step = set()
            for s in states:
                if (to := self.moves[s].get(words[k])) is not None:
                    step.add(to)
                if self.any[s] is not None:
                    step.add(self.any[s])
            if not step:
                break
            states = self._reached(step)
            if last in states:
                end = k + 1
        return end


def places(words: list[bytes], wanted: list[bytes]) -> list[int]:
    """Every start at which the wanted words stand one after another."""
    found, at = [], -1
    try:
        while True:
            at = words.index(wanted[0], at + 1)
            if words[at : at + len(wanted)] == wanted:
                found.append(at)
    except ValueError:
        return found


class LicenseMatcher:
    def __init__(self, cfg: LicenseConfig):
        self.automata = [Automaton(*t) for t in cfg.templates]
        self.phrases = [([w.encode() for w in phrase.split()], label) for phrase, label in cfg.phrases]

    def report(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans of templates)."""
        words = _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER_AZ))
        known, base, starts = set(words), set(), []
        for phrase, label in self.phrases:
            if known.issuperset(phrase) and (found := places(words, phrase)):
                base.add(label)
                starts += found
        labels, score, spans = set(base), 0.5 if base else 0.0, []
        for a in self.automata:
            if a.mandatory <= known:
                begins = range(len(words)) if a.open_start else sorted(k for w in a.first & known for k in places(words, [w]))
                done = 0
                for k in begins:
                    if k >= done and (end := a.match(words, k)) > k:
                        labels.add(a.label)
                        spans.append((a.label, k, end))
                        score, done = max(score, 0.5 + 0.5 * min(1.0, (end - k) / max(1, a.words))), end
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(spans, key=lambda s: s[1:])


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
_KINDS = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]


def scan_licenses(docs: DataFrame, cfg: LicenseConfig = LicenseConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A report on each row of docs, in one pass over whole texts and without a shuffle.

    A template is tried in a text only if the text holds all its mandatory words. Its longest accepted run is taken;
    runs of one template don't overlap. score: 0 without a label, 0.5 with base phrases alone, and up to 1 by the share
    of a template's words, optional ones included, that the best run holds.

    Defined cases: null text is empty: no words and labels, positions null; a null id is carried; repeated rows each
    come back; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LicenseMatcher(cfg)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(zip(*(matcher.report(t or "") for t in batch.column(1).to_pylist())))
            spans = [[{"label": a, "start": b, "end": c} for a, b, c in row] for row in columns.pop()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip([*columns, spans], _KINDS[1:]))], [c.split()[0] for c in _SCHEMA.split(", ")])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
