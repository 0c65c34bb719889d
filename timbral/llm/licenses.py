"""License notices by template markup, compiled into token automata.

A template is mandatory wording with two kinds of marks: {words} is optional,
<n> stands for a replaceable region of up to n words of any wording; a|b is a choice of
words. A template compiles to a nondeterministic automaton over words; a text has the
template's label if some stretch of its words is accepted, so mandatory wording must
match word for word, while optional and replaceable regions may be there or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from timbral.llm.common import LOWER_ALNUM, map_arrow

# The phrases of the contract, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Wording of public licenses and their notices as templates, by label: the short
# notices first, then whole texts. The first word of each is mandatory.
NO_WARRANTY = (
    "this software is provided by <12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "{1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "{2} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
GNU_NOTICE = (
    "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version <2> of the license or {{at your option}} any later version "
    "{0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1}general public license for more details"
)
TEMPLATES = (
    ("mit", "licensed|released|distributed|available|published|provided {<3>} under the {terms of the} {<2>} mit license"),
    ("mit", "mit license {copyright <12>} permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed|released|distributed|available|published|provided {<3>} under the {terms of the} apache license {version} 2 {0}"),
    ("apache-2", "apache license version 2 0 {the license} {you may not use this file except in compliance with the license}"),
    ("cc-by-nc", "licensed|released|distributed|available|published|provided {<3>} under {<3>} cc by nc {nd|sa} {2|3|4} {0}"),
    ("cc-by-nc", "creative commons attribution {<1>} noncommercial|non {commercial} {<3>} license"),
    ("cc-by", "creative commons attribution {<1>} {sharealike|share} {alike} {<2>} international|unported license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or|distribute {distribute} this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed|released|distributed|available {<3>} under the {terms of the} gnu {lesser|affero} general public license"),
    ("mpl-2", "licensed|released|distributed|available|subject {<3>} under|to the {terms of the} mozilla public license {v|version} {2} {0}"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice {including the next paragraph} shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement|non {infringement} "
        "in no event shall <12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause", f"{BSD_TWO} {NO_WARRANTY}"),
    ("bsd-3-clause", f"{BSD_TWO} {{3}} neither the name of <12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {NO_WARRANTY}"),
    (
        "isc",
        "permission to use copy modify and or|distribute {distribute} this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <12> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache-2",
        "licensed {<12>} under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http|https www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", GNU_NOTICE.format("this <2>", "")),
    ("lgpl", GNU_NOTICE.format("this <2>", "lesser ")),
    ("agpl", GNU_NOTICE.format("this <2>", "affero ")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http|https {www} mozilla org mpl 2 0"),
)


@dataclass
class Automaton:
    """States are numbers; step by word, by any word, or freely (closed over when built)."""

    label: str
    first: frozenset[bytes] = frozenset()
    by_word: list[dict[bytes, int]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    final: int = 0
    closure: list[frozenset[int]] = field(default_factory=list)

    def state(self, depth: int) -> int:
        self.by_word.append({})
        self.any_word.append(None)
        self.free.append([])
        self.depth.append(depth)
        return len(self.by_word) - 1

    def close(self) -> None:
        for s in range(len(self.by_word)):
            seen, stack = {s}, [s]
            while stack:
                for t in self.free[stack.pop()]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            self.closure.append(frozenset(seen))

    def run(self, words: list[bytes], at: int) -> tuple[int | None, float]:
        """Where the longest accepted stretch from at ends (None: none), and the share of mandatory words reached."""
        now, end, best, total = self.closure[0], None, 0, self.depth[self.final]
        for i in range(at, len(words)):
            then: set[int] = set()
            for s in now:
                if (t := self.by_word[s].get(words[i])) is not None:
                    then |= self.closure[t]
                    best = max(best, self.depth[t])
                if (t := self.any_word[s]) is not None:
                    then |= self.closure[t]
            if not then:
                break
            now = frozenset(then)
            if self.final in now:
                end = i + 1
        return end, best / total


def compile_template(label: str, text: str) -> Automaton:
    a = Automaton(label)
    marks = re.findall(r"[{}]|<\d+>|[^\s{}<>]+", text)
    if not marks or marks[0][0] in "{}<":
        raise ValueError(f"a template's first word is mandatory: {text[:40]!r}")

    def chain(at: int, i: int, depth: int, optional: bool) -> tuple[int, int, int]:
        while i < len(marks) and marks[i] != "}":
            m = marks[i]
            if m == "{":
                end, i, _ = chain(at, i + 1, depth, True)
                join = a.state(depth)
                a.free[end].append(join)
                a.free[at].append(join)
                at = join
            elif m[0] == "<":
                stops = [at]
                for _ in range(int(m[1:-1])):
                    nxt = a.state(depth)
                    a.any_word[stops[-1]] = nxt
                    stops.append(nxt)
                join = a.state(depth)
                for s in stops:
                    a.free[s].append(join)
                at = join
            else:
                depth += not optional
                fresh = a.state(depth)
                nxt = a.state(depth)
                a.free[at].append(fresh)
                for w in m.split("|"):
                    a.by_word[fresh][w.encode()] = nxt
                at = nxt
            i += 1
        return at, i, depth

    a.state(0)
    a.final = chain(0, 0, 0, False)[0]
    a.first = frozenset(w.encode() for w in marks[0].split("|"))
    a.close()
    return a


def places(words: list[bytes], phrase: list[bytes]) -> Iterator[int]:
    """Every start, overlapping ones too."""
    at, k = -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return
        if words[at : at + k] == phrase:
            yield at


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.phrases = [(label, p.encode(), p.encode().split()) for label, p in phrases.items()]
        self.automata = [compile_template(*t) for t in templates]
        self.starts = frozenset().union(*(a.first for a in self.automata))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], set[str], float]:
        """Words, base places (start, label), labels of accepted templates, and a score: 1 for an accepted
        template or a base place, else the largest share of a template's mandatory words that came in order."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ALNUM).split()
        joined = b" ".join(words)
        base = [(at, label) for label, p, ws in self.phrases if p in joined for at in places(words, ws)]
        labels: set[str] = set()
        score = 1.0 if base else 0.0
        if not self.starts.isdisjoint(words):
            for at, w in enumerate(words):
                if w in self.starts:
                    for a in self.automata:
                        if w in a.first and (got := a.run(words, at)):
                            score = max(score, got[1] if got[0] is None else 1.0)
                            if got[0] is not None:
                                labels.add(a.label)
        return len(words), base, labels, score


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row.

    A null or empty text has no words, no places (first_word and last_word null), empty
    labels and score 0. Repeated rows and null ids stay; an empty table gives no rows;
    other columns are dropped. Labels are distinct, sorted and comma-joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for b in batches:
            got = [scanner.scan(t) for t in b.column(1).to_pylist()]
            cols = [
                pa.array([g[0] for g in got], pa.int64()),
                pa.array([len(g[1]) for g in got], pa.int64()),
                pa.array([min((p for p, _ in g[1]), default=None) for g in got], pa.int64()),
                pa.array([max((p for p, _ in g[1]), default=None) for g in got], pa.int64()),
                pa.array([",".join(sorted({x for _, x in g[1]})) for g in got], pa.string()),
                pa.array([",".join(sorted({x for _, x in g[1]} | g[2])) for g in got], pa.string()),
                pa.array([g[3] for g in got], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
