"""Licence scans by template-markup matching.

A template is wording with marked regions: ``<<optional>>...<<end>>`` may be absent,
``<<var:a|b>>`` stands for one of the listed wordings and ``<<any:n>>`` for up to n words.
Each template is compiled into an automaton over words; a text is accepted where the
automaton reaches its end, i.e. where all mandatory wording matches exactly. Case,
punctuation and spacing are not wording.

Templates hold the whole mandatory wording of a licence text, or a whole notice: one that only
begins like it is not accepted. Where several templates fit, all their labels are given, each
with the score of its best place.

Base phrases are found beside the templates, at every place. Null text is empty. A
document without any find has empty labels, null places and score 0. Repeated rows are
scanned one by one, an empty table gives an empty result, and only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkit
from .shared import in_arrow, text_bytes

#: Phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What several texts share: the first rights and the disclaimers of the MIT and BSD families.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<<end>> to deal in <<var:the software|this software>> without restriction including without limitation the rights"
    " to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
)
_MIT_NOTICE = "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"
_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<var:noninfringement|non infringement>> in no event shall <<any:12>>"
    " be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " <<optional>><<var:1|a>><<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " <<optional>><<var:2|b>><<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "<<optional>><<var:3|c>><<end>> neither the <<var:name|names>> of <<any:16>> nor the names of <<var:its|their|any>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = (
    "this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:14>> be liable for any direct"
    " indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract"
    " strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_LICENSED = "licensed under <<optional>>the terms of<<end>> the"


def _gnu(name: str, version: str) -> list[str]:
    """The notices of a GNU licence: its usual paragraph, and one line."""
    short = {"general": "gpl", "lesser general": "lgpl", "affero general": "agpl"}[name]
    return [
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation either version {version} <<optional>><<var:0|1>><<end>> of the license or at your option any later version",
        f"{_LICENSED} gnu {name} public license <<optional>>as published by the free software foundation either<<end>> version {version}",
        f"spdx license identifier {short} {version} <<var:0|1>> <<optional>><<var:only|or later>><<end>>",
    ]


#: Licence texts and notices with their marked regions.
TEMPLATES = {
    "mit": [
        f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_DISCLAIMER}",
        "<<var:released|licensed|distributed|available>> under the <<optional>>terms of the<<end>> mit <<optional>>x11<<end>> license",
        "spdx license identifier mit",
    ],
    "mit-0": [f"{_MIT_GRANT} {_MIT_DISCLAIMER}", "spdx license identifier mit 0"],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use <<var:this file|these files|this work>> except in compliance with the license you may obtain a copy of the license at <<var:http|https>> www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license <<optional>>version<<end>> 2 <<optional>>0<<end>> <<optional>>the license<<end>>",
        "spdx license identifier apache 2 0",
    ],
    "bsd-2": [f"{_BSD_GRANT} {_BSD_DISCLAIMER}", f"{_LICENSED} bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd-3": [f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}", f"{_LICENSED} bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "isc": [
        "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and <<any:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:8>> be liable for any special direct indirect or consequential damages"
        " or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "spdx license identifier isc",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " <<optional>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " <<optional>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<optional>>3<<end>> this notice may not be removed or altered from any source distribution",
        "spdx license identifier zlib",
    ],
    "cc-by-nc": [
        "licensed under <<optional>>a<<end>> <<var:cc by nc|creative commons attribution non commercial|creative commons attribution noncommercial>> <<optional>><<var:2 0|2 5|3 0|4 0>><<end>>",
    ],
    "cc-by-sa": ["licensed under <<optional>>a<<end>> <<var:cc by sa|creative commons attribution sharealike|creative commons attribution share alike>> <<optional>><<var:2 0|2 5|3 0|4 0>><<end>>"],
    "gpl-2": _gnu("general", "2"),
    "gpl-3": _gnu("general", "3"),
    "lgpl-3": _gnu("lesser general", "3"),
    "agpl-3": _gnu("affero general", "3"),
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var:http|https>> <<optional>>www<<end>> mozilla org mpl 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "spdx license identifier unlicense",
    ],
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(optional|end|var:[^>]*|any:\d+)>>")
ANY = b"*"

RESULT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
]


def split_words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


@dataclass
class Automaton:
    """Words to states; state 0 starts, `end` accepts. free: states reached without a word."""

    steps: list[dict[bytes, set[int]]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    end: int = 0
    mandatory: int = 0

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _word(self, at: int, word: bytes) -> int:
        to = self._state()
        self.steps[at].setdefault(word, set()).add(to)
        return to

    @classmethod
    def compile(cls, template: str) -> Automaton:
        a, at, opened = cls(), 0, []
        for i, part in enumerate(_MARK.split(template)):
            if i % 2 == 0:
                for w in split_words(part.encode()):
                    at = a._word(at, w)
                    a.mandatory += not opened
            elif part == "optional":
                opened.append(at)
            elif part == "end":
                a.free[opened.pop()].add(at)
            elif part.startswith("var:"):
                join, starts = a._state(), at
                for choice in part[4:].split("|"):
                    at = starts
                    for w in split_words(choice.encode()):
                        at = a._word(at, w)
                    a.free[at].add(join)
                at = join
            else:
                join = a._state()
                a.free[at].add(join)
                for _ in range(int(part[4:])):
                    at = a._word(at, ANY)
                    a.free[at].add(join)
                at = join
        if opened:
            raise ValueError("an optional region is not closed")
        a.end = at
        return a

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.steps[s]}

    def accept(self, words: list[bytes], at: int) -> int | None:
        """One past the last word of the longest acceptance from `at` on, or None."""
        states, best = self.closure({0}), None
        while True:
            if self.end in states:
                best = at
            if at >= len(words):
                return best
            word = words[at]
            states = {t for s in states for key in (word, ANY) for t in self.steps[s].get(key, ())}
            if not states:
                return best
            states, at = self.closure(states), at + 1


class Scanner:
    """All templates and base phrases, entered only at words that can begin one."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]):
        self.by_word: dict[bytes, list[tuple[str, Automaton]]] = {}
        rare: set[bytes] = set()
        for label, texts in templates.items():
            for t in texts:
                a = Automaton.compile(t)
                for w in a.first_words():
                    self.by_word.setdefault(w, []).append((label, a))
                rare |= self._anchor(a)
        self.base = [(split_words(p.encode()), label) for p, label in base.items()]
        rare |= {max(p, key=len) for p, _ in self.base}
        self.anchors = re.compile(b"|".join(map(re.escape, sorted(rare))))

    @staticmethod
    def _anchor(a: Automaton) -> set[bytes]:
        """A set of words of which every acceptance holds one: those before the end on all ways, the longest if it is mandatory."""
        words = {w for s in a.steps for w in s if w != ANY}
        for w in sorted(words, key=len, reverse=True):
            todo, seen = [0], {0}
            while todo:
                s = todo.pop()
                for t in {*a.free[s], *(t for key, to in a.steps[s].items() if key != w for t in to)} - seen:
                    seen.add(t)
                    todo.append(t)
            if a.end not in seen:
                return {w}
        return a.first_words() or words

    def scan(self, text: bytes) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places (word, label), and each label's best score."""
        low = text.lower()
        if not self.anchors.search(low):
            return [], {}
        words = _WORD.findall(low)
        places, scores = [], {}
        for phrase, label in self.base:
            for i, w in enumerate(words):
                if w == phrase[0] and words[i : i + len(phrase)] == phrase:
                    places.append((i, label))
                    scores[label] = max(scores.get(label, 0.0), 0.8)
        for i, w in enumerate(words):
            for label, a in self.by_word.get(w, ()):
                if label not in scores or scores[label] < 1.0:
                    end = a.accept(words, i)
                    if end is not None:
                        scores[label] = max(scores.get(label, 0.0), 0.9 + 0.1 * min(1.0, a.mandatory / max(1, end - i)))
        return sorted(places), scores


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates, base = templates or TEMPLATES, base or BASE
    rows = documents.select("doc_id", text_bytes().alias("t"))

    def run(batches):
        scanner = Scanner(templates, base)
        for batch in batches:
            data, offsets = textkit.buffers(batch.column("t"))
            for lo, hi in textkit.ranges(offsets):
                _, first = textkit.words(data, offsets[lo : hi + 1])
                part = batch.slice(lo, hi - lo)
                out = [scanner.scan(t) for t in part.column("t").to_pylist()]
                places = [[i for i, _ in p] for p, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(np.diff(first)), pa.array([len(p) for p in places], pa.int64()), pa.array([p[0] if p else None for p in places], pa.int64()), pa.array([p[-1] if p else None for p in places], pa.int64()),
                        pa.array([",".join(sorted({x for _, x in p})) for p, _ in out], pa.string()), pa.array([",".join(sorted(s)) for _, s in out], pa.string()), pa.array([max(s.values(), default=0.0) for _, s in out], pa.float64()),
                    ],
                    ["doc_id", *(f.name for f in RESULT)],
                )

    return in_arrow(rows, run, T.StructType([rows.schema["doc_id"], *RESULT]))


def base_places(documents: DataFrame) -> DataFrame:
    """What the base phrases alone give: doc_id, n_words, n_base, first_word, last_word, base_labels."""
    return scan_licenses(documents).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_LISTED = ", ".join(f"({p.split()}, '{label}')" for p, label in BASE.items())
BASE_SQL = f"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS rid,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  p AS (SELECT * FROM (VALUES {_LISTED}) AS t(phrase, label)),
  f AS (SELECT rid, i, label FROM (SELECT rid, w, phrase, label, unnest(range(len(w))) AS i FROM d, p WHERE list_has_all(w, phrase)) WHERE w[i + 1 : i + len(phrase)] = phrase),
  s AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN s USING (rid)
"""
