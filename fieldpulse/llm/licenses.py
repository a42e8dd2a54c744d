"""License scans by template-markup matching.

A template is license wording with regions: `[[ ... ]]` may be left out, `{{name 12}}` may be
replaced by up to 12 words of any kind. Each template is compiled into an automaton over words
whose other steps are exact, so a text is accepted only if all mandatory wording is there, in
order. A template is tried only on texts that hold its longest mandatory phrase, and only from
places where one of its possible first words stands.

Beside the templates' own labels, places of the three base phrases give the base labels.

Defined cases: a NULL or wordless text has no words, no labels and score 0; very long texts are
read whole; runs of one template do not overlap, those of several templates may, and each gives its
label; repeated rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm.registry import query, table
from fieldpulse.llm.text import plain_words

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and license notices.
TEMPLATES = {
    "mit-notice": "[[this {{subject 3}} is]] [[released]] [[licensed]] under the [[terms of the]] mit license",
    "apache-2.0": "licensed under the apache license version 2.0",
    "gpl-3.0": "licensed under the [[terms of the]] gnu [[affero]] [[lesser]] general public license [[as published by the free software foundation either]] version 3",
    "gpl-2.0": "licensed under the [[terms of the]] gnu [[lesser]] general public license version 2",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4.0",
    "cc-by-4.0": "licensed under [[a]] [[the]] creative commons attribution 4.0 [[international]] [[license]]",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this {{work 6}} to deal in the"
        " {{work 4}} without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the {{work 4}} and to permit persons to whom the {{work 4}} is"
        " furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " [[including the next paragraph]] shall be included in all copies or substantial portions of the {{work 4}}"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met [[1]] redistributions of source code must retain the above copyright notice"
        " this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the"
        " above copyright notice this list of conditions and the following disclaimer in the documentation and or other"
        " materials provided with the distribution"
    ),
    "apache-2.0-text": (
        "licensed under the apache license version 2.0 the license you may not use {{work 6}} except in compliance with"
        " the license you may obtain a copy of the license at {{address 10}} unless required by applicable law or agreed"
        " to in writing software distributed under the license is distributed on an as is basis without warranties or"
        " conditions of any kind either express or implied"
    ),
    "gpl-text": (
        "is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public"
        " license as published by the free software foundation either version {{version 2}} of the license or [[at your"
        " option]] any later version"
    ),
    "lgpl-text": (
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public"
        " license as published by the free software foundation either version {{version 2}} of the license or [[at your"
        " option]] any later version"
    ),
    "agpl-text": (
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public"
        " license as published by the free software foundation either version {{version 2}} of the license or [[at your"
        " option]] any later version"
    ),
    "mit-whole": (
        "permission is hereby granted free of charge to any person obtaining a copy of this {{work 6}} to deal in the"
        " {{work 4}} without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the {{work 4}} and to permit persons to whom the {{work 4}} is"
        " furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " [[including the next paragraph]] shall be included in all copies or substantial portions of the {{work 4}}"
        " the {{work 4}} is provided as is without warranty of any kind express or implied including but not limited to"
        " the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the"
        " {{holders 6}} be liable for any claim damages or other liability whether in an action of contract tort or"
        " otherwise arising from out of or in connection with the {{work 4}} or the use or other dealings in the {{work 4}}"
    ),
    "bsd-3-clause": (
        "neither the name of {{holder 12}} nor the names of [[its]] [[their]] [[the]] contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission"
    ),
    "bsd-disclaimer": (
        "this software is provided by {{holder 12}} as is and any express or implied warranties including but not limited to"
        " the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"
        " {{holder 12}} be liable for any direct indirect incidental special exemplary or consequential damages including"
        " but not limited to procurement of substitute goods or services loss of use data or profits or business"
        " interruption however caused and on any theory of liability whether in contract strict liability or tort"
        " including negligence or otherwise arising in any way out of the use of this software even if advised of the"
        " possibility of such damage"
    ),
    "isc": (
        "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2.0 [[if a copy of the mpl was not"
        " distributed with this file you can obtain one at {{address 10}}]]"
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license"
        " [[v]] [[version]] 2.0 [[which accompanies this distribution and]] [[which]] [[is available at {{address 10}}]]"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use"
        " compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
        " commercial or non commercial and by any means"
    ),
    "cc0-1.0": (
        "to the extent possible under law {{holder 12}} has waived all copyright and related or neighboring rights to {{work 8}}"
    ),
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] creative commons attribution sharealike 4.0 [[international]] [[license]]",
    "boost-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license the software to use reproduce display distribute execute and"
        " transmit the software and to prepare derivative works of the software and to permit third parties to whom the"
        " software is furnished to do so"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event [[will]] [[shall]] the"
        " {{authors 4}} be held liable for any damages arising from the use of this software permission is granted to"
        " anyone to use this software for any purpose including commercial applications and to alter it and redistribute"
        " it freely subject to the following restrictions"
    ),
}

MARKUP = re.compile(r"\[\[|\]\]|\{\{\w+ \d+\}\}|[^\s\[\]{}]+")
ANY = b""  # no word is empty


class TokenAutomaton:
    """Nondeterministic automaton over words: `step[state]` lists (word or ANY, next), `free[state]` moves without a word."""

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened, run, self.anchor = [], [], []
        state = 0
        for part in MARKUP.findall(template):
            if part == "[[":
                opened.append(state)
                run = []
            elif part == "]]":
                if not opened:
                    raise ValueError(f"]] without [[ in {template!r}")
                self.free[opened.pop()].append(state)
                run = []
            elif part.startswith("{{"):
                run = []
                begin = state
                skips = [begin]
                for _ in range(int(part.split()[1][:-2])):
                    state = self._to_new(state, ANY)
                    skips.append(state)
                for place in skips[:-1]:
                    self.free[place].append(state)
            else:
                for word in plain_words(part.encode()):
                    state = self._to_new(state, word)
                    run = [] if opened else [*run, word]
                    self.anchor = max(self.anchor, run, key=len)
        if opened:
            raise ValueError(f"[[ without ]] in {template!r}")
        if not self.anchor:
            raise ValueError(f"no mandatory wording in {template!r}")
        self.accepting = state
        self.closure = [self._reach(s) for s in range(len(self.step))]
        self.first = {word for s in self.closure[0] for word, _ in self.step[s]}
        self.phrase = b" " + b" ".join(self.anchor) + b" "

    def _to_new(self, state: int, word: bytes) -> int:
        self.step.append([])
        self.free.append([])
        self.step[state].append((word, len(self.step) - 1))
        return len(self.step) - 1

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def match(self, words: list[bytes], begin: int) -> int | None:
        """The largest end of an accepted run of words from `begin`."""
        states, end = self.closure[0], None
        for place in range(begin, len(words)):
            word = words[place]
            states = {r for s in states for w, to in self.step[s] if w == word or w == ANY for r in self.closure[to]}
            if not states:
                break
            if self.accepting in states:
                end = place + 1
        return end

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted runs from left to right, each as long as possible, without overlap."""
        out, free_from = [], 0
        for begin, word in enumerate(words):
            if begin >= free_from and (word in self.first or ANY in self.first):
                end = self.match(words, begin)
                if end is not None:
                    out.append((begin, end))
                    free_from = end
        return out


def phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ` phrase ` stands in the words joined by single spaces."""
    places, at, counted, number = [], line.find(phrase), 0, 0
    while at >= 0:
        number += line.count(b" ", counted, at)
        counted = at
        places.append(number)
        at = line.find(phrase, at + 1)
    return places


RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,"
    " score double, matches array<struct<label:string,begin:bigint,end:bigint>>"
)


def scan_words(words: list[bytes], automata: dict[str, TokenAutomaton]) -> tuple:
    """The values of RESULT for one text."""
    line = b" " + b" ".join(words) + b" "
    starts, base, covered, matches = [], set(), [], []
    for phrase, label in BASE_PHRASES.items():
        found = phrase_places(line, b" " + phrase.encode() + b" ")
        if found:
            base.add(label)
            starts += found
            covered += [(p, p + len(phrase.split())) for p in found]
    for label, automaton in automata.items():
        if automaton.phrase in line:
            matches += [(label, begin, end) for begin, end in automaton.places(words)]
    covered += [(begin, end) for _, begin, end in matches]
    n, reached = 0, 0
    for begin, end in sorted(covered):
        n += max(0, end - max(begin, reached))
        reached = max(reached, end)
    labels = sorted(base | {label for label, _, _ in matches})
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(labels), n / len(words) if words else 0.0, matches,
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and RESULT for every row; `matches` has the accepted runs of words."""
    automata = {label: TokenAutomaton(t) for label, t in (templates or TEMPLATES).items()}
    df = docs.select(F.col(row_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    types.append(pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_words(plain_words(raw.as_py()), automata) for raw in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            columns[-1] = [[{"label": m[0], "begin": m[1], "end": m[2]} for m in ms] for ms in columns[-1]]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {id_type}, {RESULT}")


@query("op10_license_scan")
def op10_license_scan(spark, folder):
    return scan(table(spark, folder, "documents")).drop("matches")
