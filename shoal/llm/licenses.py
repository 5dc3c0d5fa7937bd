"""Licence scans: a generalised suffix automaton over licence tokens.

All templates' tokens enter one automaton.  A file's tokens stream through it
and give, at each place, the longest match ending there (matching
statistics).  Long maximal matches are chained in template order into spans,
and a template whose tokens are covered enough names the file's licence.

Words are maximal runs outside ASCII punctuation, symbols and white space, A-Z
lower-cased.  Base phrases are found at every place where their words stand
consecutively; the templates add labels of their own.

Defined cases: a null text is an empty one (no words, empty labels, score
0); repeated rows and null ids are reported each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shoal.llm.common import read

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Whole texts of three short licences.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)

# Short notices and characteristic sentences of public licences.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd": [BSD, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": [ISC, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mit": ["released under the mit license", MIT, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
}

#: Word bytes to themselves in lower case, all others to a space.
WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Automaton:
    """Suffix automaton of several token sequences, with the places where each state's strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for j, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].add((k, j))
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _add(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _fit(self, p: int, token: int) -> int:
        """The state for p's strings and token: that of the move, or its clone if longer strings share it."""
        q = self.next[p][token]
        if self.size[q] == self.size[p] + 1:
            return q
        new = self._add(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._fit(last, token)
        new, p = self._add(self.size[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._fit(p, token)
        return new

    def matches(self, tokens: list[int], least: int):
        """(end, length, state) of each maximal match of least tokens or more."""
        state = size = 0
        for i, token in enumerate([*tokens, -1]):
            if token not in self.next[state]:
                if size >= least:
                    yield i, size, state
                while state and token not in self.next[state]:
                    state = self.link[state]
                size = self.size[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: int = 4, gap: int = 8, cover: float = 0.7):
        self.least, self.gap, self.cover = least, gap, cover
        named = [(label, words_of(t)) for label, texts in sorted(templates.items()) for t in texts]
        self.vocab: dict[bytes, int] = {}
        sequences = [[self.vocab.setdefault(w, len(self.vocab)) for w in t] for _, t in named]
        self.labels, self.sizes = [label for label, _ in named], [len(s) for s in sequences]
        self.automaton = Automaton(sequences)

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) of each chain that covers its template enough."""
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        chains: dict[int, list[list[int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.least:
                continue
            for end, size, state in self.automaton.matches(ids[a:b].tolist(), self.least):
                for k, j in sorted(self.automaton.ends[state]):
                    at, mine = a + end - size, j + 1 - size
                    runs = chains.setdefault(k, [])
                    # chain: [first word, end, template place reached, tokens covered]
                    if runs and at - runs[-1][1] <= self.gap and (over := max(0, runs[-1][1] - at, runs[-1][2] - mine)) < size and mine + size > runs[-1][2]:
                        runs[-1] = [runs[-1][0], a + end, mine + size, runs[-1][3] + size - over]
                    else:
                        runs.append([at, a + end, mine + size, size])
        return sorted((self.labels[k], r[0], r[1], min(1.0, r[3] / self.sizes[k])) for k, runs in chains.items() for r in runs if r[3] >= self.cover * self.sizes[k])


def base(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word places of all base phrases, and their labels."""
    line, places, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in PHRASES.items():
        seen, word = 0, 0
        at = line.find(b" " + phrase.encode() + b" ")
        while at >= 0:
            word += line.count(b" ", seen, at)  # words since the last place
            seen = at
            places.append(word)
            labels.add(label)
            at = line.find(b" " + phrase.encode() + b" ", at + 1)
    return places, labels


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,cover:double>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """The operator: doc_id, the base columns, labels, score and the covered template spans of each row of docs."""
    rows, use = docs.select("doc_id", "text"), templates or TEMPLATES
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {FIELDS}"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cover", pa.float64())]))]

    def one(scanner: Scanner, text: str | None) -> tuple:
        words = words_of(text)
        places, labels = base(words)
        spans = scanner.spans(words)
        score = max([0.5 * bool(places), *(s[3] for s in spans)])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score, [dict(zip(("label", "start", "end", "cover"), s)) for s in spans]

    def run(batches):
        scanner = Scanner(use)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                got = zip(*(one(scanner, t.as_py()) for t in part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(x), k) for x, k in zip(got, kinds))], [x.split()[0] for x in ["doc_id", *FIELDS.split(", ")]])

    return rows.mapInArrow(run, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")
