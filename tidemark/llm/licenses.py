"""License scans through a positional index of rare template words.

Templates are passages of public licences, each with key phrases that must
occur. For every word of the templates a file's places are listed. Each key
phrase is looked up by the rarest of its words, rarity being the inverse
document frequency over all documents; a place of the phrase less its place in
the template is an offset at which the template may stand. The offsets of all
key phrases are intersected, and at those left, where all key phrases stand as
in the template, the share of template words found at their places is the score.
Every place at which a template's key phrases stand is scored, whatever else the
file holds; the work is linear in the file for each template.

Four base phrases are counted at all places where their words stand side by
side; they give the base labels. Other labels come from templates.

Defined cases: a null text is the empty text: no words, no places, empty labels
and score 0. Words are runs of 0-9, a-z (A-Z in lower case) and characters from
0x80 on. A label that several templates or places give is listed once; the score
is the best share of any template, and 0.5 at least where a base phrase stands.
Repeated rows are scanned one by one; columns beside id and text are not read.
Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Base phrases and their labels (fixed values).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    """A passage, the label it gives, and phrases that must stand in it."""

    label: str
    text: str
    key_phrases: tuple[str, ...]


#: Short passages of public licences and notices (fixed values).
TEMPLATES = (
    Template("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied", ("without warranty", "as is")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("cc-by", "this work is licensed under cc by 4 0", ("cc by",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-text", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-sa-text", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted", "deal in the software without restriction")),
    Template("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    Template("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("without warranty of any kind", "in no event shall")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("warranty-disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("express or implied warranties", "are disclaimed")),
    Template("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("distributed on an as is basis", "limitations under the license")),
    Template("gpl-text", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "gnu general public license")),
    Template("gpl-text", "you should have received a copy of the gnu general public license along with this program", ("should have received a copy", "gnu general public license")),
    Template("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ("should have received a copy", "gnu lesser general public license")),
    Template("agpl", "you should have received a copy of the gnu affero general public license along with this program", ("should have received a copy", "gnu affero general public license")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license", "if a copy of the mpl was not distributed")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "appear in all copies")),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish",)),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("permission is granted to anyone to use this software", "redistribute it freely")),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
)

#: Share of a template's words that must stand at their places.
LEAST_SHARE = 0.6

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x41:0x5B] = True
_IN_WORD[0x80:] = True


@dataclass
class Index:
    """The vocabulary with the rarity of each word, the base phrases, and the templates, all as word numbers."""

    number: dict[bytes, int]
    rarity: np.ndarray
    base: list[tuple[str, np.ndarray]]
    #: Label, body, and the key phrases, each with its places in the body.
    templates: list[tuple[str, np.ndarray, list[tuple[np.ndarray, list[int]]]]]
    #: Each template and each base phrase holds one of these words.
    anchors: list[bytes]


def vocabulary(templates=TEMPLATES) -> list[bytes]:
    texts = [t.text for t in templates] + [phrase for phrase, _ in BASE]
    return sorted({w for text in texts for w in text.encode().split()})


def build_index(n_documents: int, frequency: dict[bytes, int], templates=TEMPLATES) -> Index:
    """`frequency` counts the documents that hold a word."""
    words = vocabulary(templates)
    number = {w: i for i, w in enumerate(words)}
    rarity = np.array([math.log((n_documents + 1) / (frequency.get(w, 0) + 1)) for w in words])
    ids = lambda text: np.array([number[w] for w in text.encode().split()], np.int32)
    index = Index(number, rarity, [(label, ids(phrase)) for phrase, label in BASE], [], [])
    anchors: set[bytes] = set()
    rarest = lambda phrase: words[max(phrase.tolist(), key=lambda i: (rarity[i], i))]
    for template in templates:
        body = ids(template.text)
        keys = []
        for phrase in map(ids, template.key_phrases):
            at = [i for i in range(len(body) - len(phrase) + 1) if (body[i : i + len(phrase)] == phrase).all()]
            keys.append((phrase, at))
        # The phrase with the rarest word is looked up first.
        keys.sort(key=lambda k: -rarity[k[0]].max())
        index.templates.append((template.label, body, keys))
        anchors.add(rarest(keys[0][0]))
    index.anchors = sorted(anchors | {rarest(phrase) for _, phrase in index.base})
    return index


class Places:
    """A file's words as numbers (-1: in no template) and the places of each number."""

    def __init__(self, index: Index, words: list[bytes]):
        self.index = index
        self.ids = np.fromiter(map(index.number.get, words, repeat(-1)), np.int32, len(words))
        known = np.flatnonzero(self.ids >= 0)
        self.order = known[np.argsort(self.ids[known], kind="stable")]
        self.bounds = np.searchsorted(self.ids[self.order], np.arange(len(index.number) + 1))

    def of(self, number: int) -> np.ndarray:
        return self.order[self.bounds[number] : self.bounds[number + 1]]

    def phrase(self, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase starts, from the places of its rarest word."""
        if any(self.bounds[w] == self.bounds[w + 1] for w in phrase.tolist()):
            return np.zeros(0, np.int64)
        first, *others = np.argsort(-self.index.rarity[phrase], kind="stable").tolist()
        starts = self.of(phrase[first]) - first
        starts = starts[(starts >= 0) & (starts + len(phrase) <= len(self.ids))]
        for i in others:
            starts = starts[self.ids[starts + i] == phrase[i]]
        return starts


def match_templates(places: Places) -> dict[str, float]:
    """Labels of the templates whose key phrases stand in the file, with the best share of words at their places."""
    found: dict[str, float] = {}
    known: dict[bytes, np.ndarray] = {}
    for label, body, keys in places.index.templates:
        offsets = None
        for phrase, at in keys:
            name = phrase.tobytes()
            if name not in known:
                known[name] = places.phrase(phrase)
            here = np.unique(np.concatenate([known[name] - i for i in at]))
            offsets = here if offsets is None else np.intersect1d(offsets, here, assume_unique=True)
            if not len(offsets):
                break
        if not len(offsets):
            continue
        # What sticks out of the file matches nothing.
        margin = len(body)
        padded = np.concatenate([np.full(margin, -2, np.int32), places.ids, np.full(margin, -2, np.int32)])
        same = np.zeros(len(offsets), np.int64)
        for i, word in enumerate(body.tolist()):
            same += padded[offsets + margin + i] == word
        share = float(same.max()) / len(body)
        if share >= LEAST_SHARE and share > found.get(label, 0.0):
            found[label] = share
    return found


def _word_count(raw: np.ndarray) -> int:
    inside = _IN_WORD[raw]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])


def scan_text(index: Index, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    raw = (text or "").encode("utf-8")
    low = raw.lower()
    if not any(a in low for a in index.anchors):
        return _word_count(np.frombuffer(raw, np.uint8)), 0, None, None, "", "", 0.0
    words = WORD.findall(low)
    places = Places(index, words)
    starts = {label: found for label, phrase in index.base if len(found := places.phrase(phrase))}
    more = match_templates(places)
    every = np.concatenate(list(starts.values())) if starts else np.zeros(0, np.int64)
    score = max([*more.values(), *([0.5] if starts else [])], default=0.0)
    return (
        len(words), len(every), int(every.min()) if starts else None, int(every.max()) if starts else None,
        ",".join(sorted(starts)), ",".join(sorted({*starts, *more})), float(score),
    )


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each template word, over all documents."""
    words = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(words)
        seen = dict.fromkeys(words, 0)
        n = 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                low = (text.as_py() or "").encode("utf-8").lower()
                for w in known.intersection(WORD.findall(low)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"]
        )

    # A row for each template word.
    found = docs.select(text_of(text_col).alias("t")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    totals = {bytes(r["word"]): r["n"] for r in found.collect()}
    return totals.pop(b"", 0), totals


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places and labels, labels of the method, and the best share."""
    index = build_index(*document_frequency(docs, text_col))
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(index, t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, *names])

    return source.mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")
