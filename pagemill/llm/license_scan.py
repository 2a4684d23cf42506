"""License scans: an exact containment join of text blocks with license templates.

Tokens are pairs of neighbouring words, so that a match needs the template's wording and not just its words. A block
matches a template when it holds at least ``containment`` of the template's distinct pairs. Pairs are ordered by how
many documents of the whole collection hold them, rarest first. Of a template with n pairs of which o must be shared, a
block that holds none of the first n - o + 1 cannot match (prefix filter); one with fewer than o of its pairs at all cannot
either (length filter); and while the distinct pairs of a stretch are counted in that order, it is given up as soon as those
still to come cannot make up what is missing (positional filter). What is left is slid over: blocks are windows of twice the
template's length from any start, and as what they hold changes only where a pair of the template stands, a window for each
of these places, ending there, misses none. Of a template's windows that overlap the best counts. Notices of one family share
most of their wording: where blocks overlap, a template gives its label up to one that it shares half of its pairs with and
that fits better; ``matches`` tells of all blocks.
Beside the join, fixed phrases are found word by word.

Scale. Templates are parameters, so the inverted index is broadcast at a size that the data do not change. One pass
counts the templates' own pairs with a map-side combine; the scan itself is another pass without a shuffle. Texts
without a pair of any prefix, nearly all, cost one set intersection.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ASCII_LOWER, text_column

#: Fixed phrases and the labels they give.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed texts by label: notices and bodies as the licenses' authors publish them.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "cc0": ["to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty"],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under the creative commons attribution 4.0 license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nd": ["this work is licensed under a creative commons attribution noderivatives 4.0 international license"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"],
}
#: A-Z lowered; ASCII other than letters and digits parts words, bytes of other characters belong to them.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in ASCII_LOWER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


Pair = tuple[bytes, bytes]


def pairs_of(words: list[bytes]) -> Iterator[Pair]:
    return zip(words, words[1:], strict=False)


class Template:
    def __init__(self, label: str, words: list[bytes], pairs: list[Pair], containment: float):
        self.label, self.pairs, self.all = label, pairs, frozenset(pairs)
        self.step = len(words)
        self.least = math.ceil(containment * len(pairs) - 1e-9)

    def shared(self, held: set[int]) -> int:
        """How many of the template's pairs, known by their rank, a stretch holds, rarest first; 0 as soon as too few can follow, or if there are too few at all."""
        if len(held) < self.least:
            return 0
        shared = 0
        for i in range(len(self.pairs)):
            shared += i in held
            if shared + len(self.pairs) - 1 - i < self.least:
                return 0
        return shared

    def windows(self, places: Mapping[Pair, list[int]]) -> list[tuple[int, int, int]]:
        """(shared pairs, first word, end) of windows that match, for each place of a pair the one that ends there, less what it has twice or not of the template."""
        own = [(at, i) for i, p in enumerate(self.pairs) for at in places.get(p, ())]
        if not own:
            return []
        at, which = np.array(sorted(own)).T
        first = np.searchsorted(at, at - (2 * self.step - 2))
        ends = np.flatnonzero(np.arange(len(at)) - first + 1 >= self.least)
        out = []
        for run in np.split(ends, np.flatnonzero(np.diff(ends) > 1) + 1):
            if not len(run) or not self.shared(set(which[first[run[0]] : run[-1] + 1].tolist())):
                continue
            low, high, held = int(first[run[0]]), int(first[run[0]]), {}
            for j in run.tolist():
                while high <= j:
                    held[which[high]] = held.get(which[high], 0) + 1
                    high += 1
                while low < first[j] or held[which[low]] > 1:
                    held[which[low]] -= 1
                    if not held[which[low]]:
                        del held[which[low]]
                    low += 1
                if len(held) >= self.least:
                    out.append((len(held), int(at[low]), int(at[j]) + 2))
        return out


class Index:
    """Templates by their rarest pairs."""

    def __init__(self, templates: Mapping[str, Sequence[str]], frequency: Mapping[Pair, int], containment: float):
        order = lambda p: (frequency.get(p, 0), p)
        self.templates, self.prefix = [], {}
        for label, texts in templates.items():
            for words in map(words_of, texts):
                t = Template(label, words, sorted(set(pairs_of(words)), key=order), containment)
                self.templates.append(t)
                for p in t.pairs[: len(t.pairs) - t.least + 1]:
                    self.prefix.setdefault(p, []).append(len(self.templates) - 1)
        self.rare = frozenset(self.prefix)

    def blocks(self, words: list[bytes]) -> list[tuple[float, Template, int, int]]:
        """(containment, template, first word, end) of every block of ``words`` that matches and overlaps no better one of its template."""
        hits = self.rare.intersection(pairs_of(words))
        if not hits:
            return []
        asked = {k for p in hits for k in self.prefix[p]}
        known = frozenset().union(*(self.templates[k].all for k in asked))
        places: dict[Pair, list[int]] = {}
        for i, p in enumerate(pairs_of(words)):
            if p in known:
                places.setdefault(p, []).append(i)
        return [(shared / len(t.pairs), t, a, z) for t in (self.templates[k] for k in sorted(asked)) for shared, a, z in _apart(t.windows(places))]

    def best(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the templates that some block of ``words`` matches and no better one of their family does, with the best containment."""
        return labelled(self.blocks(words))


def labelled(blocks: list[tuple[float, Template, int, int]]) -> dict[str, float]:
    """Labels and best containment of the blocks that no better one of their family overlaps."""
    matched = sorted(blocks, key=lambda m: m[2])
    starts, widest = [m[2] for m in matched], max((m[3] - m[2] for m in matched), default=0)
    found: dict[str, float] = {}
    for score, t, a, b in matched:
        near = matched[bisect.bisect_left(starts, a - widest) : bisect.bisect_left(starts, b)]
        if not any(better > score and a < d and 2 * len(t.all & u.all) >= min(len(t.all), len(u.all)) for better, u, _, d in near):
            found[t.label] = max(found.get(t.label, 0.0), score)
    return found


def _apart(windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Windows (shared, first, end) taken from the best down, earlier ones first, where they overlap none that is taken; by place."""
    taken: list[tuple[int, int, int]] = []
    for w in sorted(windows, key=lambda w: (-w[0], w[1])):
        i = bisect.bisect_left(taken, (w[1],), key=lambda x: (x[1],))
        if (i == 0 or taken[i - 1][2] <= w[1]) and (i == len(taken) or w[2] <= taken[i][1]):
            taken.insert(i, w)
    return taken


def _phrase_starts(words: list[bytes], phrases: Mapping[bytes, str]) -> list[tuple[int, str]]:
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        at = joined.find(phrase)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(phrase, at + 1)
    return found


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    containment: float = 0.8,
) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    n_base, first_word and last_word tell of the phrases alone; labels adds those of matching blocks; score is the
    best containment of any template, 1 where a phrase stands, else 0. matches: every block that meets the threshold as
    label:first word:end:containment, also where a label is given up, comma-joined by place. Null texts count as empty: no words, nothing
    found. Null and repeated ids are carried along; other columns are not read. Equal frequencies are
    ordered by pair. A template of one word never matches.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))
    known = sorted({p for ts in templates.values() for t in ts for p in pairs_of(words_of(t))})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = frozenset(known), dict.fromkeys(known, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for p in asked.intersection(pairs_of(words_of(text))):
                    total[p] += 1
        yield pa.RecordBatch.from_arrays([pa.array([p[0].decode() for p in total], pa.string()), pa.array([p[1].decode() for p in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["first", "second", "n"])

    counts = rows.select("_text").mapInArrow(counted, "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
    index = Index(templates, {(r.first.encode(), r.second.encode()): r.n for r in counts.collect()}, containment)  # one row per template pair
    padded = {b" " + b" ".join(words_of(p)) + b" ": label for p, label in phrases.items()}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                base = _phrase_starts(words, padded)
                blocks = index.blocks(words)
                matched = labelled(blocks)
                told = ",".join(f"{t.label}:{a}:{z}:{share:.4f}" for share, t, a, z in sorted(blocks, key=lambda m: (m[2], m[3], m[1].label)))
                at, labels = [a for a, _ in base], {b for _, b in base}
                out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | matched.keys())), 1.0 if base else max(matched.values(), default=0.0), told))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"
    return rows.mapInArrow(scanned, schema).withColumnRenamed("_id", id_col)
