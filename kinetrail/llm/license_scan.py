"""License scans: winnowed fingerprints, then banded alignment.

Templates are cut into words; hashes of K words in a row are winnowed and put
into an inverted index, which is as small as the templates and travels with the
tasks. A document's words are mapped to the templates' vocabulary; runs of K
known words that hit the index name a template and a diagonal. Near diagonals
of a template are one candidate, which a banded alignment of the template with
that stretch of the document turns into matched words, coverage and a span; what
the span leaves of the stretch on either side is aligned again.

Defined results: null and empty texts and texts without a match give no row;
each occurrence of a template is a row, of overlapping ones the one that matches
most words, then the largest share, stays; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

K, WINDOW = 3, 2
BAND = 12
COVERAGE = 0.8
WORDS = re.compile(r"[^\W_]+")

#: Public notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Affero General Public License for more details.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under
        the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details.""",
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Positions of the rightmost smallest hash of each window."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    kept = {min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)}
    return sorted(kept)


class Index:
    """Vocabulary, template words and the inverted index of fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.templates = [
            [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(templates[n])] for n in self.names
        ]
        self.postings: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.templates):
            grams = [tuple(words[i : i + K]) for i in range(max(1, len(words) - K + 1))] if words else []
            for i in winnow([self.mixed(g) for g in grams]):
                self.postings[grams[i]].append((t, i))

    @staticmethod
    def mixed(gram: tuple[int, ...]) -> int:
        h = 0
        for w in gram:
            h = ((h ^ (w + 1)) * 0x9E3779B97F4A7C15 + (h >> 29)) % 2**64
        return h


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def align(template: list[int], stretch: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the best alignment of the template
    with stretch: all of the template, any part of the stretch, no cell further
    than band from the diagonal (stretch position minus template position).

    Most matches first, then the fewest skipped words of the stretch.
    """
    m, n = len(template), len(stretch)
    lowest = diagonal - band
    width = 2 * band + 1
    none = (-1, 0, 0)
    # cell b of row i: template[:i] aligned, stretch read up to i + lowest + b; (matches, -length, first)
    row = [(0, 0, lowest + b) if 0 <= lowest + b <= n else none for b in range(width)]
    best, best_end = (0, 0, 0), 0
    for i in range(1, m + 1):
        new = []
        for b in range(width):
            j = i + lowest + b
            if not 0 <= j <= n:
                new.append(none)
                continue
            options = []
            if b + 1 < width and row[b + 1][0] >= 0:  # a template word that the document lacks
                options.append(row[b + 1])
            if j > 0 and row[b][0] >= 0:
                got, length, first = row[b]
                if template[i - 1] == stretch[j - 1]:
                    options.append((got + 1, length - 1, first) if got else (1, -1, j - 1))
                else:
                    options.append((got, length - 1, first) if got else (0, 0, j))
            if b > 0 and j > 0 and new[b - 1][0] >= 0:  # a word between
                got, length, first = new[b - 1]
                options.append((got, length - 1, first) if got else (0, 0, j))
            cell = max(options, default=none, key=lambda c: (c[0], c[1]))
            new.append(cell)
            if cell[0] > 0 and j > 0 and template[i - 1] == stretch[j - 1] and (cell[0], cell[1]) > (best[0], best[1]):
                best, best_end = cell, j
        row = new
    return best[0], best[2], best_end


def scan_text(text: str, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, int, int, float, int, int]]:
    """(license, template words, matched words, coverage, start, end): start and
    end are code points of the text."""
    known = index.vocabulary.get
    lower = text.lower()
    if len(lower) != len(text):  # some letter changed its length: words of the original, each in lower case
        ids = [known(w.lower(), -1) for w in WORDS.findall(text)]
    else:
        ids = [known(w, -1) for w in WORDS.findall(lower)]
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    postings = index.postings.get
    for i in range(len(ids) - K + 1):
        if ids[i] >= 0 and ids[i + 1] >= 0 and ids[i + 2] >= 0:
            for t, at in postings((ids[i], ids[i + 1], ids[i + 2]), ()):
                hits[t].append((i - at, i))
    if not hits:
        return []
    candidates = []
    spans = [m.span() for m in WORDS.finditer(text)]
    for t, seen in hits.items():
        template, results, group = index.templates[t], [], []
        for diagonal, at in sorted(seen):
            if group and diagonal - group[0][0] > band:
                results.append((group, 0, len(ids)))
                group = []
            group.append((diagonal, at))
        results.append((group, 0, len(ids)))
        while results:  # hits and the words that they may use
            group, begin, end = results.pop()
            middle = group[len(group) // 2][0]
            low, high = max(begin, middle - band), min(end, middle + len(template) + band)
            got, first, last = align(template, ids[low:high], middle - low, band)
            share = got / len(template)
            if share >= coverage:
                first, last = low + first, low + last
                candidates.append((-got, -share, first, last, t))
                left = [hit for hit in group if hit[1] + K <= first]
                right = [hit for hit in group if hit[1] >= last]
                results += [part for part in ((left, begin, first), (right, last, end)) if part[0]]
    taken: list[tuple[int, int]] = []  # in order, none overlaps another
    found = []
    for got, share, first, last, t in sorted(candidates):
        at = bisect(taken, (first, last))
        if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
            taken.insert(at, (first, last))
            found.append((index.names[t], len(index.templates[t]), -got, -share, spans[first][0], spans[last - 1][1]))
    return sorted(found, key=lambda f: (f[4], f[0]))


SCHEMA = "doc_id long, license string, template_words long, matched_words long, coverage double, start long, end long"


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    coverage: float = COVERAGE,
    band: int = BAND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per license text found: doc_id, license, template_words,
    matched_words, coverage, start, end. Templates must have K words at least."""
    known = tuple(sorted((templates or TEMPLATES).items()))
    if any(len(words_of(t)) < K for _, t in known):
        raise ValueError(f"a template has fewer than {K} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(known)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [
                (doc, *row)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for row in scan_text(text.as_py(), index, coverage, band)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(run, SCHEMA)
