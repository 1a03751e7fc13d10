"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+")
#: Share of a template's words that an alignment must cover.
COVERAGE = 0.8
#: Matched words may be so many template lengths apart, at most, to be of one place.
STRETCH = 2

# Short notices and opening clauses of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "BSD-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of their first number, whose second ones rise."""
    tails, ends, prev = [], [], []
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tails, y)
        prev.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = prev[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (text, template) of equal words, rising in both.

    Equal words at either end of the ranges are taken first. Words that occur
    once in both ranges are anchors; the longest rising run of them splits the
    ranges, and each gap is aligned in the same way. A gap without an anchor
    gives nothing more.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(text[a:b], a) if here[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        x, y = a, c
        for k, j in [*anchors, (b, d)]:
            todo.append((x, k, y, j))
            x, y = k + 1, j + 1
    return sorted(out)


class Scanner:
    """Finds where texts hold the words of templates."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.templates = {k: WORD.findall(t.lower()) for k, t in sorted(templates.items())}
        self.templates = {k: w for k, w in self.templates.items() if w}
        self.needed = {k: max(1, -(-len(w) * round(coverage * 1000) // 1000)) for k, w in self.templates.items()}
        self.vocabulary = {w for words in self.templates.values() for w in words}

    def places(self, words: list[str], marks: list[tuple[int, str]], key: str) -> Iterator[list[tuple[int, int]]]:
        """Alignments of a template that cover it, in the order of their places.

        Marks are the places of a text's vocabulary words. Any cover is among
        the words of a stretch of STRETCH template lengths. At each word, the
        shortest stretch that ends there and holds enough of the template's
        words, counted with their number, is aligned, alone and with a margin
        for words beyond what is needed; the search goes on after a cover.
        """
        own = self.templates[key]
        want, span, need = Counter(own), STRETCH * len(own), self.needed[key]
        margin = len(own) - need + len(own) // 4
        stand = [(p, w) for p, w in marks if w in want]
        have: Counter = Counter()
        shared, left, free = 0, 0, 0
        for p, w in stand:
            if p < free:
                left += 1
                continue
            shared += have[w] < want[w]
            have[w] += 1
            while True:
                q, v = stand[left]
                lost = have[v] <= want[v]
                if q > p - span and (shared < need or (lost and shared == need)):
                    break
                have[v] -= 1
                shared -= lost
                left += 1
            if shared < need:
                continue
            a, b = stand[left][0], p + 1
            best = [(a + i, j) for i, j in align(words[a:b], own)]
            wide = max(free, a - margin)
            more = [(wide + i, j) for i, j in align(words[wide : b + margin], own)]
            best = max(best, more, key=len)
            if len(best) >= need:
                yield best
                free = best[-1][0] + 1
                have.clear()
                shared = 0
                left = bisect.bisect_right(stand, (p, chr(0x10FFFF)))

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) for each place, in characters; ordered by place.

        Where templates share a place, the one with most covered words stands.
        """
        spans = [m.span() for m in WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [m.span() for m in re.finditer(r"[A-Za-z0-9]+", text)]
        words = [text[a:b].lower() for a, b in spans]
        marks = [(p, w) for p, w in enumerate(words) if w in self.vocabulary]
        if not marks:
            return []
        count = Counter(w for _, w in marks)
        found = []
        for key, own in self.templates.items():
            if sum(min(n, count[w]) for w, n in Counter(own).items()) < self.needed[key]:
                continue
            for pairs in self.places(words, marks, key):
                found.append((len(pairs), key, len(pairs) / len(own), spans[pairs[0][0]][0], spans[pairs[-1][0]][1]))
        found.sort(key=lambda f: (-f[0], -f[2], f[3], f[1]))
        kept: list[tuple[str, float, int, int]] = []
        for _, key, cover, a, b in found:
            if all(b <= x or a >= y for _, _, x, y in kept):
                kept.append((key, cover, a, b))
        return sorted(kept, key=lambda k: k[2:])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start_char, end_char) for each license notice in the whole texts.

    A notice counts if a patience alignment covers ``coverage`` of its
    template's words (runs of ASCII letters and digits, in lower case) within
    STRETCH template lengths. A text
    may hold several notices, and one several times. Null and empty texts hold
    none; repeated rows are scanned each; a null id stays null; an empty table
    gives no rows. Other columns of ``docs`` are not looked at.
    """
    known = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, coverage)
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column(1)):
                for hit in scanner.scan(text.as_py() or ""):
                    at.append(k)
                    out.append(hit)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds))], ["doc_id", "license", "coverage", "start_char", "end_char"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, license string, coverage double, start_char long, end_char long")


def op1_license_scans(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
