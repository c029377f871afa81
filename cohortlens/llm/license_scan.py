"""License texts in documents: winnowed fingerprints, then banded alignment.

Templates are cut into runs of three words; of every two neighbouring runs the
one with the smaller hash is a fingerprint. They form an inverted index from
fingerprint to template and place. A document's runs are looked up in it; hits
that lie near one diagonal are a candidate, which a banded local alignment
turns into matched words, coverage and span. Only the templates are broadcast,
with the task; their size is fixed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.words import window_hashes, word_hashes

#: Public license notices, as they are commonly written.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
}

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LicenseSettings:
    """``percent`` of a template's words must be matched; ``band`` is how far an
    alignment may stray from its diagonal, a quarter of the template at most."""

    gram: int = 3
    window: int = 2
    band: int = 8
    percent: int = 80
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))


def spelled(text: str | None) -> list[tuple[str, int, int]]:
    """Words in lower case with their places in the text."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]


def winnowed(grams: np.ndarray, window: int) -> list[int]:
    """Places of the fingerprints: the rightmost smallest hash of every window."""
    if len(grams) <= window:
        return [len(grams) - 1 - int(grams[::-1].argmin())] if len(grams) else []
    chosen = {}
    for at in range(len(grams) - window + 1):
        part = grams[at : at + window][::-1]
        chosen[at + window - 1 - int(part.argmin())] = True
    return list(chosen)


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in words])


def inverted_index(settings: LicenseSettings) -> tuple[dict[int, list[tuple[str, int]]], dict[str, list[str]]]:
    """fingerprint -> (template, place); template -> its words."""
    index, texts = defaultdict(list), {}
    for name, text in settings.templates.items():
        words = [w for w, _, _ in spelled(text)]
        grams = window_hashes(_hashes(words), min(settings.gram, max(1, len(words))))
        texts[name] = words
        for at in winnowed(grams, settings.window):
            index[int(grams[at])].append((name, at))
    return dict(index), texts


def aligned(template: list[str], words: list[str], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the best local alignment of the template with
    ``words`` whose place differs from ``diagonal`` by at most ``band``.

    A match scores 2, a mismatch or a gap -1. ``first`` and ``last`` are the
    places of the outermost matched words.
    """
    nothing = (0, 0, -1, -1)  # score, matched, first, last
    best, above = nothing, {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)):
            score, matched, first, last = above.get(j - 1, nothing)
            if words[j] == word:
                cell = (score + 2, matched + 1, first if matched else j, j)
            else:
                cell = max((score - 1, matched, first, last), nothing)
            for other in (above.get(j, nothing), row.get(j - 1, nothing)):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            row[j] = cell if cell[0] > 0 else nothing
            if row[j][:2] > best[:2]:
                best = row[j]
        above = row
    return best[1], best[2], best[3]


def matches(text: str | None, index, texts, settings: LicenseSettings) -> list[tuple[str, int, int, int, int]]:
    """(template, matched words, words of the template, start, end) in characters, by place."""
    placed = spelled(text)
    words = [w for w, _, _ in placed]
    grams = window_hashes(_hashes(words), settings.gram)
    known = np.fromiter(index, np.uint64, len(index))
    diagonals = defaultdict(list)
    for at in np.flatnonzero(np.isin(grams, known)).tolist():
        for name, place in index[int(grams[at])]:
            diagonals[name].append(at - place)
    found = []
    for name, hits in diagonals.items():
        template, done = texts[name], -1 - len(texts[name])
        band = min(settings.band, len(template) // 4)
        for diagonal in sorted(hits):
            if diagonal <= done:
                continue
            low = max(0, diagonal - band)
            part = words[low : diagonal + len(template) + band + 1]
            matched, first, last = aligned(template, part, diagonal - low, band)
            done = diagonal + band // 2
            if 100 * matched >= settings.percent * len(template):
                found.append((name, matched, len(template), placed[low + first][1], placed[low + last][2]))
                done = max(done, low + last - len(template) + band)
    unique = {(f[0], f[3], f[4]): f for f in found}
    return sorted(unique.values(), key=lambda f: (f[3], f[0]))


def _scanned(settings: LicenseSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, texts = inverted_index(settings)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for name, matched, size, start, end in matches(text, index, texts, settings):
                    rows.append((doc_id, name, matched, size, matched / size, start, end))
            yield pd.DataFrame(rows, columns=["doc_id", "license", "n_matched", "n_words", "coverage", "start", "end"])

    return run


def license_scan(documents: DataFrame, settings: LicenseSettings | None = None) -> DataFrame:
    """One row per license text found: doc_id, license, n_matched, n_words, coverage, start, end.

    ``start`` and ``end`` are character places of the matched span. A document
    without one, null and empty texts give no row. Repeated rows give rows each;
    null ids are kept; other columns are ignored.
    """
    narrow = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    layout = "doc_id string, license string, n_matched long, n_words long, coverage double, start long, end long"
    found = narrow.mapInPandas(_scanned(settings or LicenseSettings()), layout)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
