"""License scan: winnowed fingerprints of templates in an inverted index pick
candidates, banded sequence alignment reports matched coverage and spans.

The templates are a fixed, small table; the index on them travels to the tasks,
and each text is scanned whole where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

GRAM = 3
WINDOW = 2
LEAST_BAND = 2
MAX_TEMPLATE_WORDS = 200_000  # of all templates; more are refused

# Wording of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

WORD = r"[^\W_]+"


def band_of(template: list[int]) -> int:
    """Words by which an alignment may leave its diagonal: a quarter of the
    template, so that a long notice may have as many words put into it, and less
    than any template's length, so that the next copy of a notice is out of reach."""
    return max(LEAST_BAND, len(template) // 4)


def align(template: list[int], words: list[int], band: int):
    """Banded alignment of a template with a stretch of words that begins
    ``band`` words before the template's expected place: the most template words
    in order, cells off the diagonal by more than ``band`` left out. Returns
    (template words matched, first and last matched place in the stretch)."""
    # score: +1 for a match, -1/4 for a word skipped on either side, so that the tightest stretch wins
    width = 2 * band + 1
    best = (0.0, 0, -1, -1)
    row = [(0.0, 0, -1, -1)] * width  # (score, matched, first, last)
    for i, t in enumerate(template):
        new = []
        for b in range(width):
            j = i + b
            found = (0.0, 0, -1, -1)
            if b + 1 < width and row[b + 1][1]:  # template word skipped
                s = row[b + 1]
                found = max(found, (s[0] - 0.25, *s[1:]))
            if b and new[b - 1][1]:  # document word skipped
                s = new[b - 1]
                found = max(found, (s[0] - 0.25, *s[1:]))
            if j < len(words) and words[j] == t:
                s = row[b]
                found = max(found, (s[0] + 1, s[1] + 1, s[2] if s[1] else j, j))
            elif row[b][1]:  # one word exchanged for another
                s = row[b]
                found = max(found, (s[0] - 0.25, *s[1:]))
            new.append(found)
            if found[0] > best[0]:
                best = found
        row = new
    return best[1:]


class Index:
    """Winnowed fingerprints of the templates: gram -> [(template, place)]."""

    def __init__(self, templates: Mapping[str, str]):
        import re

        self.word = re.compile(WORD)
        self.names = sorted(templates)
        split = [self.word.findall(templates[n].lower()) for n in self.names]
        if sum(map(len, split)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in split for w in s}), 1)}
        self.words = [[self.vocabulary[w] for w in s] for s in split]
        self.entries: dict[int, list[tuple[int, int]]] = {}
        if min(map(len, split), default=GRAM) < GRAM:
            raise ValueError(f"a template needs {GRAM} words")
        # the only gram of a template that is too short for winnowing is always kept
        self.alone: list[int] = []
        alone = [gram for ids in self.words if len(ids) < GRAM + WINDOW - 1 for _, gram in self.fingerprints(ids)]
        self.alone = sorted(set(alone))
        for t, ids in enumerate(self.words):
            for at, gram in self.fingerprints(ids):
                self.entries.setdefault(gram, []).append((t, at))

    def fingerprints(self, ids):
        """(place, gram) of the winnowed grams of known words: of ``WINDOW``
        consecutive grams the one with the least hash; a gram with a word that
        no template has is never the least."""
        import numpy as np

        ids = np.asarray(ids, np.int64)
        if len(ids) < GRAM:
            return []
        known = ids > 0
        good, gram = known[:len(ids) - GRAM + 1].copy(), ids[:len(ids) - GRAM + 1].copy()
        for i in range(1, GRAM):
            good &= known[i:len(ids) - GRAM + 1 + i]
            gram = gram * (len(self.vocabulary) + 1) + ids[i:len(ids) - GRAM + 1 + i]
        if not good.any():
            return []
        order = (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        order[~good] = np.iinfo(np.uint64).max
        picked = np.unique(np.arange(len(order) - min(WINDOW, len(order)) + 1) + np.lib.stride_tricks.sliding_window_view(
            order, min(WINDOW, len(order))).argmin(1))
        picked = np.union1d(picked, np.flatnonzero(np.isin(gram, self.alone)))
        return [(int(i), int(gram[i])) for i in picked if good[i]]

    def scan(self, text: str | None, min_coverage: float):
        """[(template name, coverage, first and last character, end exclusive)]."""
        from itertools import repeat

        text = text or ""
        lowered = text.lower()
        if len(lowered) == len(text):
            found = self.word.findall(lowered)
        else:  # a letter whose lower case is longer: words and places of the text itself
            lowered = text
            found = [w.lower() for w in self.word.findall(text)]
        ids = list(map(self.vocabulary.get, found, repeat(0)))
        starts: dict[int, set[int]] = {}
        for at, gram in self.fingerprints(ids):
            for t, place in self.entries.get(gram, ()):
                starts.setdefault(t, set()).add(at - place)
        out = {}
        for t, mine in starts.items():
            template, band = self.words[t], band_of(self.words[t])
            for start in mine:
                begin = start - band
                stretch = [0] * max(0, -begin) + ids[max(0, begin):max(0, start + len(template) + band)]
                matched, first, last = align(template, stretch, band)
                if matched / len(template) >= min_coverage:
                    out[t, first + begin, last + begin] = matched / len(template)
        if not out:
            return []
        spans = [m.span() for m in self.word.finditer(lowered)]
        # of overlapping matches of one template the best one stays, of equal ones the tightest
        kept = []
        for (t, first, last), coverage in sorted(out.items(), key=lambda x: (x[0][0], -x[1], x[0][2] - x[0][1], x[0][1])):
            if not any(k[0] == t and first <= k[3] and k[2] <= last for k in kept):
                kept.append((t, coverage, first, last))
        return sorted((self.names[t], c, spans[a][0], spans[b][1]) for t, c, a, b in kept)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage (share of the template's
    words found in order), span_start and span_end (characters, end exclusive).

    Words are letters and digits in lower case. A span that shares four words in
    a row (three, for templates of three) with a template is always a candidate.
    Null and empty texts have no matches; repeated rows each have theirs; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches):
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                for match in index.scan(text.as_py(), min_coverage):
                    rows.append(i)
                    found.append(match)
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64())],
                names=["doc_id", "license", "coverage", "span_start", "span_end"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, license string, coverage double, span_start bigint, span_end bigint")
