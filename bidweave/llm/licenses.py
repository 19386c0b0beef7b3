"""Licence scans: units of a text against licence templates by Dice coefficient over word bigrams (operator 4).

A text is normalised (A to Z lower-cased, every other ASCII sign than a letter or digit parts words). Its
units are its lines, its paragraphs (runs of lines that have a word) and the whole text. A unit with n
distinct bigrams can only reach the threshold t with templates of t / (2 - t) n to (2 - t) / t n
bigrams, so the others are not compared. A unit counts for the template that fits it best. A paragraph is only
compared if none of its lines fits a template, the whole text if nothing inside it does. Words that no such unit took
are searched once more for notices that share their line with other words: by sentence, then by windows of as many
bigrams as a template has, each from a bigram of the template on. Of overlapping windows the best one counts.

The SQL twin knows lines, paragraphs and the whole text, and the notices of TEMPLATES: it is a twin only where each notice is one of them
and has a line or paragraph of its own.

Bigrams are compared as 64-bit hashes; texts are read whole, a bounded slice at a time, where they lie.

Defined results: a null or empty text, and one without two words in a row, has no licence. Of templates that fit a
unit equally well the first by name counts. A null doc_id and repeated rows are rows like any other. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm import words as W

# Notices and short texts of public licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                   "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
          "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
          "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
          "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
          "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
          "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. ")
_GNU = ("This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        "Foundation; either version {version} of the License, or (at your option) any later version.")


def _gnu(name: str, version: str, kind: str = "program") -> list[str]:
    return [_GNU.format(kind=kind, name=name, version=version),
            f"This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}, version {version}, as "
            "published by the Free Software Foundation.", f"This work is licensed under the GNU {name}, version {version}."]


# Notices that the SQL twin does not know; whole texts are in the folder license_texts, named by licence.
MORE = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD + _AS_IS],
    "BSD-3-Clause": [_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission. " + _AS_IS],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
                "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
                "at https://www.eclipse.org/legal/epl-2.0/",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies "
                "this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"],
    "GPL-1.0": _gnu("General Public License", "1")[:2],
    "GPL-2.0": _gnu("General Public License", "2")[:2],
    "GPL-3.0": _gnu("General Public License", "3")[1:2],
    "LGPL-2.0": _gnu("Library General Public License", "2", "library"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library") + _gnu("Lesser General Public License", "2.1")[:2],
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "library")[:2] + _gnu("Lesser General Public License", "3")[:2],
    "MIT-0": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
              "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
              "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
                "compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License "
                "is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific "
                "language governing rights and limitations under the License."],
}


def all_templates() -> dict[str, list[str]]:
    """Notices and whole texts by licence."""
    out = {name: [*TEMPLATES.get(name, []), *MORE.get(name, [])] for name in TEMPLATES | MORE}
    for file in resources.files("bidweave.llm").joinpath("license_texts").iterdir():
        if file.name.endswith(".txt"):
            out.setdefault(file.name.removesuffix(".txt"), []).append(file.read_text("utf-8"))
    return out


_PARTS = np.arange(256, dtype=np.uint8)
_PARTS[:128] = 0x20
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _PARTS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _PARTS[_c] = _c + 32


def bigram_hashes(hashes: np.ndarray) -> np.ndarray:
    return W.mix(hashes[:-1] * W._BASE + hashes[1:]) if len(hashes) > 1 else hashes[:0]


def _ranges(bounds: np.ndarray, hits: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Ranges between neighbouring bounds (places of words) that have two words and enough known bigrams."""
    low, high = bounds[:-1], bounds[1:]
    good = high - low > 1
    low, high = low[good], high[good]
    good = hits[high - 1] - hits[low] >= least
    return list(zip(low[good].tolist(), high[good].tolist()))


def template_bigrams(texts: dict[str, list[str]]) -> list[tuple[str, np.ndarray, int]]:
    """(name, sorted distinct bigrams, number of bigrams) of each template, by name."""
    out = []
    for name in sorted(texts):
        for text in texts[name]:
            data = _PARTS[np.frombuffer(text.encode(), np.uint8)]
            grams = bigram_hashes(W.words(data, np.array([0, len(data)]))[2])
            out.append((name, np.unique(grams), len(grams)))
    return out


def _units(data: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Ranges of words of the lines, the paragraphs and the whole of one text; starts: places of its words."""
    breaks = np.flatnonzero(data == 0x0A) + 1
    edges = np.searchsorted(starts, np.concatenate([[0], breaks, [len(data)]]))
    lines, paragraphs, first = [], [], None
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if low < high:
            lines.append((low, high))
            first = low if first is None else first
        elif first is not None:
            paragraphs.append((first, low))
            first = None
    if first is not None:
        paragraphs.append((first, len(starts)))
    return [lines, paragraphs, [(0, len(starts))]]


def _sentences(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the first words of sentences (after a full stop, question or exclamation mark and white space, or a blank line), and the end."""
    marks = np.flatnonzero(((data[:-1] == 0x2E) | (data[:-1] == 0x21) | (data[:-1] == 0x3F)) & W._SPACE[data[1:]])
    blank = np.array([low for low, _ in _units(data, starts)[1]], np.int64)
    return np.unique(np.concatenate([[0], np.searchsorted(starts, marks), blank, [len(starts)]]))


def _repeats(before: np.ndarray, after: np.ndarray, size: int, total: int) -> np.ndarray:
    """Number of neighbouring occurrences (before, after) of a bigram that lie inside the window of `size` bigrams from each place on."""
    near = after - before < size
    low, high = np.maximum(after[near] - size + 1, 0), before[near] + 1
    return np.cumsum(np.bincount(low, minlength=total + 1) - np.bincount(high, minlength=total + 1))


def _windows(grams: np.ndarray, place: np.ndarray, known: np.ndarray, templates: list[tuple[str, np.ndarray, int]], threshold: float,
             taken: np.ndarray) -> list[tuple[float, str, int, int]]:
    """(coefficient, name, first and last word + 1) of windows without taken words that fit a template, the best one of those that overlap."""
    at = np.flatnonzero((known[place] == grams) & ~taken[:-1] & ~taken[1:])
    values = grams[at]
    walls = np.concatenate([[-1], np.flatnonzero(taken), [len(taken)]])  # a window stays between taken words
    wall = np.searchsorted(walls, at)
    left, right = walls[wall - 1] + 1, walls[wall] - 1
    before, out = None, []
    for name, template, length in templates:
        m = len(template)
        least = m * threshold / (2 - threshold)
        mine = template[np.minimum(np.searchsorted(template, values), m - 1)] == values
        if np.count_nonzero(mine) < least:
            continue
        here = at[mine]
        first, one = np.unique(np.maximum(left[mine], np.minimum(here, right[mine] - length)), return_index=True)
        last = np.minimum(first + length, right[mine][one])
        count = np.searchsorted(here, last) - np.searchsorted(here, first)
        good = count >= least
        if not good.any():
            continue
        if before is None:
            order = np.argsort(grams, kind="stable")
            same = grams[order[1:]] == grams[order[:-1]]
            before, after = order[:-1][same], order[1:][same]
        first, last, count = first[good], last[good], count[good]
        hit = np.zeros(len(grams), bool)
        hit[here] = True
        both = hit[before] & hit[after]
        distinct = length - _repeats(before, after, length, len(grams))[first]
        common = count - _repeats(before[both], after[both], length, len(grams))[first]
        for k in np.flatnonzero(last - first < length).tolist():  # a whole range between taken words
            unit = np.unique(grams[first[k]:last[k]])
            distinct[k], common[k] = len(unit), len(np.intersect1d(unit, template, assume_unique=True))
        fit = 2 * common / (distinct + m)
        cover = np.zeros(len(grams))  # best coefficient of a window over the bigram
        for k in np.argsort(-fit, kind="stable")[:np.count_nonzero(fit >= threshold)].tolist():
            low, high = int(first[k]), int(last[k])
            if cover[low:high].max() < fit[k]:
                np.maximum(cover[low:high], fit[k], out=cover[low:high])
                out.append((float(fit[k]), name, low, high + 1))
    best, used = [], taken.copy()
    for value, name, low, high in sorted(out, key=lambda x: (-x[0], x[2] - x[3], x[1], x[2])):
        if not used[low:high].any():
            used[low:high] = True
            best.append((value, name, low, high))
    return best


def scan_text(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray, templates: list[tuple[str, np.ndarray, int]], known: np.ndarray,
              threshold: float) -> dict[str, float]:
    """Best coefficient of each licence that a unit of the text fits best."""
    grams = bigram_hashes(hashes)
    if not len(grams):
        return {}
    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hits = np.concatenate([[0], np.cumsum(known[place] == grams)])
    least = min(len(t) for _, t, _ in templates) * threshold / (2 - threshold)
    if hits[-1] < least:
        return {}
    found: dict[str, float] = {}
    taken = np.zeros(len(starts), bool)  # words of units that fit
    sentences = _ranges(_sentences(data, starts), hits, least)
    for units in [*_units(data, starts), sentences]:
        for low, high in units:
            if high - low < 2 or hits[high - 1] - hits[low] < least or taken[low:high].any():
                continue
            unit = np.unique(grams[low:high - 1])
            n, best = len(unit), (0.0, "")
            for name, template, _ in templates:
                m = len(template)
                if n * threshold <= m * (2 - threshold) and m * threshold <= n * (2 - threshold):
                    value = 2 * len(np.intersect1d(unit, template, assume_unique=True)) / (n + m)
                    if value >= threshold and value > best[0]:
                        best = (value, name)
            if best[0]:
                found[best[1]] = max(best[0], found.get(best[1], 0.0))
                taken[low:high] = True
    for value, name, _, _ in _windows(grams, place, known, templates, threshold, taken):
        found[name] = max(value, found.get(name, 0.0))
    return found


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """Per row: (doc_id, licenses, best_license, best_dice); licenses are sorted and joined by commas, best ones null without any."""
    known = template_bigrams(templates or all_templates())
    grams = np.unique(np.concatenate([t for _, t, _ in known]))

    def run(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            names, best, values = [], [], []
            for first, last in W.slices(offsets):
                edges = offsets[first:last + 1] - offsets[first]
                part = data[offsets[first]:offsets[last]]
                starts, _, hashes = W.words(_PARTS[part], edges)
                bounds = np.searchsorted(starts, edges)
                for row in range(last - first):
                    low, high = bounds[row], bounds[row + 1]
                    found = scan_text(part[edges[row]:edges[row + 1]], starts[low:high] - edges[row], hashes[low:high], known, grams, threshold)
                    top = min(found, key=lambda k: (-found[k], k)) if found else None
                    names.append(",".join(sorted(found)))
                    best.append(top)
                    values.append(round(found[top], 6) if top else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.string()), pa.array(values, pa.float64())],
                                             names=["doc_id", "licenses", "best_license", "best_dice"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, licenses string, best_license string, best_dice double")


def sql(threshold: float = 0.8) -> str:
    """The same over the table documents, for the templates above."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {i}, {quote(re.sub('[^a-z0-9]+', ' ', text.lower()).strip())})"
                     for i, (name, text) in enumerate((name, text) for name in sorted(TEMPLATES) for text in TEMPLATES[name]))
    norm = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    grams = "SELECT DISTINCT {key}, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT {key}, string_split(t, ' ') AS w FROM {src}) WHERE len(w) > 1"
    return f"""
WITH temp(name, tid, t) AS (VALUES {rows}),
lines AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, i, {norm.format('line')} AS t FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
units AS (SELECT *, row_number() OVER () AS u FROM (
  SELECT doc_id, 0 AS kind, p, t FROM lines WHERE t <> ''
  UNION ALL SELECT doc_id, 1, p, string_agg(t, ' ' ORDER BY i) FROM lines WHERE t <> '' GROUP BY doc_id, p
  UNION ALL SELECT doc_id, 2, 0, {norm.format("coalesce(text, '')")} FROM documents)),
tg AS (SELECT DISTINCT name, tid, unnest(g) AS g FROM ({grams.format(key='name, tid', src='temp')})),
ug AS (SELECT DISTINCT doc_id, kind, p, u, unnest(g) AS g FROM ({grams.format(key='doc_id, kind, p, u', src='units')})),
tn AS (SELECT name, tid, count(*) AS m FROM tg GROUP BY ALL),
un AS (SELECT u, count(*) AS n FROM ug GROUP BY ALL),
fits AS (SELECT ug.doc_id, ug.kind, ug.p, ug.u, tg.name, 2.0 * count(*) / (any_value(n) + any_value(m)) AS d
  FROM ug JOIN tg USING (g) JOIN un ON un.u = ug.u JOIN tn USING (tid) GROUP BY ug.doc_id, ug.kind, ug.p, ug.u, tg.name, tg.tid),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d DESC, name) AS r FROM fits WHERE d >= {threshold}) WHERE r = 1),
good AS (SELECT * FROM one WHERE kind = 0
  UNION ALL SELECT * FROM one WHERE kind = 1 AND (doc_id, p) NOT IN (SELECT (doc_id, p) FROM one WHERE kind = 0)
  UNION ALL SELECT * FROM one WHERE kind = 2 AND doc_id NOT IN (SELECT doc_id FROM one WHERE kind < 2)),
best AS (SELECT doc_id, name, max(d) AS d FROM good GROUP BY doc_id, name),
docs AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names, arg_min(name, (-d, name)) AS top, max(d) AS d FROM best GROUP BY doc_id)
SELECT documents.doc_id, coalesce(names, '') AS licenses, top AS best_license, round(CAST(d AS DOUBLE), 6) AS best_dice
FROM documents LEFT JOIN docs ON documents.doc_id = docs.doc_id"""
