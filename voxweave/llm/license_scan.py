"""Licence texts and notices in documents: Dice coefficient over word bigrams against templates, of texts, lines and windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM_LOWER, Words, mix, slices, utf8

#: Licence notices as projects write them. ``<name>`` in several wordings.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License v3.0."),
    ("AGPL-3.0", "Released under the GNU Affero General Public License v3.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]
#: Headers and notices that are looked for inside texts and lines, besides those above and the full texts
#: in ``licenses``. Notices of all versions are listed, so that none is taken for another one.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *[(f"{short}-{v}.0", f"This program is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {either}version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/.")
      for short, name, v, sep, either in (("GPL", "General Public License", 3, ":", "either "), ("GPL", "General Public License", 2, ";", "either "), ("LGPL", "Lesser General Public License", 3, ":", "either "), ("AGPL", "Affero General Public License", 3, ":", "either "))],
    *[(f"{short}-{v}" if v else short, f"{verb} under the GNU {name}{form}.")
      for short, name, versions in (("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
      for verb in ("Released", "Licensed") for v, form in [(v, f) for v in versions for f in (f" v{v}", f" version {v}", f", version {v.removesuffix('.0')}", f" v{v.removesuffix('.0')}")] + [("", "")]],
    *[(f"CC-{short}-{v}", f"{verb} licensed under a Creative Commons {name} {v} {area} License.")
      for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, area, verb in (("4.0", "International", "This work is"), ("3.0", "Unported", "This work is"))],
    *[(f"CC-{short}-{v}", f"Licensed under CC {short} {v}.") for short in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0", "2.0")],
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."), ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("ISC", "Licensed under the ISC License."), ("ISC", "Released under the ISC License."),
    ("All-rights-reserved", "All rights reserved."),
]
MOST_TEMPLATES = 4096
WINDOW = -2


@cache
def window_templates() -> list[tuple[str, str]]:
    """All templates that windows are compared with. The AGPL's text is made of the GPL's, from which it differs little."""
    full = [(x.stem, x.read_text()) for x in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    affero = [("AGPL-3.0", t.replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("General Public", "Affero General Public")) for n, t in full if n == "GPL-3.0"]
    return [*TEMPLATES, *HEADERS, *full, *affero]


def bigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every word bigram."""
    return w.windows(2, 0xC2B2AE3D27D4EB4F)


class Templates:
    """Bigram sets of the templates and the sorted union of their bigrams."""

    def __init__(self, templates: list[tuple[str, str]]):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(bigrams(Words(*utf8(pa.array([t])), ALNUM_LOWER))[1]) for _, t in templates]
        self.sizes = np.array([len(s) for s in self.sets])
        self.lengths = [len(bigrams(Words(*utf8(pa.array([t])), ALNUM_LOWER))[1]) for _, t in templates]
        self.every = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.holds = np.stack([np.isin(self.every, s) for s in self.sets]) if self.sets else np.zeros((0, 0), bool)
        bits = np.zeros(1 << 16, bool)
        bits[(mix(self.every) & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.bits = bits

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among all template bigrams, -1 if it is none of them."""
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(self.bits[(mix(hashes) & np.uint64(0xFFFF)).astype(np.int64)])
        if len(self.every) and len(maybe):
            at = np.minimum(np.searchsorted(self.every, hashes[maybe]), len(self.every) - 1)
            same = self.every[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out

    def matches(self, found: np.ndarray, size: int, least: float) -> list[tuple[int, float]]:
        """Templates with a Dice coefficient of ``least`` or more with a set of ``size`` bigrams, of which ``found``
        are template bigrams. 2 min / (a + b) bounds the coefficient, so that other sizes are pruned."""
        fits = np.flatnonzero(2.0 * np.minimum(self.sizes, size) >= least * (self.sizes + size))
        if not len(fits) or not len(found):
            return []
        dice = 2.0 * self.holds[fits][:, found].sum(1) / (self.sizes[fits] + size)
        return [(int(t), float(d)) for t, d in zip(fits, dice) if d >= least]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """Licences of documents.

    docs(doc_id, text, ...) -> doc_id, licenses array<struct<license, dice, unit, first, words>>, one row per input row.
    Units are the whole text (unit -1) and each of its lines (by number from 0, lines without a bigram left out). A
    unit is matched with each template by the Dice coefficient of their sets of word bigrams (letters and digits, lower
    case); for a unit and a licence the best template counts. ``first`` is the unit's first word in the text, ``words``
    their number. Texts of one line are listed as the whole text alone. Besides, windows of words (unit -2) inside
    lines and over line breaks are matched with these templates, further notices and full licence texts; of windows
    that overlap the one with most template bigrams counts, and a window is left out if the whole text or a line of at
    least half its words has its licence. Given ``templates`` are used for both. Sorted by unit, then licence. Null,
    empty and one-word texts: none. Null or repeated doc_id: rows are independent. Empty table: no rows. Other columns
    are ignored.
    """
    wide = Templates(window_templates() if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast((Templates(TEMPLATES if templates is None else templates), wide))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("unit", pa.int32()), ("first", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], 2 << 20):
                part = batch.slice(a, b - a)
                yield pa.record_batch({"doc_id": part["doc_id"], "licenses": pa.array(_scan(part["text"], *shared.value, least), kind)})

    return docs.mapInArrow(run, "doc_id long, licenses array<struct<license:string,dice:double,unit:int,first:long,words:long>>")


def _scan(column: pa.Array, templates: Templates, wide: Templates, least: float) -> list[list[dict]]:
    w = Words(*utf8(column), ALNUM_LOWER)
    at, h = bigrams(w)
    known = templates.known(h)
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.starts)  # lines of the whole buffer, counted through
    text = w.text_of()
    out: list[list[dict]] = [[] for _ in range(len(column))]
    hits = np.flatnonzero(known >= 0)
    for t in np.unique(text[at[hits]]):
        a, b = int(w.first[t]), int(w.first[t + 1])
        mine = slice(np.searchsorted(at, a), np.searchsorted(at, b))
        base = int(np.searchsorted(breaks, w.offsets[t]))
        many = bool(np.searchsorted(breaks, w.offsets[t + 1]) > base)
        units = [(-1, a, b, np.arange(mine.start, mine.stop))]
        if many:
            inside = np.arange(mine.start, mine.stop)
            same = line[at[inside]] == line[at[inside] + 1]
            inside = inside[same]
            for n in np.unique(line[at[inside[known[inside] >= 0]]]):
                first, last = np.searchsorted(line[a:b], [n, n + 1]) + a
                units.append((int(n) - base, int(first), int(last), inside[line[at[inside]] == n]))
        for unit, first, last, places in units:
            best: dict[str, float] = {}
            found = np.unique(known[places])
            for m, d in templates.matches(found[found >= 0], len(np.unique(h[places])), least):
                best[templates.names[m]] = max(d, best.get(templates.names[m], 0.0))
            out[t] += [{"license": k, "dice": v, "unit": unit, "first": first - a, "words": last - first} for k, v in sorted(best.items())]
    for t, found in _windows(w, at, h, text, wide, least).items():
        units = [(x["license"], x["unit"], x["first"], x["first"] + x["words"]) for x in out[t]]
        fresh = [x for x in found if not any(
            n == x["license"] and (u == -1 or 2 * (min(e, x["first"] + x["words"]) - max(s, x["first"])) >= x["words"]) for n, u, s, e in units)]
        out[t] = sorted(fresh, key=lambda x: (x["license"], x["first"])) + out[t]
    return out


def _windows(w: Words, at: np.ndarray, h: np.ndarray, text: np.ndarray, wide: Templates, least: float) -> dict[int, list[dict]]:
    """Windows of each text that match a template. Only texts that hold enough of a template's bigrams are searched."""
    known = wide.known(h)
    hits = np.flatnonzero(known >= 0)
    if not len(hits):
        return {}
    n, every = len(w.first) - 1, len(wide.every)
    pairs = np.unique(text[at[hits]].astype(np.int64) * every + known[hits])
    owner, which = pairs // every, pairs % every
    found: dict[int, list[tuple]] = {}
    for m in range(len(wide.names)):
        enough = np.bincount(owner[wide.holds[m][which]], minlength=n) * (2 - least) >= least * wide.sizes[m] - 1e-9
        for t in np.flatnonzero(enough & (wide.sizes[m] > 0)).tolist():
            low, high = np.searchsorted(at, [w.first[t], w.first[t + 1]])
            places = np.arange(low, high)[known[low:high] >= 0]
            places = places[wide.holds[m][known[places]]]
            for a, b in _spans(places.tolist(), known[places].tolist(), int(wide.sizes[m]), wide.lengths[m], least):
                common, size = len(np.unique(known[places[(places >= a) & (places <= b)]])), len(np.unique(h[a:b + 1]))
                dice = 2.0 * common / (size + int(wide.sizes[m]))
                if dice >= least:
                    found.setdefault(t, []).append((-common, -dice, wide.names[m], int(at[a]), int(at[b]) + 2))
    out = {}
    for t, spans in found.items():
        taken: list[tuple] = []
        for x in sorted(spans):
            if all(x[4] <= y[3] or y[4] <= x[3] for y in taken):
                taken.append(x)
        base = int(w.first[t])
        out[t] = [{"license": k, "dice": -d, "unit": WINDOW, "first": a - base, "words": b - a} for _, d, k, a, b in taken]
    return out


def _spans(places: list[int], items: list[int], size: int, length: int, least: float) -> Iterator[tuple[int, int]]:
    """Windows (first and last bigram) whose Dice coefficient with a template may reach ``least``.

    2 common - least (window + size) >= 0 is a sum over the window: a template's bigram adds 2 - least the first time,
    any other takes ``least``. The best sum is found in one pass that starts anew where the sum is used up. A window is
    at most (2 - least) / least as long as the template.
    """
    most, step, k = length * (2 - least) / least + 1, max(1, length // 64), 0
    while k < len(places):
        total, best, end, seen, i = 0.0, 0.0, k, set(), k
        while i < len(places) and places[i] - places[k] < most:
            if i > k:
                total -= least * (places[i] - places[i - 1] - 1)
                if total <= 0:
                    break
            if items[i] not in seen:
                seen.add(items[i])
                total += 2 - least
                if total > best:
                    best, end = total, i
            i += 1
        if best >= least * size - 1e-9:
            yield places[k], places[end]
            k = end + 1
        else:
            k = i if total <= 0 else k + step
