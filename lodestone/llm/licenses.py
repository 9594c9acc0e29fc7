"""License scan by patience alignment.

A template is aligned with a text on the words that occur once in both: of these anchors the longest increasing subsequence
stays, and the gaps between them are aligned in the same way, after equal words at their ends have been matched.  Coverage is
the share of the template's words matched; a match also has to be dense in the text.

A text is aligned only where a template can be covered: it has to hold enough of its words, and of the template's rarest words there
one at least is matched by any cover.  Each place of such a word says where the template would begin; the template is aligned with
the stretch of its own size there and with one of twice its size around it.  So a notice with all its words in a row is always found,
next to others and among words of its own as well.

Rows: null, empty and wordless texts have no license; ties go to the template first in the list; very long texts are searched whole;
repeated rows give repeated results; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, table

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "reserved": "All rights reserved",
}
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in order of the first number, whose second numbers increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        tops[k:k + 1], at[k:k + 1] = [b], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1 and na.get(b[j]) == 1}
        anchors = increasing([(i, place[a[i]]) for i in range(a0, a1) if a[i] in place])
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k - i > 1 and m - j > 1]
    return sorted(out)


def find(text: list[str], template: list[str], places: dict[str, list[int]], coverage: float, density: float) -> list[tuple[float, int, int]]:
    """Stretches of the text that cover the template enough: coverage, first and last matched word + 1; without overlap, from the left."""
    need = Counter(template)
    if sum(min(n, len(places.get(w, ()))) for w, n in need.items()) < coverage * len(template):
        return []
    # Of these words one at least is matched, whatever a cover leaves out.
    rare = sorted(range(len(template)), key=lambda i: len(places.get(template[i], ())))[: len(template) - int(coverage * len(template)) + 1]
    size, out = len(template), set()
    for at in {p - i for i in rare for p in places.get(template[i], ())}:
        for lo, hi in ((at, at + size), (at - size // 2, at + size + size // 2 + 1)):
            lo = max(0, lo)
            got = align(template, text[lo : max(lo, hi)])
            if got and len(got) >= coverage * size:
                first, last = lo + got[0][1], lo + got[-1][1] + 1
                if len(got) >= density * (last - first):
                    out.add((len(got) / size, first, last))
                if len(got) == size == last - first:
                    break
    kept: list[tuple[float, int, int]] = []
    for c, s, e in sorted(out, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if all(e <= s2 or s >= e2 for _, s2, e2 in kept):
            kept.append((c, s, e))
    return sorted(kept, key=lambda x: x[1])


OUT = pa.schema([("doc_id", pa.int64()), ("n_found", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], coverage: float, density: float) -> Iterator[pa.RecordBatch]:
    cut = {name: words(t) for name, t in templates.items()}
    known = {w for t in cut.values() for w in t}
    for b in batches:
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            seen = words(text.as_py() or "")
            places: dict[str, list[int]] = {}
            if len(common := known.intersection(seen)) > 1:
                for j, w in enumerate(seen):
                    if w in common:
                        places.setdefault(w, []).append(j)
            found = [(c, name, s, e) for name, t in cut.items() for c, s, e in find(seen, t, places, coverage, density)] if places else []
            best = max(found, key=lambda x: (x[0] * len(cut[x[1]]), x[0])) if found else (0.0, None, 0, 0)
            rows.append((key, len(found), best[1], best[0], ",".join(f"{n}:{c:.3f}:{s}:{e}" for c, n, s, e in sorted(found, key=lambda x: (x[2], x[1])))))
        yield batch(OUT, **dict(zip(OUT.names, zip(*rows) if rows else [[]] * 5)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, density: float = 0.6) -> DataFrame:
    """One row a document: how many stretches cover a template, the license of which most words match, and all stretches as name:coverage:first word:end."""
    given = TEMPLATES if templates is None else templates
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(lambda bs: _scan(bs, given, coverage, density), "doc_id long, n_found long, license string, coverage double, spans string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
