"""Operator 9: licence scans by Dice coefficient over word bigrams.

A text is cut into units: its lines, its paragraphs (lines up to a blank one), its runs of as many paragraphs as a
template has, and itself.  A unit is
normalised to lower-case ASCII-letter, digit and non-ASCII words and compared with each template by the
Dice coefficient of the bigram multisets.  A template of m bigrams can only reach ``least`` with a unit
of between m * least / (2 - least) and m * (2 - least) / least bigrams, which prunes most pairs; a
document that shares too few bigrams with every template is passed over at once.  Both prunings are exact.

The templates given here are the notices and the shorter texts of public licences; ``read_templates`` takes others, such
as whole long licences, from a folder of text files.

Cases: a null or empty text has no match; without templates nothing matches; units of one word have no bigram and no match; ties between
templates go to the longer one, then to the first by name; repeated rows are scanned each; an empty table gives an empty result;
other columns are not read; long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import map_texts
from bitballot.llm._words import Words, mix, utf8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_USE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Notices by which public licences are commonly granted, and the texts of short licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS,
    "BSD-2-Clause-text": _BSD_USE + _BSD_AS_IS,
    "BSD-3-Clause-text": _BSD_USE + _BSD_NAMES + _BSD_AS_IS,
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS,
    "MIT-text": _MIT,
    "Unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
OUTSIDE = bytes(b for b in range(128) if not chr(b).isalnum())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bigrams(text: str) -> Counter:
    w = WORD.findall(text.translate(LOWER))
    return Counter(zip(w, w[1:]))


def paragraphs(lines: list[str]) -> list[list[str]]:
    """The runs of lines between blank ones."""
    out, inside = [], []
    for line in [*lines, ""]:
        if line.strip():
            inside.append(line)
        elif inside:
            out.append(inside)
            inside = []
    return out


def units(text: str, runs: tuple[int, ...] = (1,)):
    """Distinct units, each once: lines, paragraphs of several lines, ``runs`` of paragraphs, the text."""
    lines = text.split("\n")
    yield from lines
    found = paragraphs(lines)
    for n in runs:
        for i in range(len(found) - n + 1):
            unit = [line for p in found[i : i + n] for line in p]
            if 1 < len(unit) < len(lines):
                yield "\n".join(unit)
    if len(lines) > 1:
        yield text


def read_templates(spark, path: str) -> dict[str, str]:
    """Templates by file name, of a folder of texts on any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()  # as many as licences
    return {r.name.rsplit(".", 1)[0]: r.value for r in rows}


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        import numpy as np

        self.least = least
        self.known = [(name, b := bigrams(t), b.total()) for name, t in sorted(templates.items())]
        self.runs = tuple(sorted({1, *(len(paragraphs(t.split("\n"))) for t in templates.values())} - {0}))
        self.words = Words(OUTSIDE)
        rows: dict[int, set[int]] = {}
        for i, (_, grams, _) in enumerate(self.known):
            for h in self._hashes([" ".join(g) for g in grams])[1].tolist():
                rows.setdefault(h, set()).add(i)
        self.hashes = np.array(sorted(rows), np.uint64)
        self.has = np.zeros((len(rows), len(self.known)), np.int64)
        for r, h in enumerate(self.hashes.tolist()):
            self.has[r, list(rows[h])] = 1
        self.need = np.array([least * m / (2 - least) for _, _, m in self.known])

    def _hashes(self, texts):
        """Row and hash of each bigram."""
        import numpy as np
        import pyarrow as pa

        row, _, _, h = self.words(*utf8(texts if not isinstance(texts, list) else pa.array(texts)))
        with np.errstate(over="ignore"):
            pair = mix(h[:-1] * np.uint64(3) + h[1:])
        keep = row[:-1] == row[1:]
        return row[:-1][keep], pair[keep]

    def possible(self, column):
        """Rows that share enough bigrams with some template."""
        import numpy as np

        row, h = self._hashes(column)
        if not len(self.hashes):
            return np.zeros(len(column), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        counts = np.zeros((len(column), len(self.known)), np.int64)
        np.add.at(counts, row[hit], self.has[at[hit]])
        return (counts >= self.need - 1e-9).any(axis=1)

    def matches(self, text: str) -> list[tuple[float, int, str]]:
        """(Dice, bigrams of the template, template) of each unit that reaches ``least`` for its best template."""
        out = []
        for unit in units(text, self.runs):
            grams = bigrams(unit)
            n, best = grams.total(), None
            for name, known, m in self.known:
                if not n or not m * self.least / (2 - self.least) <= n + 1e-9 or not n <= m * (2 - self.least) / self.least + 1e-9:
                    continue
                dice = 2 * (grams & known).total() / (n + m)
                if dice >= self.least and (best is None or (dice, m) > best[:2]):
                    best = (dice, m, name)
            if best:
                out.append(best)
        return out


SCHEMA = "doc_id long, license string, dice double, n_matches long, licenses string"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: best template (null without a match), its Dice, matching units, all matching templates comma-joined."""
    templates = TEMPLATES if templates is None else templates

    def start():
        import pyarrow as pa

        scanner = Scanner(templates, least)

        def work(part):
            may, rows = scanner.possible(part.column("text")), []
            for doc_id, text, look in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), may):
                found = scanner.matches(text) if look else []
                best = min(found, key=lambda x: (-x[0], -x[1], x[2]), default=(0.0, 0, None))
                rows.append((doc_id, best[2], best[0], len(found), ",".join(sorted({name for _, _, name in found}))))
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in SCHEMA.split(", ")])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, start, SCHEMA)
