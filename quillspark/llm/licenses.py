"""Licence scans: Dice coefficient over word bigrams between windows of a text and licence templates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import only

THRESHOLD = 0.8

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
NORMAL = bytes.maketrans(_UPPER + _PUNCTUATION, _UPPER.lower() + b" " * len(_PUNCTUATION))

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as
published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_UNLICENSE_END = """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely
in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE
SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_LGPL_21 = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
Public License for more details."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."
#: Whole texts in licence_texts by file.
_WHOLE = {
    "Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}

#: Fixed public texts: (licence, form, template).
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "text", _GRANT),
    ("BSD-2-Clause", "text", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", "text", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    ("ISC", "text", _ISC),
    ("Apache-2.0", "notice", _APACHE),
    ("GPL-2.0", "notice", _GPL.format("General Public License", 2)),
    ("GPL-3.0", "notice", _GPL.format("General Public License", 3)),
    ("LGPL-3.0", "notice", _GPL.format("Lesser General Public License", 3)),
    ("AGPL-3.0", "notice", _GPL.format("Affero General Public License", 3)),
    ("MPL-2.0", "notice", _MPL),
    ("Unlicense", "text", _UNLICENSE),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "line", "Licensed under the MIT License."),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    *[(name, "text", (files(__package__) / "licence_texts" / f"{file}.txt").read_text("utf-8")) for name, file in _WHOLE.items()],
    ("ISC", "text", f"{_ISC} {_AS_IS}"),
    ("0BSD", "text", f"{_0BSD} {_AS_IS}"),
    ("Unlicense", "text", f"{_UNLICENSE} {_UNLICENSE_END}"),
    ("Zlib", "text", _ZLIB),
    ("BSL-1.0", "text", _BSL),
    ("LGPL-2.1", "notice", _LGPL_21),
    ("EPL-2.0", "notice", _EPL),
    ("CC-BY-4.0", "notice", _CC.format("Attribution")),
    ("CC-BY-SA-4.0", "notice", _CC.format("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", "notice", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-ND-4.0", "notice", _CC.format("Attribution-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "notice", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", "notice", _CC.format("Attribution-NonCommercial-NoDerivatives")),
    ("All-Rights-Reserved", "line", "All rights reserved."),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def dice(a: list, b: list) -> float:
    """Dice coefficient of two word lists over their bigrams, repeats counted."""
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    total = max(0, len(a) - 1) + max(0, len(b) - 1)
    return 2 * sum((x & y).values()) / total if total else 0.0


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Scanner:
    """Finds each template's best window in a text."""

    def __init__(self, templates: list[tuple[str, str, str]], threshold: float) -> None:
        self.templates = [(name, form, words_of(text)) for name, form, text in templates]
        self.threshold = threshold
        self.known = _Known()
        for _, _, words in self.templates:
            for w in words:
                self.known.setdefault(w, len(self.known) + 1)
        self.base = len(self.known) + 1
        self.coded = [np.array([self.known[w] for w in words], np.int64) for _, _, words in self.templates]
        has = [np.unique(c[:-1] * self.base + c[1:]) for c in self.coded]
        self.any = np.unique(np.concatenate(has)) if has else np.zeros(0, np.int64)
        self.has = [np.isin(self.any, x) for x in has]

    def __call__(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(template, Dice, first word, words) of the best window of each template that reaches the threshold."""
        words = words_of(text)
        n = len(words)
        if n < 2:
            return []
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, n)
        grams = code[:-1] * self.base + code[1:]
        grams[(code[:-1] == 0) | (code[1:] == 0)] = -1
        place = np.minimum(np.searchsorted(self.any, grams), len(self.any) - 1) if len(self.any) else np.zeros(0, np.int64)
        spots = np.flatnonzero(self.any[place] == grams) if len(place) else place
        place = place[spots]
        if not len(spots):
            return []
        out = []
        for k, (own, has) in enumerate(zip(self.coded, self.has, strict=True)):
            size = min(len(own), n)
            total = (size - 1) + (len(own) - 1)
            need = self.threshold * total / 2
            if size - 1 < need - 1e-9 or len(spots) < need - 1e-9:  # too short, or too little in common, for this template
                continue
            hit = has[place]
            if hit.sum() < need - 1e-9:
                continue
            marks = np.zeros(n, np.int64)
            marks[spots[hit] + 1] = 1
            upto = marks.cumsum()
            counts = upto[size - 1 :] - upto[: n - size + 1]
            best = (0.0, 0)
            goal = Counter(zip(own.tolist(), own[1:].tolist(), strict=False))
            for at in np.flatnonzero(counts >= need - 1e-9):
                if 2 * counts[at] / total <= best[0]:
                    continue
                window = code[at : at + size].tolist()
                both = sum((Counter(zip(window, window[1:], strict=False)) & goal).values())
                best = max(best, (2 * both / total, -int(at)))
            if best[0] >= self.threshold - 1e-12:
                out.append((k, best[0], -best[1], size))
        return out


def _scan(templates: list[tuple[str, str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("form", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = sorted(scan(t), key=lambda x: (-x[1], -x[3], x[0]))
                rows.append([{"license": templates[k][0], "form": templates[k][1], "dice": d, "start": at, "words": size} for k, d, at, size in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "matches"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licences found in every whole text.

    Words are what is left between ASCII signs and white space, A-Z lower-cased. A template of n words is compared with
    every window of n words (with the whole text if that is shorter) by the Dice coefficient of their bigrams, repeats
    counted; its best window, the first on ties, counts if it reaches ``threshold``. Size bounds leave out templates too
    long for a text; templates with too few of the text's bigrams, and windows, are left out by the same bound.

    Returns id, license (of the best match: by Dice, then longer, then the order of templates; null for none), dice (0
    for none) and matches (all templates that match, best first: license, form, dice, first word, words); one row for
    each input row. Null texts are empty; texts of fewer than two words match nothing.
    """
    rows = only(docs, id=id_col, text=text_col)
    kind = "array<struct<license: string, form: string, dice: double, start: long, words: long>>"
    out = rows.mapInArrow(_scan(templates, threshold), f"id {dict(rows.dtypes)['id']}, matches {kind}")
    best = F.try_element_at("matches", F.lit(1))
    return out.select(F.col("id").alias(id_col), best["license"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), "matches")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents; null and empty texts have none, rows that repeat an id are looked at each."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
