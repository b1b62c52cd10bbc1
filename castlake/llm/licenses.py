"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

Texts and templates are reduced to lower-case words (runs of letters and digits). A passage is a run of whole units
(sentences, ended by . ! ? or a line break); the whole text is one, too, if it is short enough. With A and B the numbers
of bigrams of passage and template and C that of the common ones (all with repeats), Dice is 2C / (A + B). As C is at
most the smaller of A and B, only templates with A t / (2 - t) <= B <= A (2 - t) / t can reach t: the templates are
sorted by size and only that range is compared. Passages begin and end with a unit that has a bigram of some template.
Of overlapping passages for a licence the one of greatest Dice is kept (the first, the shortest of equals). A passage
that reaches t with several licences (GPL notices differ in a version alone) is one of those of greatest Dice.

Defined results: null texts and texts with fewer than two words match nothing; repeated rows are each reported; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready
from .words import ALNUM, blocks, grams, hashes, spans, sums

THRESHOLD = 0.9


def _gnu(name: str, version: str, of: str = "program") -> str:
    return f"This {of} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {of} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."


def _bsd(more: str = "") -> str:
    return f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {more}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


#: Wordings of licences and notices, by identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "All-rights-reserved": ("All rights reserved.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _gnu("General Public License", "2")),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("Lesser General Public License", "2.1", "library"), _gnu("Lesser General Public License", "2.1")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("Lesser General Public License", "3", "library"), _gnu("Lesser General Public License", "3")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _gnu("Affero General Public License", "3")),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _bsd()),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _bsd("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
#: What licences are called in short notices.
NAMES = {
    "Apache-2.0": "Apache License 2.0",
    "GPL-2.0": "GNU General Public License v2.0",
    "GPL-3.0": "GNU General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License v2.1",
    "LGPL-3.0": "GNU Lesser General Public License v3.0",
    "AGPL-3.0": "GNU Affero General Public License v3.0",
    "MIT": "MIT License",
    "ISC": "ISC License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "MPL-2.0": "Mozilla Public License 2.0",
    "BSL-1.0": "Boost Software License 1.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "Unlicense": "Unlicense",
}
NOTICES = ("Licensed under the {}", "Licensed under the terms of the {}", "Released under the {}", "Distributed under the {}", "Distributed under the terms of the {}", "This project is licensed under the {}", "This software is licensed under the {}")


def _noticed(templates: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The templates, with identifier lines of all licences and short notices of those that have a name."""
    lines = {name: [f"SPDX-License-Identifier: {name}", *(n.format(NAMES[name]) for n in NOTICES if name in NAMES)] for name in templates if name != "All-rights-reserved"}
    return {name: tuple(dict.fromkeys([*texts, *lines.get(name, [])])) for name, texts in templates.items()}


TEMPLATES = _noticed(TEMPLATES)
BREAK = np.zeros(256, np.int64)
BREAK[[ord(c) for c in ".!?\n"]] = 1


def _bigrams(text: str) -> np.ndarray:
    for _, _, data, offs in blocks(pa.array([text])):
        starts, ends, _ = spans(data, offs, ALNUM)
        return grams(hashes(sums(data), starts, ends), 2)
    return np.zeros(0, np.uint64)


@dataclass
class Templates:
    names: list[str]
    bags: list[Counter]
    sizes: list[int]  # sorted
    known: np.ndarray
    threshold: float

    def range(self, n: int) -> range:
        """The templates whose size can give the threshold with n bigrams."""
        t = self.threshold
        return range(bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9))


def prepared(templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> Templates:
    found = sorted(((len(b), name, b) for name, texts in (templates or TEMPLATES).items() for b in map(_bigrams, texts) if len(b)), key=lambda x: x[:2])
    return Templates([x[1] for x in found], [Counter(x[2].tolist()) for x in found], [x[0] for x in found], np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in found)])), threshold)


def passages(t: Templates, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, float, int, int, int]]:
    """(row, licence, dice, start, end, bigrams) of a block; start and end are bytes of the row's text."""
    starts, ends, at = spans(data, offs, ALNUM)
    if len(starts) < 2 or not t.sizes:
        return []
    pair = grams(hashes(sums(data), starts, ends), 2)
    i = np.minimum(np.searchsorted(t.known, pair), len(t.known) - 1)
    hit = t.known[i] == pair
    hit[at[(at > 0) & (at < len(starts))] - 1] = False  # no pairs over the border of two rows
    row_of = np.searchsorted(at, np.flatnonzero(hit), "right") - 1
    if not len(row_of):
        return []
    unit = np.cumsum(BREAK[data])[starts]
    most = int(t.sizes[-1] * (2 - t.threshold) / t.threshold) + 1
    out = []
    for row in np.unique(row_of).tolist():
        a, b = int(at[row]), int(at[row + 1])
        own = unit[a:b]
        first = a + np.flatnonzero(np.diff(own, prepend=-1))  # first words of units
        last = np.append(first[1:], b)
        # units with a known pair that ends or begins in them
        near = np.flatnonzero(hit[a : max(a, b - 1)]) + a
        marked = np.unique(np.searchsorted(first, np.concatenate([near, near + 1]), "right") - 1)
        found: dict[str, list[tuple[float, int, int, int]]] = {}
        for x in range(len(marked)):
            for y in range(x, len(marked)):
                begin, stop = int(first[marked[x]]), int(last[marked[y]])
                n = stop - begin - 1
                if n > most:
                    break
                if n < 1:
                    continue
                near_sizes = t.range(n)
                if len(near_sizes):
                    bag = Counter(pair[begin : stop - 1].tolist())
                    reached: dict[str, float] = {}
                    for k in near_sizes:
                        other = t.bags[k]
                        dice = 2 * sum(min(v, other[g]) for g, v in bag.items() if g in other) / (n + t.sizes[k])
                        if dice >= t.threshold:
                            reached[t.names[k]] = max(dice, reached.get(t.names[k], 0))
                    for name, dice in reached.items():
                        if dice == max(reached.values()):
                            found.setdefault(name, []).append((-dice, begin, stop, n))
        for name, spots in found.items():
            taken: list[tuple[int, int]] = []
            for dice, begin, stop, n in sorted(spots, key=lambda s: (s[0], s[1], s[2])):
                if all(stop <= p or begin >= q for p, q in taken):
                    taken.append((begin, stop))
                    out.append((row, name, -dice, int(starts[begin] - offs[row]), int(ends[stop - 1] - offs[row]), n))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, start, end, n_bigrams) of every passage of docs that matches a template."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(prepared(templates, threshold))
    schema = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("n_bigrams", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[i + r], *x) for i, _, data, offs in blocks(batch["text"]) for r, *x in passages(held.value, data, offs)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licence string, dice double, start long, end long, n_bigrams long")
