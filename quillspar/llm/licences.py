"""Licence scans by Dice coefficients over word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_KEPT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_KEPT = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices by which texts state their licence, with the licence's SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_KEPT}"),
    ("MIT", f"{_MIT} {_MIT_KEPT} {_MIT_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_KEPT} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_KEPT} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD}: {_BSD_KEPT} {_BSD_AS_IS}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("LicenseRef-reserved", "All rights reserved."),
    ("LicenseRef-reserved", "All rights reserved. No part of this text may be reproduced without permission."),
)
_WORD = re.compile(r"[a-z0-9]+")
_BYTES = re.compile(rb"[a-z0-9]+")


def bigrams(text: str) -> set[tuple[str, str]]:
    """Pairs of neighbouring words `[a-z0-9]+` after A-Z became a-z (other letters are no word characters)."""
    words = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(words, words[1:]))


class Templates:
    """Templates by size, so that those a unit can't match are never compared."""

    def __init__(self, templates, num: int, den: int):
        self.num, self.den = num, den
        found = sorted((len(b), name, b) for name, text in templates if (b := bigrams(text)))
        self.sizes = [x[0] for x in found]
        self.rows = found
        self.known: set = set().union(*(x[2] for x in found)) if found else set()
        self.coded = [(m, name, {(x.encode(), y.encode()) for x, y in b}) for m, name, b in found]

    def bounds(self, n: int) -> tuple[int, int]:
        """Indices of templates of m bigrams with 2 min(m, n) / (m + n) at the threshold or above."""
        t, d = self.num, self.den
        return bisect_left(self.sizes, -(-n * t // (2 * d - t))), bisect_right(self.sizes, n * (2 * d - t) // t)

    def best(self, unit: set) -> tuple[float, str] | None:
        """The highest Dice coefficient at or above the threshold, and its licence (ties: first by name)."""
        first, last = self.bounds(len(unit))
        if first >= last:
            return None
        out = None
        for m, name, b in self.rows[first:last]:
            shared = len(unit & b)
            if 2 * shared * self.den >= self.num * (m + len(unit)):
                new = (-(2 * shared / (m + len(unit))), name)
                out = min(out, new) if out else new
        return (-out[0], out[1]) if out else None


def _signs(table: Templates) -> list[str]:
    """Fragments one of which every matching text has, in lower case: for each template, bigrams that cover it.

    A match shares at least num/(2 den) of the template's bigrams, so it can't miss more than the rest of
    them: any larger set of its bigrams has one that is shared. Of those, the longest words are looked for.
    """
    out: set[str] = set()
    for m, _, b in table.rows:
        # |A & B| >= num (m + n) / (2 den) and n >= |A & B| give |A & B| >= num m / (2 den - num)
        shared = -(-table.num * m // (2 * table.den - table.num))
        longest = sorted((max(x, key=len) for x in b), key=len, reverse=True)
        out.update(longest[: m - shared + 1])
    return sorted(out)


def words_of(text: str | None) -> list[bytes]:
    """The words of `bigrams`, in order: bytes.lower() changes A-Z alone."""
    return _BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())


def windows(pairs: list, own: set, num: int, den: int):
    """(dice, first, last) of the best window from each bigram that starts one at the threshold or above.

    Windows are runs of neighbouring bigrams `pairs[first : last + 1]`, whose distinct ones are compared with `own`.
    They start and end at bigrams of `own`, and the first doesn't occur again in them: any other window
    has one of these within it that is at least as good. Ties go to the shorter.
    """
    m = len(own)
    least, most = -(-num * m // (2 * den - num)), m * (2 * den - num) // num
    held: dict = {}  # bigrams from i up to where there are too many for a match
    shared = until = 0
    for i, start in enumerate(pairs):
        while until < len(pairs) and (pairs[until] in held or len(held) < most):
            g = pairs[until]
            if g not in held:
                held[g] = 0
                shared += g in own
            held[g] += 1
            until += 1
        if shared >= least and start in own:
            seen, s, best = {start}, 1, (0.0, 0)
            if 2 * den >= num * (m + 1):
                best = (2 / (m + 1), -i)
            for j in range(i + 1, until):
                g = pairs[j]
                if g == start:
                    break
                if g not in seen:
                    seen.add(g)
                    if g in own:
                        s += 1
                        if 2 * s * den >= num * (m + len(seen)):
                            best = max(best, (2 * s / (m + len(seen)), -j))
            if best[0]:
                yield best[0], i, -best[1]
        held[start] -= 1
        if not held[start]:
            del held[start]
            shared -= start in own


def matches(words: list[bytes], table: Templates) -> list[tuple[float, int, int, str]]:
    """(-dice, first bigram, -last bigram, licence) of the windows that match, best first; none shares a word with a better one."""
    pairs = list(zip(words, words[1:]))
    every = set(pairs)
    found = []
    for m, name, own in table.coded:
        if len(own & every) * (2 * table.den - table.num) >= table.num * m:
            found += [(-dice, first, -last, name) for dice, first, last in windows(pairs, own, table.num, table.den)]
    starts, ends, out = [], [], []  # of those taken, in order of the text
    for x in sorted(found):
        first, last = x[1], 1 - x[2]
        k = bisect_right(starts, last)  # a window of bigrams [a, b] has the words [a, b + 1]
        if not k or ends[k - 1] < first:
            starts.insert(k, first)
            ends.insert(k, last)
            out.append(x)
    return out


def scan_licences(docs: DataFrame, templates=TEMPLATES, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_matches, licence, dice, line_no.

    The units are windows of neighbouring words anywhere in the whole text, whatever lines they stand on: a notice
    may be wrapped or stand within a sentence. A window matches a template when the Dice coefficient of their
    distinct word bigrams, 2 |A & B| / (|A| + |B|), is num/den or more. Of each template, the best window from
    each place counts (`windows`; sizes bound them); of windows that share a word, the best (ties: earlier,
    then longer, then name). `n_matches` counts those; licence, dice and line_no (from 1, of the first word) are of the
    best one, null when none matches. `n_lines` counts the lines, cut at line feeds.

    Null and empty texts have one empty line and no match. Repeated rows give repeated rows; ids may be null.
    Templates without a bigram are ignored. No shuffle; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = "doc_id long, n_lines long, n_matches long, licence string, dice double, line_no long"

    def run(batches):
        table = Templates(templates, num, den)
        # a text that matches holds a share of some template's words; most texts hold none of the rarer ones
        signs = [w.encode() for w in _signs(table)]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass").lower()
                hits = matches(words_of(text), table) if any(w in raw for w in signs) else []
                best = hits[0] if hits else None
                line = best and raw.count(b"\n", 0, next(islice(_BYTES.finditer(raw), best[1], None)).start()) + 1
                for c, v in zip(out, (raw.count(b"\n") + 1, len(hits), best and best[3], best and -best[0], line), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "n_lines", "n_matches", "licence", "dice", "line_no"])

    return need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, kind)
