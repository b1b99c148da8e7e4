"""License scans by conditional compression.

Lines with license vocabulary, merged over gaps of up to GAP lines, are the candidate blocks. They
only say where to look: the words around them, as far as a notice can reach, are searched too, so
notices may be wrapped in any way. Every template is compared with every candidate; one that can't have enough of its words
there is skipped, which changes nothing.

A candidate span, the words where a template may stand, is compressed alone and with the template as zstandard raw-content
dictionary. The bytes that the template saves rank all candidates; of those that save as many, the one with fewer words missing
or more comes first, then the name. In that order a candidate is confirmed by its exact wording: template and span
are aligned word by word (a longest common subsequence), at least MATCH of the template's words are there, no more words
stand between them than ``most_more`` (none for a template of under five words), and every version number of the template
is there. The words that are missing or more are returned. A notice is reported if it has a word that no notice confirmed before accounts
for; so a notice inside a longer one or a near variant of it is left out, and all others of a block are reported.

Everything is a narrow map over the texts; templates are fixed and small.

Edge cases: null and empty texts have no blocks. A block that no template explains is reported as
``unknown``. Repeated notices and repeated rows are each reported. Blocks may have any length: windows that
overlap by a whole notice go over all of it. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

GAP, MATCH, LEVEL = 2, 0.9, 3
VOCABULARY = r"(?i)licen[sc]e|copyright|warrant|redistribut|permission\W+(is|notice|to\W+use)|public\W+domain|all\W+rights\W+reserved|spdx"
_HIT = re.compile(VOCABULARY, re.ASCII)
_WORD = re.compile(r"[A-Za-z0-9.+]+")

# The wording that the licenses themselves or their stewards give.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Licensed under the BSD License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Reserved": "All rights reserved.",
    "GPL-2.0-name": "GNU General Public License v2.0",
    "GPL-3.0-name": "GNU General Public License v3.0",
    "LGPL-2.1-name": "GNU Lesser General Public License v2.1",
    "LGPL-3.0-name": "GNU Lesser General Public License v3.0",
    "AGPL-3.0-name": "GNU Affero General Public License v3.0",
    "GPL-2.0-short": "GNU General Public License v2",
    "GPL-3.0-short": "GNU General Public License v3",
    "MPL-2.0-name": "Mozilla Public License 2.0",
    "EPL-2.0-name": "Eclipse Public License 2.0",
    "MIT-name": "MIT License",
    "Apache-2.0-name": "Apache License 2.0",
    "Apache-2.0-version": "Apache License, Version 2.0",
}
#: Identifiers that follow ``SPDX-License-Identifier:``.
SPDX = ("MIT", "MIT-0", "0BSD", "Zlib", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense", "BSL-1.0", "EPL-2.0")
SPDX += tuple(f"{x}-{end}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later"))
TEMPLATES |= {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}


def placed(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words, and where each starts and ends in the text."""
    words, start, end = [], [], []
    for m in _WORD.finditer(text):
        word = m[0].rstrip(".+")
        if word:
            words.append(word.lower())
            start.append(m.start())
            end.append(m.start() + len(word))
    return words, start, end


def wording(text: str) -> list[str]:
    return placed(text)[0]


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks of a text, in characters."""
    out: list[list[int]] = []
    for m in _HIT.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = end if end >= 0 else len(text)
        if out and (start <= out[-1][1] or text.count("\n", out[-1][1], start) <= GAP + 1):
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def most_more(n: int) -> int:
    """Words that a notice of n template words has more at most."""
    return max(3, n // 4) if n >= 5 else 0


def reach(n: int) -> int:
    """Words that a notice of n template words spans at most."""
    return n + most_more(n)


def versions(words: list[str]) -> set[str]:
    """Version numbers: numbers with a point, with a ``v`` before them, or after the word ``version``."""
    return {w for before, w in zip(["", *words], words, strict=False) if w[0].isdigit() and ("." in w or before == "version") or w[0] == "v" and w[1:2].isdigit()}


class Wording:
    """A template's words, to be compared with others."""

    def __init__(self, words: list[str]):
        self.words, self.back = words, words[::-1]
        self.need = -int(-MATCH * len(words) // 1)
        self.count = Counter(words)
        self.where, self.where_back = _where(self.words), _where(self.back)
        self.more, self.versions = most_more(len(words)), versions(words)

    def possible(self, count: Counter) -> bool:
        return sum(min(n, count[w]) for w, n in self.count.items()) >= self.need

    def spans(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, words matched) of the notices, which don't overlap, in order."""
        most, tight = reach(len(self.words)), set()
        for k in range(0, max(1, len(words) - most), most):
            part = words[k : k + 2 * most]
            if not self.possible(Counter(part)):
                continue
            at = 0
            while True:  # spans with enough words that have no smaller one inside
                end = _reached(self.where, part[at:], self.need)
                if end is None:
                    break
                start = at + end - _reached(self.where_back, part[at : at + end][::-1], self.need)
                if at + end - start <= most:
                    tight.add((k + start, k + at + end))
                at = start + 1
        left, out = sorted(tight), []
        while left:
            near = [x for x in left if x[0] < left[0][1]]
            low, high = sorted({a for a, _ in near}), {b for _, b in near}
            best = None
            for a in low:
                for b, n in _lengths(self.where, words[a : max(high)], a):
                    if b in high and n >= self.need and b - a - n <= self.more and (best is None or (2 * n - (b - a), n) > best[0]) and self.versions.issubset(words[a:b]):
                        best = (2 * n - (b - a), n), a, b
            if best is None:
                left = left[1:]
                continue
            (_, n), a, b = best
            out.append((a, b, n))
            left = [x for x in left if x[0] >= b]
        return out

    def matched(self, words: list[str]) -> list[tuple[int, int]]:
        """Positions (template, words) of a longest common subsequence."""
        rows = [0]
        for w in words:
            rows.append(_next(rows[-1], self.where.get(w, 0)))
        held = lambda i, j: (rows[j] & ((1 << i) - 1)).bit_count()
        i, j, out = len(self.words), len(words), []
        while i and j:
            if held(i, j - 1) == held(i, j):
                j -= 1
            elif held(i - 1, j) == held(i, j):
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def differences(self, words: list[str]) -> tuple[list[str], list[str]]:
        """The template's words that are missing in words, and those that words has more."""
        pairs = self.matched(words)
        own, other = {i for i, _ in pairs}, {j for _, j in pairs}
        return [w for k, w in enumerate(self.words) if k not in own], [w for k, w in enumerate(words) if k not in other]


def _where(words: list[str]) -> dict[str, int]:
    where: dict[str, int] = {}
    for k, w in enumerate(words):
        where[w] = where.get(w, 0) | (1 << k)
    return where


def _next(row: int, here: int) -> int:
    m = row | here
    return m & ~(m - ((row << 1) | 1))


def _lengths(where: dict[str, int], words: list[str], at: int = 0) -> Iterator[tuple[int, int]]:
    """(end, length of the longest common subsequence up to it), counted from at."""
    row = 0
    for k, w in enumerate(words, at + 1):
        if w in where:
            row = _next(row, where[w])
        yield k, row.bit_count()


def _reached(where: dict[str, int], words: list[str], need: int) -> int | None:
    return next((k for k, n in _lengths(where, words) if n >= need), None)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    n, where = 0, _where(b)
    for _, n in _lengths(where, a):
        pass
    return n


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.words = {k: Wording(wording(v)) for k, v in templates.items()}
        self.reach = max(reach(len(w.words)) for w in self.words.values())
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}

    def _sizes(self, name: str, words: list[str]) -> tuple[int, int]:
        """Bytes of the words compressed alone, and with a template as dictionary."""
        data = " ".join(words).encode()
        return len(self.alone.compress(data)), len(self.given[name].compress(data))

    def notices(self, words: list[str], low: int, high: int) -> list[tuple[int, int, int, float, str]]:
        """(start, end, words matched, share of bytes saved, license) in words[low:high]."""
        near = words[low:high]
        count, found, claimed = Counter(near), [], set()
        for name, own in self.words.items():
            for a, b, n in own.spans(near) if own.possible(count) else ():
                alone, given = self._sizes(name, near[a:b])
                unlike = len(own.words) - n + b - a - n
                found.append(((given - alone, unlike, name, a), (low + a, low + b, n, 1 - given / alone, name)))
        out = []
        for _, x in sorted(found):
            a, b, n, _, name = x
            if common([words[p] for p in range(a, b) if p in claimed], self.words[name].words) < n:
                out.append(x)
                claimed.update(a + p for _, p in self.words[name].matched(words[a:b]))
        return sorted(out)

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, int, str, str]]:
        """(license, start, end, share of bytes saved, number of template words missing and of words more, these words)."""
        found = blocks(text)
        words, start, end = placed(text)
        inside = [(bisect_left(start, a), bisect_right(end, b)) for a, b in found]
        near: list[list[int]] = []
        for low, high in inside:
            low, high = max(0, low - self.reach), min(len(words), high + self.reach)
            if near and low <= near[-1][1]:
                near[-1][1] = high
            else:
                near.append([low, high])
        notices = [x for low, high in near for x in self.notices(words, low, high)]
        out = []
        for a, b, _, saved, name in notices:
            missing, more = self.words[name].differences(words[a:b])
            out.append((name, start[a], end[b - 1], saved, len(missing), len(more), " ".join(missing), " ".join(more)))
        touched = 0
        for (a, b), (low, high) in zip(found, inside, strict=True):
            while touched < len(notices) and notices[touched][1] <= low - self.reach:
                touched += 1
            ahead = touched
            while ahead < len(notices) and notices[ahead][0] < high and notices[ahead][1] <= low:
                ahead += 1
            if ahead == len(notices) or notices[ahead][0] >= high:
                out.append(("unknown", a, b, 0.0, 0, high - low, "", ""))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, license, start, end, saved, n_missing, n_more, missing, more) of each notice, or block without one, of each document."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            hit = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), VOCABULARY), False))
            rows = [(i, *found) for i, text in zip(hit.column("doc_id").to_pylist(), hit.column("text").to_pylist(), strict=True) for found in scanner.scan(text)]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x) if t == pa.float64() else x, t) for x, t in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "license", "start", "end", "saved", "n_missing", "n_more", "missing", "more"]
    return documents.select("doc_id", "text").mapInArrow(scanned, "doc_id long, license string, start long, end long, saved double, n_missing long, n_more long, missing string, more string")
