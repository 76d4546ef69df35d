"""License scans: the Dice coefficient of word bigrams between parts of a text and licence templates."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import map_texts

#: Short notices and the openings of the public licence texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "BSD-3-Clause": (
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
#: Compared with windows of words only: what TEMPLATES lacks. Of long licences, passages that no other licence has, by which their full texts are found.
FULLER: dict[str, tuple[str, ...]] = {
    "MIT": (
        "This code is licensed under the MIT License.",
        TEMPLATES["MIT"][2] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD-2-Clause": (
        "Distributed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "Apache-2.0": ("Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",),
    "GPL-3.0": ("The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",),
    "GPL-2.0": ("This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.",),
    "ISC": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "MPL-2.0": ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: (a) under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work",),
    "CC-BY-4.0": ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-SA-4.0": ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC-BY-NC-4.0": ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").'),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
#: The opening that all BSD licences share tells none of them in a longer text.
_SHARED = TEMPLATES["BSD-3-Clause"][1]
LEAST = 0.8
_WORD = re.compile(r"[a-z0-9]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return set(zip(words, words[1:], strict=False))


class Scanner:
    """Templates by size: only those that could reach the coefficient at a part's size are compared with it."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float) -> None:
        known = sorted(((len(b), name, b, len(_WORD.findall(t.lower()))) for name, texts in templates.items() for t in texts if (b := bigrams(t))), key=lambda x: (x[0], x[1]))
        self.sizes, self.known, self.least = [x[0] for x in known], known, least
        self.words = {w for _, _, b, _ in known for pair in b for w in pair}
        self.lengths, self.where = [x[3] for x in known], {}
        for k, (_, _, b, _) in enumerate(known):
            for pair in b:
                self.where.setdefault(pair, []).append(k)
        self.known = [x[:3] for x in known]

    def _allowed(self, size: int) -> list:
        # 2 min / (a + b) >= t holds for b from a t / (2 - t) to a (2 - t) / t.
        r = self.least / (2 - self.least)
        return self.known[bisect.bisect_left(self.sizes, size * r - 1e-9) : bisect.bisect_right(self.sizes, size / r + 1e-9)]

    def scan(self, text: str) -> dict[str, tuple[float, str]]:
        """For each licence found its largest coefficient and the smallest kind of part (line, paragraph, text) that has it."""
        best: dict[str, tuple[float, str]] = {}
        for kind, part in self._parts(text):
            words = _WORD.findall(part.lower())
            if len(words) < 2 or self.words.isdisjoint(words):
                continue
            own = set(zip(words, words[1:], strict=False))
            for n, name, theirs in self._allowed(len(own)):
                dice = 2 * len(own & theirs) / (len(own) + n)
                if dice >= self.least and (name not in best or dice > best[name][0]):
                    best[name] = (dice, kind)
        return best

    def windows(self, text: str, but: dict) -> dict[str, tuple[float, str]]:
        """For each licence that is not in `but` and that a window of words reaches, its largest coefficient.

        A window begins with a bigram of the template and has as many words as the template or more, up to the size bound;
        near the end of the text it is the last words of it.
        """
        words = _WORD.findall(text.lower())
        if len(words) < 2 or self.words.isdisjoint(words):
            return {}
        pairs = list(zip(words, words[1:], strict=False))
        shared = self.where.keys() & set(pairs)
        held: dict[int, int] = {}
        for p in shared:
            for k in self.where[p]:
                held[k] = held.get(k, 0) + 1
        r = self.least / (2 - self.least)
        best: dict[str, tuple[float, str]] = {}
        # Of a template with b bigrams, a window that reaches the coefficient holds b r at least.
        for k in sorted(k for k, c in held.items() if c >= self.known[k][0] * r - 1e-9 and self.known[k][1] not in but):
            n, name, theirs = self.known[k]
            dice = self._window(pairs, theirs, self.lengths[k] - 1, n / r + 1e-9)
            if dice >= self.least and (name not in best or dice > best[name][0]):
                best[name] = (dice, "window")
        return best

    @staticmethod
    def _window(pairs: list[tuple[str, str]], theirs: set, length: int, most: float) -> float:
        """The largest coefficient of the windows of pairs, of `length` pairs or more."""
        best, n, last, done = 0.0, len(theirs), max(0, len(pairs) - length), -1
        for s, p in enumerate(pairs):
            if p not in theirs or min(s, last) == done:
                continue
            done = s = min(s, last)
            own: set = set()
            both = 0
            for e in range(s, len(pairs)):
                q = pairs[e]
                if q not in own:
                    own.add(q)
                    both += q in theirs
                    if len(own) > most:
                        break
                elif q == pairs[s] and e - s >= length:
                    break  # a later start has the same without the first
                if e - s + 1 >= min(length, len(pairs)):
                    best = max(best, 2 * both / (len(own) + n))
                    if both == n:
                        break
            if best == 1.0:
                break
        return best

    @staticmethod
    def _parts(text: str) -> Iterator[tuple[str, str]]:
        lines = text.split("\n")
        for line in lines:
            yield "line", line
        paragraphs = _PARAGRAPH.split(text)
        if len(lines) > 1:
            for p in paragraphs:
                yield "paragraph", p
        if len(paragraphs) > 1:
            yield "text", text


def with_fuller() -> dict[str, tuple[str, ...]]:
    """The templates that windows are compared with."""
    return {k: tuple(t for t in (*TEMPLATES.get(k, ()), *FULLER.get(k, ())) if t != _SHARED) for k in TEMPLATES | FULLER}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST, windows: bool = False) -> DataFrame:
    """One row for each document and licence that its text names: doc_id, license, dice, part.

    Parts are the whole text, its paragraphs (between blank lines) and its lines. Of each, the distinct word bigrams (runs of a-z and
    0-9, lower-cased) are compared with each template of a size that can reach `least`; dice is the largest coefficient of the licence's
    templates, part the smallest kind that has it. Null and empty texts, and parts of one word, match nothing. Repeated rows give
    repeated rows, null ids stay. Other columns aren't read.

    With windows, licences that no part reaches are looked for in windows of words over the whole text, across lines and paragraphs
    (Scanner.windows), with the templates of FULLER besides; their part is 'window'.
    """
    kind = dict(docs.dtypes)[id_col]
    use = TEMPLATES if templates is None else templates
    wide = {} if not windows else with_fuller() if templates is None else templates

    def run(scanners, cols, texts):
        scanner, wider = scanners
        out: dict[str, list] = {k: [] for k in ("doc_id", "license", "dice", "part")}
        for doc, t in zip(cols["doc_id"], texts, strict=True):
            found = scanner.scan(t)
            if windows:
                found |= wider.windows(t, found)
            for name, (dice, part) in sorted(found.items()):
                for k, v in zip(out, (doc, name, dice, part), strict=True):
                    out[k].append(v)
        return out

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, license string, dice double, part string", lambda: (Scanner(use, least), Scanner(wide, least)))


def sql(least: float = LEAST) -> str:
    """The same over the table documents in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {k}, {quoted(t)})" for name, texts in TEMPLATES.items() for k, t in enumerate(texts))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates AS (SELECT license, k, {grams} AS g FROM (SELECT license, k, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM (VALUES {rows}) v(license, k, t))),
parts AS (
  SELECT doc_id, 1 AS rank, unnest(string_split(text, chr(10))) AS p FROM documents
  UNION ALL SELECT doc_id, 2, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents WHERE text LIKE '%' || chr(10) || '%'
  UNION ALL SELECT doc_id, 3, text FROM documents WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')),
grams AS (SELECT doc_id, rank, {grams} AS g FROM (SELECT doc_id, rank, regexp_extract_all(lower(p), '[a-z0-9]+') AS w FROM parts) WHERE len(w) > 1),
scored AS (
  SELECT doc_id, license, rank, 2 * len(list_intersect(grams.g, templates.g)) / (len(grams.g) + len(templates.g)) AS dice
  FROM grams JOIN templates ON 2 * least(len(grams.g), len(templates.g)) >= {least} * (len(grams.g) + len(templates.g)))
SELECT doc_id, license, max(dice) AS dice, CASE arg_max(rank, (dice, -rank)) WHEN 1 THEN 'line' WHEN 2 THEN 'paragraph' ELSE 'text' END AS part
FROM scored WHERE dice >= {least} GROUP BY doc_id, license"""


def counted(found: DataFrame) -> DataFrame:
    """How many documents name each licence."""
    return found.groupBy("license").agg(F.countDistinct("doc_id").alias("documents"))
