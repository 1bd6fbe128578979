"""Licence scan by sentence rules.

Sentences are normalised to their words (lower case; line breaks, comment marks and
punctuation between words don't count) and mapped to identifiers of known licence
sentences, which may be clauses that end at a colon. The identifiers of a document, in
order, are matched against licence rules: ordered lists of identifiers, in which up to GAP
other sentences may stand between two of a rule's. Longer rules go first and matches don't
overlap, so a licence's short notice inside its whole text isn't reported twice. What a
text must hold to be searched at all is derived from the rules that are given.

Edge cases: null and empty texts have no sentence; repeated notices are reported each;
the scan reads whole texts; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 2
LONG = 8  # words from which a known sentence is known inside another too (as where a text has lost its lines)

# Sentences of public licences and notices.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_MIT_LIABILITY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_CLAUSES = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = [
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_GPL = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

# Licence rules. A rule is the ordered list of sentences that must occur.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0."]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."]),
    ("MIT", ["Released under the MIT License."]),
    ("MIT", ["Licensed under the MIT License."]),
    ("MIT", ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]),
    ("GPL-3.0", ["This work is licensed under the GNU General Public License, version 3."]),
    ("GPL-3.0-or-later", ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]),
    ("GPL-2.0-or-later", ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]),
    ("LGPL-2.1-or-later", ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0."]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0."]),
    ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    ("CC-BY-SA-4.0", ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    ("CC-BY-NC-4.0", ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
    ("BSD-2-Clause", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]),
    ("BSD-3-Clause", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]),
    ("ISC", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain."]),
    ("Proprietary", ["All rights reserved."]),
    ("MIT", [_MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY, _MIT_LIABILITY]),
    ("BSD-2-Clause", [*_BSD_CLAUSES, *_BSD_DISCLAIMER]),
    ("BSD-3-Clause", [*_BSD_CLAUSES, _BSD_NAME, *_BSD_DISCLAIMER]),
    ("ISC", [_ISC_GRANT, "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."]),
    ("Zlib", ["This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
    ("BSL-1.0", ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"]),
    ("BSL-1.0", ["Distributed under the Boost Software License, Version 1.0."]),
    ("GPL-2.0-or-later", [_GPL.format(what="program", sep=";", name="GNU General Public License", version="2"), _WARRANTY.format(what="program", name="GNU General Public License")]),
    ("GPL-3.0-or-later", [_GPL.format(what="program", sep=":", name="GNU General Public License", version="3"), _WARRANTY.format(what="program", name="GNU General Public License")]),
    ("AGPL-3.0-or-later", [_GPL.format(what="program", sep=":", name="GNU Affero General Public License", version="3")]),
    ("LGPL-2.1-or-later", [_GPL.format(what="library", sep=";", name="GNU Lesser General Public License", version="2.1"), _WARRANTY.format(what="library", name="GNU Lesser General Public License")]),
    ("LGPL-3.0-or-later", [_GPL.format(what="library", sep=":", name="GNU Lesser General Public License", version="3")]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    ("CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
]

# A sentence may begin or end at . ! ? : ; or a line break, and at the ends of the text. Whole sentences, which are
# counted between those of a rule, end at . ! or ? before white space (not after "v.") or at an empty line.
_WORD = re.compile(r"[A-Za-z0-9]+")
_EDGE = re.compile(r"[.!?:;\n\r\x0b\x0c]")
_STOP = re.compile(r"(?<!\bv)[.!?](?=[\x20\x09-\x0D])")
_WHOLE = re.compile(r"(?<!\bv)[.!?](?=[\x20\x09-\x0D]|$)|\n[\x20\x09]*\r?\n")


def normalise(sentence: str) -> tuple[str, ...]:
    """The words of a sentence: runs of ASCII letters and digits, in lower case."""
    return tuple(w.lower() for w in _WORD.findall(sentence))


class Rulebook:
    """Known sentences with identifiers, and rules as identifier lists, longest first."""

    def __init__(self, rules: list[tuple[str, list[str]]]):
        self.known: dict[tuple[str, ...], int] = {}
        self.rules: dict[int, list[tuple[str, list[int]]]] = {}
        for name, parts in rules:
            ids = [self.known.setdefault(n, len(self.known)) for p in parts if (n := normalise(p))]
            if ids:
                self.rules.setdefault(ids[0], []).append((name, ids))
        for own in self.rules.values():
            own.sort(key=lambda r: (-len(r[1]), r[0]))
        #: Known sentences by their first word, longest first.
        self.first: dict[str, list[tuple[str, ...]]] = {}
        for k in sorted(self.known, key=len, reverse=True):
            self.first.setdefault(k[0], []).append(k)
        # A word of each known sentence: texts without these words hold none.
        self.marks = {max(k, key=len) for k in self.known}

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(identifier, start, end, number of whole sentences before the start, before the end) of the known sentences, the longest at each place."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        ends = [m.end() for m in _WHOLE.finditer(text)]
        stops = [m.start() for m in _STOP.finditer(text)]
        out, at = [], 0
        while at < len(words):
            best = None
            edge = lambda i: i in (0, len(words)) or _EDGE.search(text, spans[i - 1][1], spans[i][0])
            for known in self.first.get(words[at], ()):
                stop = at + len(known)
                if tuple(words[at:stop]) != known or bisect_left(stops, spans[at][0]) != bisect_left(stops, spans[stop - 1][0]):
                    continue  # other words, or a sentence ends within
                if len(known) >= LONG or edge(at) and edge(stop):
                    best = known
                    break
            if best is None:
                at += 1
                continue
            stop = at + len(best)
            end = _EDGE.match(text, spans[stop - 1][1])
            end = end.end() if end and end[0] in ".!?:;" else spans[stop - 1][1]
            out.append((self.known[best], spans[at][0], end, bisect_left(ends, spans[at][0] + 1), bisect_left(ends, spans[stop - 1][1])))
            at = stop
        return out

    def match(self, found: list[tuple[int, int, int, int, int]]) -> list[tuple[str, int, int]]:
        """(licence, start, end) of the rules whose sentences follow one another, with at most GAP other whole sentences between two."""
        out, k = [], 0
        while k < len(found):
            done = None
            for name, ids in self.rules.get(found[k][0], []):
                at = k
                for want in ids[1:]:
                    near = (j for j in range(at + 1, len(found)) if found[j][0] == want)
                    at = next((j for j in near if found[j][3] - found[at][4] <= GAP + 1), None)
                    if at is None:
                        break
                if at is not None:
                    done = at
                    out.append((name, found[k][1], found[at][2]))
                    break
            k = k + 1 if done is None else done + 1
        return out


def scan_text(book: Rulebook, text: str | None) -> tuple[int, list[tuple[str, int, int]]]:
    """Number of known sentences and the matches of one text."""
    low = text.lower() if text else ""
    if not any(w in low for w in book.marks):
        return 0, []
    found = book.find(text)
    return len(found), book.match(found)


def scan(docs: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), licences (sorted, distinct), spans (licence:start:end in code points)."""
    rules = RULES if rules is None else rules

    def run(batches):
        book = Rulebook(rules)
        for batch in batches:
            n, names, spans = [], [], []
            for text in batch.column("text"):
                known, matches = scan_text(book, text.as_py())
                n.append(known)
                names.append(sorted({m[0] for m in matches}))
                spans.append([f"{a}:{b}:{c}" for a, b, c in matches])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.string()))], names=["doc_id", "n_sentences", "licences", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_sentences long, licences array<string>, spans array<string>")
