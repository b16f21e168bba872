"""Licence scan by sentence rules.

A text's sentences are normalised (lower case, runs of other characters than letters and digits
become a space) and looked up among the known licence sentences; what is found gives a sequence of
sentence identifiers, which is matched against licence rules: ordered sentences, at most ``GAP``
unknown sentences between two of them. A rule whose place lies within a longer match doesn't count.

A sentence ends at ``. ! ? ; :`` before white space, at a line's end, and at the text's end. A licence
sentence may run over several lines: fragments that only a line's end divides are tried together.
Licence texts are kept as running text and cut into sentences by the same code; a list's number or
letter before a sentence isn't part of it.

Matching takes time in proportion to the sentences found: a rule's next sentence is looked for only
within the gap.

Defined results: a null or empty text, and one without licence sentences, has no licences; repeated
rows are scanned each for itself; of equal sentences each is found; an empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.session import ship_package

GAP = 2
#: Texts that are taken out of an Arrow batch at once.
TOGETHER = 256
#: Sentences of public licences and notices.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "unlicense-dedicate": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-header": "Distributed under the Boost Software License, Version 1.0.",
    "epl-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-work": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "lgpl-work": "This library is licensed under the GNU Lesser General Public License.",
    "agpl-work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc0": "Dedicated to the public domain under CC0 1.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-licensed": "Licensed under the BSD 3-Clause License.",
    "mpl-licensed": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "rights-reserved": "All rights reserved.",
}
#: Licence, kind, and its sentences in order.
RULES = (
    ("MIT", "permissive", ("mit-released",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("MIT", "permissive", ("mit-this",)),
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-as-is")),
    ("Apache-2.0", "permissive", ("apache-licensed",)),
    ("Apache-2.0", "permissive", ("apache-header",)),
    ("Apache-2.0", "permissive", ("apache-header", "apache-comply", "apache-copy")),
    ("Apache-2.0", "permissive", ("apache-header", "apache-comply", "apache-copy", "apache-basis")),
    ("GPL-3.0", "copyleft", ("gpl3-work",)),
    ("GPL-3.0", "copyleft", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0", "copyleft", ("gpl-free", "gpl3-terms", "gpl-hope")),
    ("GPL-2.0", "copyleft", ("gpl2-work",)),
    ("GPL-2.0", "copyleft", ("gpl2-terms",)),
    ("GPL-2.0", "copyleft", ("gpl2-terms", "gpl-hope", "gpl-details")),
    ("GPL-2.0", "copyleft", ("gpl2-only",)),
    ("GPL-3.0", "copyleft", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-details")),
    ("GPL-3.0", "copyleft", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-details", "gpl-received")),
    ("LGPL", "copyleft", ("lgpl-free",)),
    ("LGPL", "copyleft", ("gpl-free", "lgpl3-terms")),
    ("LGPL", "copyleft", ("gpl-free", "lgpl3-terms", "gpl-hope", "lgpl-details")),
    ("AGPL-3.0", "copyleft", ("gpl-free", "agpl-terms")),
    ("AGPL-3.0", "copyleft", ("gpl-free", "agpl-terms", "gpl-hope", "agpl-details")),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("Apache-2.0", "permissive", ("apache-header", "apache-comply", "apache-copy", "apache-basis", "apache-limits")),
    ("BSD-2-Clause", "permissive", ("bsd-use", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable")),
    ("BSD-3-Clause", "permissive", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liable")),
    ("MPL-2.0", "copyleft", ("mpl-licensed", "mpl-obtain")),
    ("ISC", "permissive", ("isc-grant", "isc-as-is")),
    ("Unlicense", "public-domain", ("unlicense", "unlicense-anyone", "unlicense-dedicate")),
    ("Zlib", "permissive", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", "permissive", ("boost-grant",)),
    ("BSL-1.0", "permissive", ("boost-header",)),
    ("EPL-2.0", "copyleft", ("epl-header",)),
    ("WTFPL", "public-domain", ("wtfpl",)),
    ("Artistic-2.0", "permissive", ("artistic",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", "no-derivatives", ("cc-by-nd-work",)),
    ("CC-BY-NC-SA-4.0", "noncommercial", ("cc-by-nc-sa",)),
    ("CC-BY-NC-SA-4.0", "noncommercial", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-ND-4.0", "noncommercial", ("cc-by-nc-nd",)),
    ("CC-BY-NC-ND-4.0", "noncommercial", ("cc-by-nc-nd-work",)),
    ("CC0-1.0", "public-domain", ("cc0-work",)),
    ("LGPL", "copyleft", ("lgpl-work",)),
    ("AGPL-3.0", "copyleft", ("agpl-work",)),
    ("CC-BY-4.0", "permissive", ("cc-by",)),
    ("CC-BY-4.0", "permissive", ("cc-by-work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", "no-derivatives", ("cc-by-nd",)),
    ("CC0-1.0", "public-domain", ("cc0",)),
    ("BSD-2-Clause", "permissive", ("bsd-use", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", "permissive", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", "permissive", ("bsd-licensed",)),
    ("MPL-2.0", "copyleft", ("mpl-licensed",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("Unlicense", "public-domain", ("unlicense",)),
    ("proprietary", "restricted", ("rights-reserved",)),
)

#: The rules by their first sentence.
BY_FIRST: dict[str, list] = {}
for _rule in RULES:
    BY_FIRST.setdefault(_rule[2][0], []).append(_rule)

OTHER = re.compile(r"[\W_]+")
BOUND = re.compile(r"[.!?;:]+(?=\s|$)|\n")
#: A list's number or letter, or a comment's mark, before a sentence.
LABEL = re.compile(r"\s*(?:(?:\(?[0-9a-z]{1,2}[.)]|[-*#/]+)\s+)*")


def normalise(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


#: Normalised sentence -> identifier; one with bounds within is known as a whole.
KNOWN = {normalise(s): name for name, s in SENTENCES.items()}
STARTS = sorted(KNOWN)
FIRST = {s.split(" ", 1)[0] for s in STARTS}
LONGEST = max(map(len, STARTS))


def _begins(part: str) -> bool:
    """Whether a known sentence begins with these words."""
    at = bisect_left(STARTS, part)
    return at < len(STARTS) and STARTS[at].startswith(part)


def sentences(text: str) -> list[tuple[str, int, int, int]]:
    """The known sentences of a text, in order: identifier, number of the sentence, start and end."""
    parts, at = [], 0
    for m in BOUND.finditer(text):
        # "a." or "1)" at a line's begin is a label, not a sentence
        if text[m.start()] != "\n" and len(text[at : m.end()].strip()) <= 3 and text[at : m.end()].strip(" \t(")[:2].rstrip(".)").isalnum() and not text[at : m.start()].strip().count(" "):
            continue
        parts.append((at, m.end()))
        at = m.end()
    parts.append((at, len(text)))
    found, k, number = [], 0, 0
    while k < len(parts):
        whole, best, j = "", None, k
        start = LABEL.match(text, parts[k][0], parts[k][1]).end()
        while j < len(parts):
            begin = start if j == k else LABEL.match(text, parts[j][0], parts[j][1]).end()
            piece = normalise(text[begin : parts[j][1]])
            whole = f"{whole} {piece}" if whole and piece else whole or piece
            if not whole or whole.split(" ", 1)[0] not in FIRST or len(whole) > LONGEST or not _begins(whole):
                break
            if whole in KNOWN:
                best = (KNOWN[whole], j)
            j += 1
        if best:
            found.append((best[0], number, start, parts[best[1]][1]))
            k = best[1] + 1
        else:
            k += 1
        number += best is not None or bool(text[parts[k - 1][0] : parts[k - 1][1]].strip())
    return found


def match(found: list[tuple[str, int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(licence, kind, start, end) of the rules that the sentences fulfil, longest first where they overlap,
    of equally long ones that of more sentences."""
    hits = []
    for i, (name, *_) in enumerate(found):
        for licence, kind, rule in BY_FIRST.get(name, ()):
            j, steps = i, 1
            while steps < len(rule):
                k = j + 1
                while k < len(found) and found[k][1] - found[j][1] <= GAP + 1 and found[k][0] != rule[steps]:
                    k += 1
                if k == len(found) or found[k][1] - found[j][1] > GAP + 1:
                    break
                j, steps = k, steps + 1
            if steps == len(rule):
                hits.append((-(j - i), -len(rule), i, j, licence, kind))
    taken, out = set(), []
    for *_, i, j, licence, kind in sorted(hits):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((licence, kind, found[i][2], found[j][3]))
    return sorted(out, key=lambda x: x[2])


def _scan(batches):
    kind = pa.list_(pa.struct([("licence", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans, count = [], []
        for t in (t for at in range(0, batch.num_rows, TOGETHER) for t in batch.column(1).slice(at, TOGETHER).to_pylist()):
            found = sentences(t or "")
            count.append(len(found))
            spans.append([dict(zip(("licence", "kind", "start", "end"), x, strict=True)) for x in match(found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_sentences", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), licenses (names in order, comma-separated), kinds, spans."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scan, "doc_id long, n_sentences long, spans array<struct<licence: string, kind: string, start: long, end: long>>")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"spans.{c}"))), ",")
    return out.select("doc_id", "n_sentences", names("licence").alias("licenses"), names("kind").alias("kinds"), "spans")
