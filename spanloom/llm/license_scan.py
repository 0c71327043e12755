"""License scans by conditional compression.

Candidate blocks are stretches of a document, of a template's length and some more, that hold many of the template's
pairs of neighbouring words, wherever its lines break. A block is compressed plainly and with the template as a raw
zstandard dictionary; the bytes saved, against the template's own compressed size, must be more than noise. Then the exact
wording decides: the template is aligned with the block at the least cost of words that the block lacks and words that it
has besides, and the words that tell a licence from its neighbours (version, NC, SA, ND) must be there as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

# Wording of public licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-line": "Distributed under the BSD License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-1.1-line": "Licensed under the Apache License, Version 1.1.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-short-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short-line": "Licensed under CC BY-NC-ND 4.0.",
    "Proprietary-line": "All rights reserved. No part of this work may be reproduced without permission.",
    "Proprietary-short-line": "All rights reserved.",
}
#: Whole texts, without the lines that differ from copy to copy (holder, year).
_MIT_GRANT = TEMPLATES["MIT"]
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies"
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_NO_CLAIM = "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEMPLATES |= {
    "MIT-full": f"{_MIT_GRANT} {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES {_NO_CLAIM}",
    "BSD-2-Clause-full": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "BSD-3-Clause-full": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "ISC-full": f"{_ISC_GRANT}, {_ISC_NOTICE}. {_ISC_DISCLAIMER}",
    "0BSD-full": f"{_ISC_GRANT}. {_ISC_DISCLAIMER}",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-full": f"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-full": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES {_NO_CLAIM}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: What tells a licence from its neighbours, as it must stand in the words of a block (joined by blanks).
DECIDING: dict[str, str] = {
    "Apache-2.0": r"apache license (?:version )?2\.0",
    "Apache-1.1": r"apache license (?:version )?1\.1",
    "MIT": r"mit license|deal in the \S+ without restriction",
    "BSD": r"bsd license",
    "BSD-3-Clause-full": r"endorse or promote products derived",
    "ISC": r"appear in all copies",
    "MPL-2.0": r"mozilla public license (?:version |v )?2\.0",
    "LGPL-2.1": r"gnu lesser general public license as published by (?:\S+ ){0,6}either version 2\.1",
    "GPL-3.0": r"gnu general public license (?:version |v)?3(?:\.0)?|gnu general public license as published by (?:\S+ ){0,6}either version 3(?:\.0)?",
    "GPL-2.0": r"gnu general public license (?:version |v)?2(?:\.0)?|gnu general public license as published by (?:\S+ ){0,6}either version 2(?:\.0)?",
    "LGPL-3.0": r"gnu lesser general public license (?:version |v)?3(?:\.0)?",
    "AGPL-3.0": r"gnu affero general public license (?:version |v)?3(?:\.0)?|gnu affero general public license as published by (?:\S+ ){0,6}either version 3(?:\.0)?",
    "CC-BY-4.0": r"(?:cc by|attribution) 4\.0",
    "CC-BY-NC-4.0": r"(?:by-nc|attribution-noncommercial) 4\.0",
    "CC-BY-SA-4.0": r"(?:by-sa|attribution-sharealike) 4\.0",
    "CC-BY-ND-4.0": r"(?:by-nd|attribution-noderivatives) 4\.0",
    "CC-BY-NC-SA-4.0": r"(?:by-nc-sa|attribution-noncommercial-sharealike) 4\.0",
    "CC-BY-NC-ND-4.0": r"(?:by-nc-nd|attribution-noncommercial-noderivatives) 4\.0",
    "Proprietary": r"all rights reserved",
}
_word = re.compile(r"\w+(?:[.+-]+\w+)*")
#: Share of a template's compressed bytes that it must save, and of its words that must be there.
LEAST_SAVED, LEAST_WORDS = 0.3, 0.85
#: Cost of a template's word that is missing, in words added.
MISS = 4


def wording(text: str) -> list[str]:
    return _word.findall(text.lower())


def align(block: list[str], template: list[str]) -> tuple[int, int, int, int]:
    """(missing, added, first, end): the alignment in order of least MISS * missing + added, and its words block[first:end].

    Words of the block before the first and after the last one found cost nothing.
    """
    width = len(block)
    ids = {w: i for i, w in enumerate(dict.fromkeys(block))}
    words = np.array([ids[w] for w in block], np.int64)
    unit = width + 1  # a cost, and below it how far from the block's end the alignment begins
    step = np.arange(unit) * unit
    state = np.arange(width, -1, -1, dtype=np.int64)
    for word in template:
        above = state + MISS * unit
        if word in ids:
            above[1:] = np.where(words == ids[word], np.minimum(above[1:], state[:-1]), above[1:])
        state = np.minimum.accumulate(above - step) + step
    cost = state // unit
    end = int(cost.argmin())
    first = width - int(state[end] % unit)
    missing = (int(cost[end]) + len(template) - (end - first)) // (MISS + 1)
    return missing, end - first - len(template) + missing, first, end


def license_of(template: str) -> str:
    return template.removesuffix("-line").removesuffix("-long").removesuffix("-short").removesuffix("-full")


class Scanner:
    """Compressors for the templates, one plain and one for each template as a raw dictionary, and their word pairs."""

    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard

        self.names, self.words = [license_of(t) for t in templates], [wording(t) for t in templates.values()]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.frame = len(self.plain.compress(b""))
        made = [zstandard.ZstdCompressionDict(" ".join(w).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for w in self.words]
        self.conditional = [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False) for d in made]
        self.own = [len(self.plain.compress(" ".join(w).encode())) - self.frame for w in self.words]
        rules = [DECIDING.get(t, DECIDING.get(x)) for t, x in zip(templates, self.names, strict=True)]
        self.deciding = [re.compile(rf"(?:^| )(?:{r})(?: |$)") if r else None for r in rules]
        self.pairs: dict[tuple[str, ...], dict[int, list[int]]] = {}
        self.single = any(len(w) == 1 for w in self.words)
        self.needed = []
        for k, w in enumerate(self.words):
            for b in range(max(1, len(w) - 1)):
                self.pairs.setdefault(tuple(w[b : b + 2]), {}).setdefault(k, []).append(b)
            self.needed.append(max(1, (len(w) - 1 - 2 * int((1 - LEAST_WORDS) * len(w))) // 2))
        self.seen: dict[tuple[int, tuple[str, ...]], tuple | None] = {}

    def confirm(self, k: int, block: list[str]) -> tuple[float, int, int, int, int] | None:
        """(saved, missing, added, first, end) of template ``k`` in a block, if its wording is there."""
        key = k, tuple(block)
        if key not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            data = " ".join(block).encode()
            saved = (len(self.plain.compress(data)) - len(self.conditional[k].compress(data))) / max(1, self.own[k])
            self.seen[key] = None
            if saved >= LEAST_SAVED:
                missing, added, first, end = align(block, self.words[k])
                rule = self.deciding[k]
                if missing <= (1 - LEAST_WORDS) * len(self.words[k]) and (rule is None or rule.search(" ".join(block[first:end]))):
                    self.seen[key] = saved, missing, added, first, end
        return self.seen[key]

    def match(self, words: list[str]) -> list[tuple[int, int, str, float, int, int]]:
        """(first, end, license, saved, missing words, added words) of each licence; of overlapping ones the longest."""
        hits: dict[int, list[tuple[int, list[int]]]] = {}  # a place counts once, however often its pair stands in the template
        known = self.pairs
        for i, pair in enumerate(zip(words, words[1:])):
            if pair in known:
                for k, spots in known[pair].items():
                    hits.setdefault(k, []).append((i, spots))
        for i in range(len(words)) if self.single else ():
            for k, spots in known.get((words[i],), {}).items():
                hits.setdefault(k, []).append((i, spots))
        found: list[tuple[int, int, int, tuple]] = []
        for k, own in hits.items():
            n = len(self.words[k])
            slack = n // 2 + 4
            s = e = 0
            while s < len(own):
                at = own[s][0]
                e = max(e, s)
                while e < len(own) and own[e][0] < at + n + slack:
                    e += 1
                after = at + 1
                if e - s >= self.needed[k] and len({b for _, spots in own[s:e] for b in spots}) >= self.needed[k]:
                    low, high = max(0, at - slack), at + n + 2 * slack
                    after = at + max(1, n // 4)
                    while high > low and (hit := self.confirm(k, words[low:high])):
                        high = low + hit[3]  # a worse copy may stand before it
                        spots = [(low, hit)]
                        if hit[1]:  # the block may end within the wording: once more around what was found
                            back = max(0, high - slack)
                            again = self.confirm(k, words[back : high + n + 2 * slack])
                            spots += [(back, again)] if again else []
                        for base, (saved, missing, added, first, end) in spots:
                            found.append((missing - n, base + first, base + end, (self.names[k], saved, missing, added)))
                        after = max(after, low + hit[4])
                while s < len(own) and own[s][0] < after:
                    s += 1
        out: list[tuple] = []
        for _, first, end, what in sorted(found):
            if all(end <= a or first >= b for a, b, *_ in out):
                out.append((first, end, *what))
        return sorted(x for x in out if not self._heading(words, x, out))

    @staticmethod
    def _heading(words: list[str], one: tuple, every: list[tuple]) -> bool:
        """'All rights reserved' after a copyright notice, with another licence right below: part of that one's heading."""
        first, end, name = one[:3]
        return name == "Proprietary" and end - first == 3 and "copyright" in words[max(0, first - 16) : first] and any(end <= a < end + 8 and x != name for a, _, x, *_ in every)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence found: doc_id, start, stop (code points of the lines with its wording), license, saved,
    missing, added.

    Null and empty texts have none; repeated rows give repeated results; null ids stay null; of overlapping wordings that
    match equally well the first stands; other columns are ignored, whatever their names; an empty table gives an empty
    result. Very long texts are read whole, in one task. No shuffle: a document is read where it lies.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out: list[tuple] = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                words = list(_word.finditer(text))
                for first, end, *h in scanner.match([w.group().lower() for w in words]):
                    stop = text.find("\n", words[end - 1].end())
                    out.append((doc, text.rfind("\n", 0, words[first].start()) + 1, len(text) if stop < 0 else stop, *h))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "stop", "license", "saved", "missing", "added"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, stop long, license string, saved double, missing long, added long")
