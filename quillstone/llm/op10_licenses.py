"""Licence scans by conditional compression.

Stretches of a text around words that licences need are candidate blocks: a notice that holds ``SHARE`` of a template's words can't lack
all of a set that makes up more than the rest, so the words of such sets, chosen by rule, find every block. Templates of whose words a block
holds enough are aligned with it word by word; what is missing or other is kept as the exact differences. The stretch that a template confirms is compressed
alone and with the template as a raw dictionary, and the template whose dictionary saves most bytes, less a quarter of those it leaves, is the block's licence: a long text with words
put into it goes before a short notice that stands in it unchanged, as its dictionary explains more, and a notice with a stray word before it after the same one without. A stretch may hold as many further words as the template has, where that has forty or more.

All rows pass through one map over the table, with the templates as a fixed list.

Defined results: null and empty texts have no blocks; texts of any length are searched whole, block by block; of templates that come out equal
the first by name stands; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the BSD licences share, and public licence notices and whole texts by SPDX name.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", _BSD + " " + _BSD_END],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 3-Clause License.",
        _BSD + _BSD_THIRD + _BSD_END,
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public Licence (EUPL), Version 1.2."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
}
#: Every licence that has an SPDX name is named by a line of source files too.
for _license, _texts in TEMPLATES.items():
    if _license != "Proprietary":
        _texts.append(f"SPDX-License-Identifier: {_license}")
WORD = re.compile(r"non[\s-]commercial\b|no[\s-]deriv(?:ative)?s\b|share[\s-]alike\b|[a-z0-9]+(?:\.[0-9]+)*")
#: Words that licences are named by; a name is a run of them from one of ``NAMES`` on.
NAMES = "apache boost bsd cc cc0 creative eupl european gnu mit mozilla".split()
NAMED = {*NAMES, *"1.0 2 2.0 3 4.0 affero attribution by clause commons eupl general international lesser license nc nd noncommercial noderivatives public sa sharealike v version".split()}
#: Words that tell licences apart wherever they stand.
TELLING = re.compile(r"[0-9]|^(?:nc|nd|sa|by|mit|bsd|gnu|lesser|library|affero|apache|mozilla|eupl|noncommercial|noderivatives|sharealike|modified)$")
#: Words that a name may have or lack, besides those of ``_plain``.
LOOSE = {"a", "an", "the", "v", "version", "license", "international", "software", "agpl", "gpl", "lgpl", "mpl"}
#: The share of a template's words that a notice must hold.
SHARE = 0.8
#: Words that speak of licences and of little else, the first choice for finding blocks (fixed values).
CUES = [*NAMES, *"affero agpl commons copyright licence license licensed licenses merchantability mpl noninfringement permission redistribution redistributions reserved software sublicense unencumbered warranties warranty".split()]


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of each word in small letters; the parts of 'Non-Commercial' and the like are one word."""
    return [(re.sub(r"[\s-]", "", m.group()), m.start(), m.end()) for m in WORD.finditer(text.lower())]


@lru_cache(maxsize=1)
def _compressors():
    import zstandard as z

    plain = z.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
    out = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            raw = t.lower().encode()
            dictionary = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            words = [w for w, _, _ in words_of(t)]
            out.append((name, Counter(words), words, z.ZstdCompressor(level=9, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return plain, out


@lru_cache(maxsize=4)
def _cues(share: float) -> tuple[re.Pattern, int]:
    """(words one of which every confirmed notice holds, the most characters that a notice may lie before or behind it)."""
    chosen: set[str] = set()
    for texts in TEMPLATES.values():
        for t in texts:
            count = Counter(w for w, _, _ in words_of(t))
            # A notice may lack what is over its share: the words taken here make up more than that.
            lacking = count.total() - int(-(-share * count.total() // 1))
            for w in sorted(count, key=lambda w: (w not in CUES, -len(w), w)):
                if lacking < 0:
                    break
                chosen.add(w)
                lacking -= count[w]
    longest = max(len(t) for texts in TEMPLATES.values() for t in texts)
    # Words that ``words_of`` joins are looked for with a space or dash in them too.
    spelt = "|".join(sorted(r"non[\s-]?commercial" if w == "noncommercial" else r"no[\s-]?derivatives" if w == "noderivatives" else r"share[\s-]?alike" if w == "sharealike" else re.escape(w) for w in chosen))
    return re.compile(rf"(?<![a-z0-9])(?:{spelt})(?![a-z0-9])", re.I), longest + longest // 4


def blocks(text: str, share: float = SHARE) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks: around cues, joined where they touch, of the whole text; long runs of cues give blocks that overlap."""
    cue, around = _cues(share)
    out: list[list[int]] = []
    for m in cue.finditer(text):
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        if out and a <= out[-1][1] and b - out[-1][0] < 4 * around:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def candidates(block: str, share: float) -> list[tuple]:
    """(name, bag of words, words, compressor) of the templates whose words ``block`` holds to ``share``.

    An alignment can have no more words in common than the two bags, so no template is left out that could be confirmed.
    """
    have = Counter(w for w, _, _ in words_of(block))
    return [k for k in _compressors()[1] if sum(min(n, have[w]) for w, n in k[1].items()) >= share * len(k[2])]


def saving(stretch: str, compressor) -> tuple[int, int]:
    """How many bytes of a stretch a template's dictionary saves, and how many it leaves."""
    raw = stretch.lower().encode()
    left = len(compressor.compress(raw))
    return len(_compressors()[0].compress(raw)) - left, left


def _plain(words: list[str]) -> str:
    """``words`` without what doesn't tell licences apart: spelling and ``LOOSE`` words."""
    same = {"licence": "license", "noderivs": "noderivatives"}
    words = [same.get(re.sub(r"^v(?=[0-9])", "", w), re.sub(r"^v(?=[0-9])", "", w)) for w in words]
    return "".join(w for w in words if w not in LOOSE)


def _name(words: list[str]) -> tuple[int, int]:
    """(first, behind the last) of the words of a template that name its licence; (0, 0) where none do."""
    first = next((k for k, w in enumerate(words) if w in NAMES), None)
    if first is None:
        return 0, 0
    return first, next((k for k in range(first, len(words)) if words[k] not in NAMED), len(words))


def _tells(changes: list[tuple], words: list[str], behind: str) -> bool:
    """Whether ``changes`` (words of the text, words of the template, their place in it) make another licence.

    They do where a number or a word that tells licences apart is among them, or where any word inside the
    licence's name is more, less or other; lines of SPDX names bear no change at all. ``behind`` is the text that follows.
    """
    if words[0] == "spdx":
        return bool(changes) or re.match(r"(?:-(?!only\b|or-later\b)\w|\+\w)", behind) is not None
    first, end = _name(words)
    for new, old, c, d in changes:
        if _plain(new) != _plain(old) and (any(TELLING.search(w) for w in new + old) or (c < end and d > first)):
            return True
        # A name cut short by words too many to align: 'the MIT No Attribution (MIT-0) License'.
        if not new and c < end == d == len(words) and re.match(r"[^\w.;\n]*(?!licen[cs]e\b)\w[^.;\n]{0,60}?\blicen[cs]e\b", behind):
            return True
    return False


def _aligned(have: list[str], words: list[str], x: int, y: int, start: int, more: int, least: int) -> tuple[int, int, int, int]:
    """(words in common, -more, first, behind the last) of a template laid at ``start`` in words x to y of a text, with room for ``more`` at both ends.

    Runs below ``least`` words don't count.
    """
    low, high = max(x, start - more), min(y, start + len(words) + 2 + more)  # words that the text has besides the template's move its ends
    same = [m for m in difflib.SequenceMatcher(None, have[low:high], words, autojunk=False).get_matching_blocks() if m.size >= least]
    return (sum(m.size for m in same), -more, low + same[0].a, low + same[-1].a + same[-1].size) if same else (0, -more, x, x)


def wording(block: str, words: list[str], share: float) -> tuple[int, int, int, list[str]] | None:
    """(start, end, words in common, differences) of the closest stretch of ``block`` that confirms a template, or None.

    Where the closest stretch doesn't, what lies before and behind its longest common run is searched too.
    """
    spans = words_of(block)
    have = [s[0] for s in spans]
    todo, best = [(0, len(have))], None
    while todo:
        x, y = todo.pop()
        if (Counter(words) & Counter(have[x:y])).total() < share * len(words):
            continue
        anchor = difflib.SequenceMatcher(None, have[x:y], words, autojunk=False).find_longest_match()
        at = x + anchor.a
        near = max(_aligned(have, words, x, y, at - anchor.b, more, 1) for more in (0, 2 + len(words) // 10))
        if len(words) >= 40 and near[0] < len(words):
            # A passage may have been put into a long text: what is more of the template there counts against what is more besides.
            wide = _aligned(have, words, x, y, at - anchor.b, len(words), 4)
            near = max(near, wide, key=lambda t: 5 * t[0] - (t[3] - t[2]))
        common, _, first, last = near
        if common >= share * len(words):
            part = have[first:last]
            changes = [(op, part[a:b], words[c:d], c, d) for op, a, b, c, d in difflib.SequenceMatcher(None, part, words, autojunk=False).get_opcodes() if op != "equal"]
            differences = [f"{op} {' '.join(new)!r} for {' '.join(old)!r}" for op, new, old, _, _ in changes]
            if not _tells([x[1:] for x in changes], words, block[spans[last - 1][2] :].lower()):
                found = (spans[first][1], spans[last - 1][2], common, differences)
                if best is None or (not differences, common) > (not best[3], best[2]):
                    best = found
                continue
        todo += [(at + anchor.size, y), (x, at)]
    return best


def scan(text: str | None, share: float = SHARE) -> list[dict]:
    """Confirmed licences of a whole text, by place: license, start, end, saved, exact, differences.

    Wording confirms, the saving decides. The best match of a block splits it, and what lies
    before and behind is searched again.
    """
    out: list[dict] = []
    cue = _cues(share)[0]
    todo = blocks(text or "", share)[::-1]
    while todo:
        a, b = todo.pop()
        block, best = text[a:b], None
        for name, _, words, compressor in candidates(block, share):
            found = wording(block, words, share)
            if found is None:
                continue
            saved, left = saving(block[found[0] : found[1]], compressor)
            if best is None or 4 * saved - left > best[0]:
                best = (4 * saved - left, saved, name, found)
        if best is None:
            continue
        _, saved, name, (s, e, _, differences) = best
        # Long runs of cues give blocks that overlap, so a notice may be seen twice.
        if not any(m["start"] < a + e and a + s < m["end"] for m in out):
            out.append({"license": name, "start": a + s, "end": a + e, "saved": saved, "exact": not differences, "differences": differences})
        todo += [(x, y) for x, y in ((a + e, b), (a, a + s)) if cue.search(text, x, y)]
    return sorted(out, key=lambda m: m["start"])


MATCHES = "array<struct<license:string,start:bigint,end:bigint,saved:bigint,exact:boolean,differences:array<string>>>"


def scan_all(docs: DataFrame) -> DataFrame:
    """doc_id and matches per row of ``docs``."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("exact", pa.bool_()), ("differences", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, matches {MATCHES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_licenses``: licences of every document, confirmed by wording."""
    found = scan_all(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"), "matches")
