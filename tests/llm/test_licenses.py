"""Licences: a plain twin of the choice, passages put into whole texts, SPDX lines, tables of odd rows."""

import numpy as np
import pytest

pytest.importorskip("quillstone.llm")

from quillstone.llm import op10_licenses as o  # noqa: E402

RNG = np.random.default_rng(10)
PROSE = "river town water boat bridge morning stone garden winter light road window".split()
MIT = max(o.TEMPLATES["MIT"], key=len)


def prose(n):
    return " ".join(RNG.choice(PROSE, n))


def put_in(text, n):
    words = text.split()
    at = len(words) // 2
    return " ".join([*words[:at], *RNG.choice(PROSE, n), *words[at:]])


@pytest.mark.parametrize("n", [1, 10, 25, 40, 60, 120])
def test_a_passage_in_a_whole_text_is_a_difference(n):
    """The short notice that a changed whole text starts with doesn't hide the change."""
    changed = put_in(MIT, n)
    text = f"{prose(200)} {changed} {prose(200)}"
    (found,) = o.scan(text)
    assert (found["license"], found["exact"]) == ("MIT", False) and len(found["differences"]) == 1
    assert found["differences"][0].startswith("delete") and len(found["differences"][0].split(" for ")[0].split()) == n + 1
    assert text[found["start"] : found["end"]] + "." == changed


def test_the_saving_decides(monkeypatch):
    text = put_in(MIT, 40)
    assert not o.scan(text)[0]["exact"]
    monkeypatch.setattr(o, "saving", lambda stretch, compressor: (0, 0))
    assert o.scan(text)[0]["exact"]


def test_two_changed_copies_are_two():
    one, two = MIT.replace("publish, ", "print, "), MIT.replace("OTHER DEALINGS", "MORE DEALINGS")
    found = o.scan(f"{prose(30)} {one} {two} {prose(30)}")
    assert [(m["license"], len(m["differences"])) for m in found] == [("MIT", 1), ("MIT", 1)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# SPDX-License-Identifier: MIT\nimport os", [("MIT", True)]),
        ("// SPDX-License-Identifier: Apache-2.0 OR MIT", [("Apache-2.0", True)]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", [("GPL-2.0", True)]),
        ("SPDX-License-Identifier: LGPL-2.1-only", [("LGPL-2.1", True)]),
        ("SPDX-License-Identifier: LGPL-2.0-only", []),
        ("SPDX-License-Identifier: BSD-2-Clause-Patent", []),
        ("SPDX-License-Identifier: CC-BY-NC-4.0", [("CC-BY-NC-4.0", True)]),
        ("SPDX-License-Identifier: MIT-0", []),
        ("Licensed under the EUPL, Version 1.2.", [("EUPL-1.2", True)]),
        ("Licensed under the Foo, Version 1.2.", []),
        (max(o.TEMPLATES["GPL-2.0"], key=len), [("GPL-2.0", True)]),
        (max(o.TEMPLATES["GPL-3.0"], key=len), [("GPL-3.0", True)]),
        (max(o.TEMPLATES["LGPL-2.1"], key=len), [("LGPL-2.1", True)]),
        (max(o.TEMPLATES["AGPL-3.0"], key=len), [("AGPL-3.0", True)]),
    ],
)
def test_names_of_one_line(text, expected):
    assert [(m["license"], m["exact"]) for m in o.scan(text)] == expected


def test_twin_of_the_choice():
    """Of one block, the licence is that of the template that saves most on what it confirms, found here by trying them all."""
    import zstandard as z

    def size(raw, template=None):
        more = {} if template is None else {"dict_data": z.ZstdCompressionDict(template.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT), "write_dict_id": False}
        return len(z.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, **more).compress(raw))

    for _ in range(12):
        name = str(RNG.choice(list(o.TEMPLATES)))
        text = f"{prose(12)}. {RNG.choice(o.TEMPLATES[name])} {prose(12)}"
        best = None
        for other, texts in o.TEMPLATES.items():
            for t in texts:
                found = o.wording(text, [w for w, _, _ in o.words_of(t)], o.SHARE)
                if found:
                    raw = text[found[0] : found[1]].lower().encode()
                    saved = size(raw) - size(raw, t)
                    if best is None or 4 * saved - size(raw, t) > best[0]:
                        best = 4 * saved - size(raw, t), saved, other, found[0], found[1], not found[3]
        first = next(m for m in o.scan(text) if m["start"] == best[3])
        assert (first["saved"], first["license"], first["start"], first["end"], first["exact"]) == best[1:] and first["license"] == name


def test_tables_of_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, None, "a"), (2, "", "b"), (3, notice, None), (3, notice, "c"), (None, notice, "d"), (4, prose(150_000) + " " + notice, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = sorted(((r.doc_id or 0), [(m.license, m.exact) for m in r.matches]) for r in o.scan_all(docs).collect())
    found = [("MIT", True)]
    assert got == [(0, found), (1, []), (2, []), (3, found), (3, found), (4, found)]
    assert o.scan_all(docs.limit(0)).count() == 0 and o.scan_all(docs).columns == ["doc_id", "matches"]
