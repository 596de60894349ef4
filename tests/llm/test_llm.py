"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillstone.llm.registry")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillstone.llm import op1_token_counts, op2_sharding, op3_decontamination, op4_packing, op5_substring_dedup, op6_exact_dedup, op7_pii, op8_jaccard_join, op9_quality, op10_licenses  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, pre_token string, row_id long, score double"
RNG = np.random.default_rng(7)
WORDS = [f"w{k}" for k in range(300)] + ["l'été", "don't", "<|endoftext|>", "x_y", "日本語", "12,5"]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def rows():
    base, passage = prose(400), prose(45)
    texts = [None, "", " \n\t ", "a", base, base, base.replace(" ", "  "), prose(60) + " " + passage, passage + "\n" + prose(50), "x " * 60, "y z " * 40]
    edited = base.split()
    edited[200] = "changed"
    texts += [" ".join(edited), prose(3), prose(3000), passage, "tail  \n  space ", "a b c \x1c d", prose(25).upper()]
    out = [(k, t, "s", "p", 5, 0.5) for k, t in enumerate(texts)]
    return out + [out[4], (None, base, "s", "p", 5, 0.5)]


@pytest.fixture(scope="module")
def table():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, table, empty, monkeypatch):
    for size in (1, 1 << 23):
        monkeypatch.setattr(op1_token_counts, "BLOCK_BYTES", size)
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts.token_counts(docs, BPE).collect())
        assert got == sorted((str(d), len((t or "").encode()), n := len(tokens(t)), n > 512) for d, t, *_ in table)
    assert op1_token_counts.token_counts(empty, BPE).count() == 0
    with pytest.raises(ValueError):
        op1_token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_sharding(docs, table, empty):
    got = op2_sharding.shard(docs, tolerance=0.1).toPandas()
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in table)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert op2_sharding.shard(empty).count() == 0


def test_sharding_is_even(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.repeat(F.lit("x"), (F.col("id") % 200).cast("int"))).alias("text"))
    sizes = op2_sharding.shard(many).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.02 * sizes.mean() + 400


def test_packing(docs, table, empty):
    got = op4_packing.pack(docs, BPE).toPandas()
    ids = {str(float(d)) if d is not None else "nan": np.array([*tokens(t), 0], "<u4") for d, t, *_ in table}
    for r in got.itertuples():
        piece = ids[str(r.doc_id)][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(len(tokens(t)) + 1 for _, t, *_ in table)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 1024
    assert op4_packing.pack(empty, BPE).count() == 0


def lower(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, docs, table, empty):
    items = [(1, " ".join(table[14][1].split()[5:40])), (2, "A!"), (3, None), (10, table[12][1]), (2, "A!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, t, *_ in table:
        ws, hit, found = lower(t), set(), set()
        for item, text in items:
            iw = lower(text)
            for i in range(max(1, len(iw) - 9) if iw else 0):
                win = iw[i : i + 10]
                for j in range(len(ws) - len(win) + 1):
                    if ws[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        found.add(str(item))
        expected.append((str(d), len(ws), len(hit), ",".join(sorted(found))))
    index = op3_decontamination.build_index(docs)
    for block in (1 << 20, 1):  # all items at once, and one by one
        found = op3_decontamination.search(index, bench, block_bytes=block).select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n"), F.array_join("items", ",").alias("items"))
        if block > 1:
            assert sorted((str(r.doc_id), r.n_words, r.n, r["items"]) for r in found.collect()) == sorted(expected)
        else:
            assert sorted((str(r.doc_id), r.n_words, r["items"]) for r in found.collect()) == sorted((a, b, d) for a, b, _, d in expected)
    near = op3_decontamination.search(index, spark.createDataFrame([(1, "z y")], "item_id long, text string"), within=2)
    assert [r.doc_id for r in near.where(F.size("items") > 0).collect()] == [10]
    assert op3_decontamination.decontaminate(empty, bench).count() == 0


def test_substring_dedup(docs, table, empty):
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is None, table[k][0] or 0))
    first, expected = {}, []
    for k in order:
        ws = (table[k][1] or "").encode().split()
        gone = set()
        for i in range(len(ws) - 19):
            if first.setdefault(tuple(ws[i : i + 20]), (k, i)) != (k, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        expected.append((str(table[k][0]), len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    for options in ({}, {"rounds": 5, "cap": 9}, {"rounds": 1, "cap": 2}):
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup.substring_dedup(docs, **options).withColumn("kept_sha256", F.sha2("kept", 256)).collect()]
        assert sorted(got) == sorted(expected)
    assert op5_substring_dedup.substring_dedup(empty).count() == 0


def test_exact_dedup(docs, table, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in table]
    sizes, best = defaultdict(int), {}
    for n, (d, t, *_) in zip(norm, table, strict=True):
        sizes[n] += 1
        best[n] = min(best.get(n, (1, 1e9)), (-len(t or ""), 1e9 if d is None else d))
    got = op6_exact_dedup.groups(docs).collect()
    expected = sorted((str(d), int(best[n][1]), sizes[n], hashlib.sha256(n.encode()).hexdigest()) for n, (d, *_) in zip(norm, table, strict=True))
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(sizes)
    assert op6_exact_dedup.deduplicate(docs).count() == len(sizes) and op6_exact_dedup.deduplicate(docs).columns == docs.columns
    assert op6_exact_dedup.groups(empty).count() == 0


def test_pii(spark):
    text = 'Card 4111 1111 1111 1111, not 4111111111111112; on 2024-02-29, 31/12/1999; 10.0.300.1 or 10.0.30.1; call +1 (212) 555-0123; a.b@mail.example.com; token = "abcdef123456"'
    df = spark.createDataFrame([(1, text, "x"), (2, text, "y"), (3, None, "z"), (4, "nothing", "z"), (5, "", "z")], "doc_id long, text string, pii_kind string")
    got = {r.doc_id: r for r in op7_pii.pseudonymise(df, "k").collect()}
    assert got[1].text == got[2].text != text and got[3].text is None and got[4].text == "nothing" and got[5].text == ""
    kinds = {p.kind: p.pseudonym for p in got[1].pii}
    assert set(kinds) == {"card", "date", "ipv4", "phone", "email", "secret"}
    assert "4111111111111112" in got[1].text and "10.0.300.1" in got[1].text and "1111 1111" not in got[1].text
    digits = [int(c) for c in re.sub(r"\D", "", kinds["card"])]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", kinds["card"]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", kinds["phone"])


def test_feistel_is_a_bijection(spark):
    every = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    new = every.select("d", op7_pii.permute_digits(F.col("d"), "k", "t").alias("p"))
    assert new.select("p").distinct().count() == 1000
    assert new.where(op7_pii.permute_digits(F.col("p"), "k", "t", back=True) != F.col("d")).count() == 0


def test_jaccard(docs, table, empty):
    grams = []
    for _, t, *_ in table:
        ws = lower(t)
        grams.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    n, links, label = len(grams), [0] * len(grams), list(range(len(grams)))
    find = lambda k: k if label[k] == k else find(label[k])
    for a in range(n):
        for b in range(a + 1, n):
            if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    heads = defaultdict(list)
    for k in range(n):
        heads[find(k)].append(table[k][0])
    expected = sorted((str(table[k][0]), str(min((d for d in heads[find(k)] if d is not None), default=None)), links[k]) for k in range(n))
    for options in ({}, {"whole_limit": 1}):
        got = op8_jaccard_join.classes(docs, **options).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == expected
        assert sum(r.stays for r in got) == len(heads)
    assert op8_jaccard_join.classes(empty).count() == 0


def test_jaccard_blocks(spark):
    base = [f"v{k}" for k in range(200)]
    texts = []
    for k in range(60):
        ws = list(base)
        ws[(k * 37) % 200] = f"e{k % 9}"
        texts.append(" ".join(ws))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    g = [{tuple(w[i : i + 5]) for i in range(196)} for w in (t.split() for t in texts)]
    expected = {a: sum(len(g[a] & g[b]) >= 0.8 * len(g[a] | g[b]) for b in range(60) if b != a) for a in range(60)}
    for options in ({"block": 8}, {"block": 8, "whole_limit": 1}):
        assert {r.doc_id: r.n_links for r in op8_jaccard_join.classes(df, **options).collect()} == expected


def test_quality(spark):
    good = [(k, prose(80) + ".", 1) for k in range(300)]
    bad = [(300 + k, prose(80).upper().replace(" ", "!! "), 0) for k in range(60)]
    docs = spark.createDataFrame([*good, *bad, (900, None, 1), (901, "", 1)], "doc_id long, text string, quality int")
    scored = op9_quality.score(docs, docs.select("doc_id", "quality")).toPandas()
    assert scored.score.between(0, 1).all() and len(scored) == 362
    known = scored[scored.doc_id < 900]
    assert (known.predicted == known.quality).mean() > 0.97
    none = op9_quality.score(docs, docs.select("doc_id", "quality").limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_licenses():
    found = op10_licenses.scan("Some words. Licensed under CC BY-NC 4.0. More words.\nReleased under the MIT Licence.")
    assert [(m["license"], m["exact"]) for m in found] == [("CC-BY-NC-4.0", True), ("MIT", False)]
    assert op10_licenses.scan(None) == [] and op10_licenses.scan("a licence to say anything at all") == []
    for name, texts in op10_licenses.TEMPLATES.items():
        for t in texts:
            got = op10_licenses.scan("before it. " + t + " after it")
            assert got and got[0]["exact"] and got[0]["license"] == name, (name, t, got)


def test_ids_equal_the_library():
    import numpy as np
    import public_tokenizers

    from quillstone.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.rank_encoder(path) is not None and bpe.rank_encoder(public_tokenizers.path("word_bpe_49k.json")) is None
    for text in ["", " ", "a <|endoftext|> b", "<|endoftext|>x", "  x\n\n  y\t", "I'Ll don't", "é ½ ² 日本\u3000b \n c", "\x00\x1f", "a" * 60_000, " " * 6_000 + "x"]:
        assert np.frombuffer(bpe.ids_of(path, text), "<u4").tolist() == bpe.encode(path, [text])[0]


def test_licenses_before_and_behind_the_best():
    from quillstone.llm.op10_licenses import scan

    text = "Released under the MIT License. words between. This program uses more. Licensed under the Apache License, Version 2.0. then All rights reserved."
    found = scan(text)
    assert [m["license"] for m in found] == ["MIT", "Apache-2.0", "Proprietary"] and all(m["exact"] for m in found)
    assert [text[m["start"] : m["end"]] for m in found][0] == "Released under the MIT License"
    assert scan(None) == scan("") == [] and len(scan(" ".join([text] * 60))) == 180


def test_licenses_in_long_blocks():
    from quillstone.llm.op10_licenses import scan

    rng = np.random.default_rng(3)
    words = "the river of a small town under old permit was read by people who licensed work and wrote for their friends in summer rights".split()
    filler = lambda n: " ".join(rng.choice(words, n))
    for notice, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("All rights reserved.", "Proprietary"), ("Released under the MIT License.", "MIT")):
        for _ in range(20):
            text = " ".join(f"{filler(40)} a licence {filler(40)}." for _ in range(4)) + f" {notice} " + " ".join(f"{filler(40)} one licence {filler(40)}." for _ in range(4))
            assert [(m["license"], m["exact"], text[m["start"] : m["end"]]) for m in scan(text) if m["exact"]] == [(name, True, notice[:-1])]
    # Another licence's notice before it, with as long a run of common words, hides nothing.
    assert [m["license"] for m in scan("Licensed under the MIT 9 License. " + filler(30) + " Licensed under the MIT Licence.")] == ["MIT"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Licensed under the GNU Library General Public License, version 2.", []),
        ("It is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-Non-Commercial-Share Alike 4.0 International Licence.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 4.0 License.", ["CC-BY-NC-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 License.", ["CC-BY-4.0"]),
        ("This work is licensed under a Creative Commons Sampling Attribution 4.0 International License.", []),
        ("This work is licensed under the GNU General Public License (GPL), version 3.", ["GPL-3.0"]),
        ("Licensed under the MIT No Attribution License.", []),
        ("Licensed under the MIT No Attribution (MIT-0) License.", []),
        ("Licensed under the BSD 3-Clause Clear License.", []),
        ("Licensed under the MIT", ["MIT"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", ["MPL-2.0"]),
    ],
)
def test_licenses_of_other_names(text, expected):
    assert [m["license"] for m in op10_licenses.scan(f"Some words before. {text}")] == expected


def test_jaccard_of_pairs_without_a_common_band(spark):
    """A loose chain in one component: its pairs are counted alike at every size, though some share no band."""
    words = [f"z{k}" for k in range(430)]
    df = spark.createDataFrame([(k, " ".join(words[k : k + 30])) for k in range(400)], "doc_id long, text string")
    expected = {k: sum(0 <= k + d < 400 for d in (-2, -1, 1, 2)) for k in range(400)}
    for options in ({}, {"whole_limit": 1}):
        got = op8_jaccard_join.classes(df, recall=0.9, block=4, **options).collect()
        assert {r.doc_id: r.n_links for r in got} == expected and {r.class_id for r in got} == {0}


def test_pii_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    cases = [
        (f"{card} 12/27", ["card"], [card]),
        ("4111111111111111 123", ["card"], ["4111111111111111"]),
        (f"order 1234567 {card} 123 5500-0000-0000-0004", ["card", "card"], [card, "5500-0000-0000-0004"]),
        (f"{card} 2024-02-29 {card} 10.0.30.1", ["card", "date", "card", "ipv4"], [card, "2024-02-29", card, "10.0.30.1"]),
        (f"{card} 7a", ["card"], [card]),
        ("4111 1111 1111 1112 99", [], []),
        ("+12125550123", ["phone"], ["+12125550123"]),
        ("+1 212 5550123", ["phone"], ["+1 212 5550123"]),
        ("call +44 20 7946 0958.", ["phone"], ["+44 20 7946 0958"]),
        (f"+33 1 23 45 67 89 {card} 123", ["phone", "card"], ["+33 1 23 45 67 89", card]),
        ("+49 30 123456, +1234", ["phone"], ["+49 30 123456"]),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] + [(99, "1 " * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in op7_pii.pseudonymise(df, "k").collect()}
    for k, (text, kinds, values) in enumerate(cases):
        assert ([p.kind for p in got[k].pii], [p.value for p in got[k].pii]) == (kinds, values)
        want = text
        for p in got[k].pii:
            assert p.pseudonym != p.value and (p.kind == "ipv4" or re.sub(r"\d", "9", p.pseudonym) == re.sub(r"\d", "9", p.value))
            want = want.replace(p.value, p.pseudonym)
        assert got[k].text == want
    assert len(got[99].text) == 6000


def test_packing_of_tiny_texts(spark):
    tiny = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "").alias("text"))
    got = op4_packing.pack(tiny, BPE).toPandas()
    assert len(got) == 3000 and got.length.sum() == 4000 and got.sequence_id.nunique() == 4
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 1024
    used = {k for n in range(1, 1025) for _, k in op4_packing.cut(n, 1024, 1024, 8)}
    assert sum(used) < 6000  # rows left over for the one task


def test_licenses_of_whole_texts():
    """A changed whole text in the midst of a long document is found, with its exact differences; every template can be found by its cues."""
    from quillstone.llm import op10_licenses as o

    rng = np.random.default_rng(4)
    filler = " ".join(rng.choice("river town water boat bridge morning stone garden winter".split(), 3000))
    mit = max(o.TEMPLATES["MIT"], key=len)
    changed = mit.replace("publish, distribute, ", "publish, lend, distribute, ")
    found = o.scan(f"{filler} {changed} {filler}")
    assert [(m["license"], m["exact"], m["differences"]) for m in found] == [("MIT", False, ["delete 'lend' for ''"])]
    assert found[0]["end"] - found[0]["start"] > 1000
    two = max(o.TEMPLATES["BSD-2-Clause"], key=len)
    three = max(o.TEMPLATES["BSD-3-Clause"], key=len)
    assert [m["license"] for m in o.scan(f"{filler} {two} {filler} {three}")] == ["BSD-2-Clause", "BSD-3-Clause"]
    cue, around = o._cues(o.SHARE)
    for texts in o.TEMPLATES.values():
        for t in texts:
            words = [w for w, _, _ in o.words_of(t)]
            need = int(-(-o.SHARE * len(words) // 1))
            kept = sorted(words, key=lambda w: bool(cue.fullmatch(w)))[:need]
            assert any(cue.fullmatch(w) for w in kept) and len(t) < around, t
    assert [m["license"] for m in o.scan("Released under the MIT, so they say")] == ["MIT"]
