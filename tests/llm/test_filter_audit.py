"""op13 against a walk of every order over plain rows."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

pytest.importorskip("quillstone.llm.registry")

from quillstone.llm import op13_filter_audit as q  # noqa: E402

FLAGS = "ABCDE"


def brute(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, a, b in labels:
        good[i] |= a == 1
        toxic[i] |= b == 1
    first = {}
    for i, t, _ in rows:
        key = (t or "",)
        first[key] = min(first.get(key, (True, 0)), (i is None, i or 0))
    found = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), (i is None, i or 0) > first[(t,)]]
        found[part or ""].append((dict(zip(FLAGS, fails, strict=True)), good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = {}
    for part, docs in found.items():
        shapley = defaultdict(int)
        for order in permutations(FLAGS):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                fails = [d for d in docs if d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in fails)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, lang string, part string, kept int, A boolean").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = q.audit(q.profile(docs, said, q.text_flags()), list(FLAGS))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r)[:3]: list(r)[3:] for r in found.collect()}


def test_every_order(spark):
    many = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", " \t\n\x0b", "SHOUT LOUD", many, many, many.upper(), many + " # $", "a b " * 60, "a|b", "é É\x85x", many + "\r\n" + "Zz" * 300_000]
    rows = [(k, t, (None, "", "en", "de")[k % 4]) for k, t in enumerate(texts)]
    rows += [(4, many, "en"), (4, many, "de"), (4, "other", "en"), rows[7], rows[7], (None, many, "en"), (None, None, "de"), (None, "alone", "fr"), (None, "alone", "fr"), (-5, "", "en")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 10)] + [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    assert run(spark, rows, labels) == brute(rows, labels)
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], labels) == {}


def test_whole_table_and_other_filters(spark):
    rows = [(k, "w " * (k % 7), "en" if k % 2 else "de") for k in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    counted = q.profile(docs, labels, {"short": F.length("text") < 4}, repeats="copy")
    found = {(r.part, r.subset): r.kept for r in q.survivors(counted, ["short", "copy"], whole=True).collect()}
    assert found[None, 0] == 40 and all(found[None, s] == found["en", s] + found["de", s] for s in range(4))
    assert found[None, 2] == 7 and found[None, 3] == 5 and found["en", 1] == sum(k % 2 and k % 7 > 1 for k in range(40))
