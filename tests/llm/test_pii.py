"""op7 against a plain Python version, on documents, on dates and numbers of every format, and on very long runs."""

import datetime
import hashlib
import os

import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("quillstone.llm.registry")

from quillstone.llm import op7_pii  # noqa: E402

KEY = "k"
ANY = regex.compile(op7_pii.ANY, regex.A)
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def mac(*parts):
    return int(hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(a, b, m, n, tag):
    for r in range(op7_pii.ROUNDS):
        if r % 2 == 0:
            a = (a + mac(tag, m, n, r, b) % m) % m
        else:
            b = (b + mac(tag, m, n, r, a) % n) % n
    return a, b


def bare(v):
    return "".join(c for c in v if c in "0123456789")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10


def refill(v, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in v)


def swap_digits(d, tag):
    cut = len(d) // 2
    a, b = feistel(int(d[:cut]), int(d[cut:]), 10**cut, 10 ** (len(d) - cut), tag)
    return f"{a:0{cut}d}{b:0{len(d) - cut}d}"


def hexes(tag, v, size):
    return "".join(hashlib.sha256(f"{KEY}|{tag}|{k}|{v}".encode()).hexdigest() for k in range((size - 1) // 64 + 1))[:size]


def read_date(v):
    for shape, pattern in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y"), (r"\d\d/\d\d/\d{4}", "%d/%m/%Y"), (r"\d\d/\d\d/\d{4}", "%m/%d/%Y")):
        if regex.fullmatch(shape, v):
            try:
                return datetime.datetime.strptime(v, pattern).date(), pattern
            except ValueError:
                continue


def write_date(day, pattern):
    return pattern.replace("%Y", f"{day.year:04d}").replace("%m", f"{day.month:02d}").replace("%d", f"{day.day:02d}")


LATE = [d for d in map(datetime.date.fromordinal, range(1, datetime.date.max.toordinal() + 1)) if d.day > 12]
PLACE = {d: k for k, d in enumerate(LATE)}


def plain(v):
    """(kind, pseudonym) of a candidate that isn't a run of digit groups, or None."""
    n = len(bare(v))
    if "@" in v:
        name, domain = v.split("@")
        return "email", hexes("email", name.lower(), max(8, len(name))) + "@" + domain
    if '"' in v:
        before, inside = v.split('"')[:2]
        new = hexes("secret", inside.lower(), len(inside))
        return "secret", f'{before}"{new.upper() if inside.upper() == inside else new}"'
    if regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
        p = [int(x) for x in v.split(".")]
        if max(p) > 255:
            return None
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4")
        return "ipv4", f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if v[0] == "+":
        own = 10 if 11 <= n <= 13 else n - 3
        return ("phone", refill(v, bare(v)[: n - own] + swap_digits(bare(v)[n - own :], "phone"))) if 8 <= n <= 15 else None
    if regex.match("[A-Z]{2}", v):
        flat = v.replace(" ", "")
        turned = lambda body, check: int("".join(str(int(c, 36)) for c in body + flat[:2] + check))
        if turned(flat[4:], flat[2:4]) % 97 != 1:
            return None
        body = swap_digits(flat[4:], "iban")
        return "iban", refill(v, f"{98 - turned(body, '00') % 97:02d}" + body)
    if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
        area, group, serial = map(int, v.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        areas = [k for k in range(1, 900) if k != 666]
        a, b = feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        return "ssn", f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if found := read_date(v):
        day, pattern = found
        late = pattern == "%m/%d/%Y"
        m, n = (1043, 2121) if late else (1717, 2127)
        at = PLACE[day] if late else day.toordinal() - 1
        a, b = feistel(at // n, at % n, m, n, "late" if late else "date")
        return "date", write_date(LATE[a * n + b] if late else datetime.date.fromordinal(a * n + b + 1), pattern)


SHAPE = regex.compile(op7_pii._SHAPE[1:-1], regex.A)


def findings(v):
    """(kind or None, value, pseudonym) of the parts of a candidate."""
    if not regex.fullmatch(r"\d[\d \-]*", v) or len(bare(v)) < 13:
        new = plain(v)
        return [(new[0], v, new[1])] if new else [(None, v, v)]
    words = regex.findall(r"\d+[ \-]?", v)

    def ends(i, grouped):
        spans = [(j, "".join(words[i : j + 1]).rstrip(" -")) for j in range(i, min(i + 19, len(words)))]
        return [j for j, t in spans if 13 <= len(bare(t)) <= 19 and luhn(bare(t)) == 0 and (not grouped or SHAPE.fullmatch(t))]

    out, gap, i = [], "", 0
    while i < len(words):
        found = ends(i, True) or [j for j in ends(i, False) if not any(ends(k, True) for k in range(i + 1, j + 1))]
        if not found:
            gap += words[i]
            i += 1
            continue
        text = "".join(words[i : max(found) + 1])
        t = text.rstrip(" -")
        body = swap_digits(bare(t)[:-1], "card")
        out += [(None, gap, gap), ("card", t, refill(t, body + str(-luhn(body + "0") % 10)))]
        gap, i = text[len(t) :], max(found) + 1
    return [*out, (None, gap, gap)]


def whole(text):
    """(text, [(kind, value, pseudonym)]) by brute force."""
    if text is None:
        return None, []
    out, found, at = [], [], 0
    for m in ANY.finditer(text):
        new = findings(m[0])
        out += [text[at : m.start()], *(x[2] for x in new)]
        found += [x for x in new if x[0]]
        at = m.end()
    return "".join([*out, text[at:]]), found


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in op7_pii.pseudonymise(df, KEY).collect()}
    for k, t in enumerate(texts):
        assert (got[k].text, [tuple(p) for p in got[k].pii]) == whole(t), (t or "")[:200]
    return got


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the synthetic tables")
def test_documents(spark):
    texts = [r.text for r in spark.read.parquet(DOCUMENTS).select("text").collect()]
    assert sum(len(r.pii) for r in check(spark, texts).values()) > 50


def test_formats(spark):
    texts = [f"{a:03d}-{b:02d}-{c:04d}" for a, b, c in ((8, 8, 8), (1, 1, 1), (665, 99, 9999), (667, 1, 1), (899, 99, 9999), (666, 1, 1), (0, 1, 1), (900, 1, 1), (5, 0, 5), (5, 5, 0))]
    texts += ["01/02/1799", "2300-01-01", "0001-01-01", "9999-12-31", "0000-01-01", "12/31/1999", "02/29/2000", "02/29/1900", "31/12/1999", "13/13/2001", "01/13/0001", "12/31/9999", "29.02.2024"]
    texts += ["GB82 1234 5698 7654 32", "DE89370400440532013000", "a" * 90 + "@x.example", 'password: "' + "s" * 300 + '"', "A@b.c ￿ 10.0.0.1 ￿", "x@a.b" * 3]
    texts += [f"{m:02d}/{d:02d}/{y:04d}" for y in (1, 4, 1900, 2000, 9999) for m in range(1, 13) for d in (13, 28, 30)]
    texts += ["7 4111 1111 1111 1111 5500-0000-0000-0004 12 34", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3 4", None, ""]
    got = check(spark, texts)
    again = check(spark, [got[k].text for k in range(len(texts))])
    kinds = lambda r: [p.kind for p in r.pii if p.kind in ("ssn", "date")]
    assert [kinds(again[k]) for k in range(len(texts))] == [kinds(got[k]) for k in range(len(texts))]
    assert got[0].text != "008-08-0008" and got[10].text != "01/02/1799" and "￿ 10.0.0.1" not in got[27].text


def test_permutation_of_late_days(spark):
    """The places of all days from the 13th on are the inverse of their dates."""
    at = spark.range(0, 2212203, 977).select(F.col("id"), op7_pii._late_date(F.col("id")).alias("date"))
    assert all(LATE[r.id] == r.date for r in at.collect())


def test_very_long_runs(spark):
    """1 MB of what each pattern is made of neither ends the JVM nor loses a character."""
    n = 1_000_000
    runs = ["x@" + "a." * (n // 2), "a" * n, "a@" * (n // 2), "x@a" + ".b" * (n // 2), 'token = "' + "s" * n, "token" + " " * n, "1." * (n // 2), "+1" + " (2) 3-4" * (n // 8), "GB12" + " 3456" * (n // 5), "1-" * (n // 2), "12/" * (n // 3), "9" * n, "2024-01-01" * (n // 10)]
    runs += ["1234 5678 " * (n // 10)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(runs)], "doc_id long, text string").repartition(4)
    grown = F.aggregate("pii", F.lit(0), lambda n, p: n + F.length(p["pseudonym"]) - F.length(p["value"]))
    sizes = {r.doc_id: r.size for r in op7_pii.pseudonymise(df, KEY).select("doc_id", (F.length("text") - grown).alias("size")).collect()}
    assert sizes == {k: len(t) for k, t in enumerate(runs)}


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "p", "f")], "doc_id long, text string, pii string, kind string")
    row = op7_pii.pseudonymise(df, KEY).collect()[0]
    assert row.kind == "f" and row.pii[0].kind == "ipv4" and row.text == whole("10.0.0.1")[0]
    assert op7_pii.pseudonymise(df.limit(0), KEY).count() == 0
