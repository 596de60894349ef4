"""Format-preserving Feistel pseudonyms for personal data, in Column expressions only.

One pattern finds candidates; each is validated in its own format: card numbers by
their check digit, IPv4 addresses by their octets, dates by the calendar, phone
numbers by their count of digits. A card's candidate is a whole run of digit groups; it is
read from the left, and at each group a stretch of whole groups with 13 to 19 digits and a right
check digit is a card, one grouped as cards are before others, the longest first.
A valid value is permuted within its format by a keyed
Feistel network over a grid of m x n values: a pair (a, b) becomes (a + F(b)) mod m and
(b + F(a)) mod n in turns, which is a bijection of the grid, so equal values stay equal,
different ones stay different, and a holder of the key can go back. Card numbers get the check
digit of their new digits, dates stay dates of the years 1 to 9999 that are read in the same order
of day and month, social security numbers stay valid ones, addresses stay
addresses, and separators stay in place. E-mail names and assigned secrets, which have no
numeric format, get a keyed digest of the same kind of characters and the same length (names: eight at least).

Rows pass through one projection: no shuffle, no Python. A text is searched once, a candidate classified once.

Defined results: a null text stays null, with no findings; an empty one stays empty; candidates that don't
validate stay as they are; findings never overlap, and where two kinds could start at one character the
kind named first in ``PATTERNS`` wins; repeated rows give repeated results; an empty table gives
no rows; texts of any length are searched whole, in memory of a few times their size; other columns are kept by
``pseudonymise``, but ``pii`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Between the groups of a phone number.
_GAP = r"(?:[^0-9A-Za-z\r\n]{1,6})?"
#: Between digits of a phone number in any other grouping.
_SEP = r"(?: ?\(|\)[ \-]?|[ .\-/])"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9\-/])"
#: What a number in groups doesn't run into: an address, a date, a social security number.
_OTHER = r"(?!\d{1,3}(?:\.\d{1,3}){3}(?![0-9])|\d{3}-\d{2}-\d{4}(?![0-9\-])|" + _DATE + ")"
_CARD = r"(?!(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d{13,19})(?!\d|[ \-]\d{4}))"
#: Candidates by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?i:(?:token|secret|api[_-]?key|password)\s*[=:]\s*\"[^\"\s]{8,}\")",
    "ipv4": r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9])",
    "phone": r"\+\d{1,3}" + _GAP + r"\d{3}" + _GAP + r"\d{3}" + _GAP + r"\d{4}(?!\d)|(?<![0-9A-Za-z])\+[1-9](?:(?:" + _SEP + _OTHER + _CARD + r")?\d){7,14}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9\-])\d{3}-\d{2}-\d{4}(?![0-9\-])",
    "date": r"(?<![0-9\-/.])" + _DATE,
    "card": r"(?<![0-9A-Za-z])(?=\d(?:[ \-]?\d){12})\d++(?![A-Za-z])(?:(?: " + _OTHER + r"|-)\d++(?![A-Za-z]))*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold to be worth the search: a digit, an at sign or a quoted assignment.
_HINT = r"[0-9@\"]"
#: Stands before and behind a candidate while a text is cut; Unicode gives this number to no character.
_CUT = "\uffff"


def _mac(key: str, *parts: Column) -> Column:
    """A 60-bit keyed number of ``parts``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tag: str) -> Column:
    """The pair (a, b), of m x n possible ones, permuted: struct(a, b)."""

    def turn(acc: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(F.pmod(acc["a"] + F.pmod(_mac(key, F.lit(tag), m, n, r, acc["b"]), m), m).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + F.pmod(_mac(key, F.lit(tag), m, n, r, acc["a"]), n), n).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def unfeistel(a: Column, b: Column, m: Column, n: Column, key: str, tag: str) -> Column:
    """What ``feistel`` gave (a, b) for."""

    def turn(acc: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(F.pmod(acc["a"] - F.pmod(_mac(key, F.lit(tag), m, n, r, acc["b"]), m), m).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), F.pmod(acc["b"] - F.pmod(_mac(key, F.lit(tag), m, n, r, acc["a"]), n), n).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _bind(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: str, tag: str, back: bool = False) -> Column:
    """A string of 2 to 30 digits permuted among those of its length."""
    cut = F.floor(F.length(digits) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    size = F.length(digits)
    a, b = F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, size)
    net = unfeistel if back else feistel
    return _bind(net(a, b, power(cut), power(size - cut), key, tag), lambda s: F.concat(F.lpad(s["a"].cast("string"), cut, "0"), F.lpad(s["b"].cast("string"), size - cut, "0")))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one not doubled."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: _luhn_part(F.coalesce(c.try_cast("int"), F.lit(0)), i)), F.lit(0), lambda x, y: x + y
    )


def _luhn_part(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    fill = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(only_digits(F.substring(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), fill), "")


_EPOCH = "0001-01-01"
#: Days of the years 1 to 9999, and those of them from the 13th of a month on, as grids.
_DAYS, _LATE = (1717, 2127), (1043, 2121)


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def _day(value: Column) -> Column:
    """A written date as struct(at, late), or null: its place among all days; month first (late) only where
    day first isn't a date, and then the place among the days from the 13th of each month on."""
    read = lambda pattern: F.date_diff(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), _date(_EPOCH))
    month = (F.substring(value, 7, 4).try_cast("int") - 1) * 12 + F.substring(value, 1, 2).try_cast("int") - 1
    place = lambda at, late: F.when(at >= 0, F.struct(at.cast("long").alias("at"), F.lit(late).alias("late")))
    return (
        F.when(value.rlike(r"^\d{4}-\d\d-\d\d$"), place(read("yyyy-MM-dd"), False))
        .when(value.rlike(r"^\d\d\.\d\d\.\d{4}$"), place(read("dd.MM.yyyy"), False))
        .when(value.rlike(r"^\d\d/\d\d/\d{4}$"), F.coalesce(place(read("dd/MM/yyyy"), False), place(read("MM/dd/yyyy") - 12 * (month + 1), True)))
    )


def _late_date(at: Column) -> Column:
    """The date at a place among the days from the 13th on."""
    begin = lambda m: F.date_diff(F.add_months(_date(_EPOCH), m), _date(_EPOCH)) - 12 * m
    near = F.floor(at * 12 * 9999 / (_LATE[0] * _LATE[1])).cast("int")
    month = F.array_max(F.filter(F.sequence(near - 2, near + 2), lambda m: (m >= 0) & (m < 12 * 9999) & (begin(m) <= at)))
    return _bind(month, lambda m: F.date_add(F.add_months(_date(_EPOCH), m), (at - begin(m) + 12).cast("int")))


def permute_date(value: Column, day: Column, key: str) -> Column:
    """A valid date, of which ``day`` is ``_day``, in its own way of writing."""

    def turned(grid: tuple[int, int], tag: str, date) -> Column:
        net = feistel(F.floor(day["at"] / grid[1]), day["at"] % grid[1], F.lit(grid[0]), F.lit(grid[1]), key, tag)
        return _bind(net, lambda s: date(s["a"] * grid[1] + s["b"]))

    any_day = turned(_DAYS, "date", lambda at: F.date_add(_date(_EPOCH), at.cast("int")))
    return (
        F.when(day["late"], F.date_format(turned(_LATE, "late", _late_date), "MM/dd/yyyy"))
        .when(value.contains("-"), F.date_format(any_day, "yyyy-MM-dd"))
        .when(value.contains("/"), F.date_format(any_day, "dd/MM/yyyy"))
        .otherwise(F.date_format(any_day, "dd.MM.yyyy"))
    )


def permute_ssn(value: Column, key: str) -> Column:
    """A valid number among all valid ones: area 1 to 899 without 666, group 1 to 99, serial 1 to 9999."""
    part = lambda k: F.split_part(value, F.lit("-"), F.lit(k)).cast("long")
    area = part(1) - F.when(part(1) > 666, 2).otherwise(1)
    net = feistel(area * 99 + part(2) - 1, part(3) - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    new = lambda s: F.floor(s["a"] / 99) + 1
    return _bind(net, lambda s: F.format_string("%03d-%02d-%04d", new(s) + F.when(new(s) >= 666, 1).otherwise(0), s["a"] % 99 + 1, s["b"] + 1))


def _digest(key: str, tag: str, value: Column, size: Column) -> Column:
    """``size`` hex digits that depend on key, tag and value."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 64).cast("int")), lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), k.cast("string"), value), 256))
    return F.substring(F.array_join(blocks, ""), F.lit(1), size)


def permute_ip(value: Column, key: str) -> Column:
    part = lambda k: F.split_part(value, F.lit("."), F.lit(k)).cast("long")
    net = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, "ipv4")
    return _bind(net, lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))


def permute_card(value: Column, key: str) -> Column:
    """The digits before the check digit are permuted; the check digit follows from them."""
    digits = only_digits(value)
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    with_check = lambda d: F.concat(d, ((10 - luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string"))
    return refill(value, _bind(body, with_check))


def kind_of(value: Column, day: Column) -> Column:
    """The kind of a candidate, or null where it doesn't validate; ``day`` is its ``_day``."""
    n = F.length(only_digits(value))
    octets = F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int") < 256, F.lit(False)))
    iban = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), ((F.ascii(F.substring(iban, 1, 1)) - 55)).cast("string"), (F.ascii(F.substring(iban, 2, 1)) - 55).cast("string"), F.substring(iban, 3, 2))
    mod97 = F.aggregate(F.split(turned, ""), F.lit(0), lambda x, c: F.coalesce((x * 10 + c.try_cast("int")) % 97, x))
    return (
        F.when(value.contains("@"), "email")
        .when(value.contains('"'), "secret")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, "ipv4"))
        .when(value.startswith("+"), F.when(n.between(8, 15), "phone"))
        .when(value.rlike("^[A-Z]{2}"), F.when(mod97 == 1, "iban"))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~value.rlike(r"^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(value.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4})$"), F.when(day.isNotNull(), "date"))
        .when(n.between(13, 19), F.when(luhn_sum(only_digits(value)) % 10 == 0, "card"))
    )


#: Ways in which cards are grouped.
_SHAPE = r"^(\d{13,19}|\d{4}([ \-]\d{4}){3}([ \-]\d{3})?|\d{4}[ \-]\d{6}[ \-]\d{4,5})$"


def parts(value: Column) -> Column:
    """A candidate as strings that join to it: a run of digit groups cut before and behind each card in it, others whole."""
    words = F.regexp_extract_all(value, F.lit(r"\d+[ \-]?"), F.lit(0))

    def cut(words: Column, sizes: Column) -> Column:
        n = F.size(words)
        joined = lambda i, j: F.array_join(F.slice(words, i, j - i + 1), "")
        bare = lambda i, j: F.regexp_replace(joined(i, j), r"[ \-]$", "")

        def cards(i: Column, only_grouped: bool) -> Column:
            """Last groups of the cards that begin with group ``i``."""
            fits = F.filter(F.sequence(i, F.least(i + 18, n)), lambda j: F.aggregate(F.slice(sizes, i, j - i + 1), F.lit(0), lambda x, y: x + y).between(13, 19))
            right = lambda t: (luhn_sum(only_digits(t)) % 10 == 0) & (t.rlike(_SHAPE) if only_grouped else F.lit(True))
            return F.filter(fits, lambda j: _bind(bare(i, j), right))

        def first_inside(i: Column, j: Column) -> Column:
            return (j > i) & F.exists(F.sequence(F.least(i + 1, j), j), lambda k: F.size(cards(k, True)) > 0)

        def take(state: Column, i: Column) -> Column:
            last = F.coalesce(F.array_max(cards(i, True)), F.array_max(F.filter(cards(i, False), lambda j: ~first_inside(i, j))))
            behind = lambda j: F.regexp_extract(F.element_at(words, j), r"[ \-]?$", 0)
            more = lambda j: F.struct((j + 1).alias("next"), F.concat(state["out"], F.array(joined(state["next"], i - 1), bare(i, j), behind(j))).alias("out"))
            return F.when(i < state["next"], state).otherwise(_bind(last, lambda j: F.when(j.isNull(), state).otherwise(more(j))))

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), n), start, take, lambda s: F.concat(s["out"], F.array(joined(s["next"], n))))

    lengths = lambda ws: F.transform(ws, lambda w: F.length(only_digits(w)))
    in_run = value.rlike(r"^\d[\d \-]*$") & (F.length(only_digits(value)) >= 13)
    return F.when(in_run, _bind(words, lambda ws: _bind(lengths(ws), lambda sizes: cut(ws, sizes)))).otherwise(F.array(value))


def pseudonym(value: Column, kind: Column, day: Column, key: str) -> Column:
    """What stands for a candidate; itself where it didn't validate (no ``kind``)."""
    name = F.split_part(value, F.lit("@"), F.lit(1))
    email = F.concat(_digest(key, "email", F.lower(name), F.greatest(F.length(name), F.lit(8))), F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))
    inside = F.split_part(value, F.lit('"'), F.lit(2))
    digest = _digest(key, "secret", F.lower(inside), F.length(inside))
    secret = F.concat(F.split_part(value, F.lit('"'), F.lit(1)), F.lit('"'), F.when(F.upper(inside) == inside, F.upper(digest)).otherwise(digest), F.lit('"'))
    digits = only_digits(value)
    # The country code stays; ten digits are permuted, or all but three where there are fewer or more than with a country code.
    size = F.length(digits)
    own = F.when(size.between(11, 13), F.lit(10)).otherwise(size - 3)
    phone = refill(value, F.concat(F.substring(digits, F.lit(1), size - own), permute_digits(F.substring(digits, size - own + 1, own), key, "phone")))
    # Country and check digits of an account number: the check follows from the new digits.
    plain = F.regexp_replace(value, " ", "")
    body = permute_digits(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    country = F.substring(plain, F.lit(1), F.lit(2))

    def checked(d: Column) -> Column:
        turned = F.concat(d, (F.ascii(country) - 55).cast("string"), (F.ascii(F.substring(country, 2, 1)) - 55).cast("string"), F.lit("00"))
        rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda x, c: F.coalesce((x * 10 + c.try_cast("int")) % 97, x))
        return F.concat(F.lpad((98 - rest).cast("string"), 2, "0"), d)

    iban = refill(value, _bind(body, checked))
    return F.coalesce(
        F.when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "ipv4", permute_ip(value, key))
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
        .when(kind == "ssn", permute_ssn(value, key))
        .when(kind == "date", permute_date(value, day, key))
        .when(kind == "card", permute_card(value, key)),
        value,
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text pseudonymised, and ``pii``: kind, value and pseudonym of each finding, in order."""
    # A text that holds the mark itself gets one with its own digest, which it can't hold.
    mark = F.when(F.col("text").contains(_CUT), F.concat(F.lit(_CUT), F.sha2("text", 256), F.lit(_CUT))).otherwise(F.lit(_CUT))
    pieces = F.split(F.regexp_replace(F.col("text"), F.lit(ANY), F.concat(mark, F.lit("$0"), mark)), mark, -1)

    def finding(v: Column) -> Column:
        named = lambda day: F.struct(kind_of(v, day).alias("kind"), day.alias("day"))
        done = lambda s: F.struct(s["kind"].alias("kind"), v.alias("value"), pseudonym(v, s["kind"], s["day"], key).alias("pseudonym"))
        return _bind(_bind(_day(v), named), done)

    gap = lambda p: F.array(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("value"), p.alias("pseudonym")))
    found = F.flatten(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, gap(p)).otherwise(F.transform(parts(p), finding))))
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    turned = docs.withColumn("__found", F.when(F.col("text").rlike(_HINT), found))
    text = F.coalesce(F.array_join(F.transform("__found", lambda s: s["pseudonym"]), ""), F.col("text"))
    return turned.withColumn("text", text).withColumn("pii", F.coalesce(F.filter("__found", lambda s: s["kind"].isNotNull()), none)).drop("__found")


#: Setting that names the secret key of a session's runs.
KEY = "spark.quillstone.pii.key"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_pii``: every document with its pseudonymised text and counts by kind.

    The key is the setting ``spark.quillstone.pii.key``; where it is unset, as over synthetic tables, one that
    hides nothing from readers of this file.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(docs, spark.conf.get(KEY, "not a secret"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *[count(k) for k in PATTERNS])
