"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

A value found and validated is permuted within its format by a keyed Feistel
network: the same value gets the same pseudonym in every document, and a
pseudonym is a value of that format again (a card number keeps its length and
passes the Luhn test, an address has octets up to 255, a date is a date).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# What is looked for, one pattern for each kind, in order of preference.
PATTERNS = {
    # from the start of a run of such characters or where the last match ended, so that a long run is read once
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![\d\-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d\-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    # any digits after a country code or in brackets; bare numbers have area and exchange from 200 on
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{3}\) ?|\d{3}[ .\-])|\(\d{3}\) ?|[2-9]\d{2}[ .\-](?=[2-9]))\d{3}[ .\-]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])[2-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\d\-])",
    "secret": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b[0-9a-f]{40}\b|\b[0-9a-f]{64}\b",
}
#: Any of them. Numbers start with a digit, a plus or a bracket, the others not inside a word: most places are passed over at a glance.
ANY = "(?:(?=[0-9+(])(?:" + "|".join(PATTERNS.values()) + ")|(?=[A-Za-z._%\\-])(?:\\G|(?<![A-Za-z0-9_]))(?:" + PATTERNS["email"] + "|" + PATTERNS["secret"] + "))"
#: Stands around matches while a text is taken apart.
_EDGE = "\x00"
#: Days of the dates that are permuted: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049


def _prf(key: str, *parts: Column) -> Column:
    """48 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, m_left: Column, m_right: Column, rounds: int = 8) -> Column:
    """struct(l, r): a keyed permutation of pairs with l < m_left and r < m_right."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = (s["l"] + _prf(key, F.lit(kind), i, s["r"])) % m_left
        odd = (s["r"] + _prf(key, F.lit(kind), i, s["l"])) % m_right
        return F.struct(F.when(i % 2 == 0, even).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, odd).otherwise(s["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _digits(key: str, kind: str, digits: Column) -> Column:
    """Permutes a string of up to 30 digits among those of its length."""
    n = F.length(digits)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    ten = F.lit(10).cast("double")
    m_left, m_right = F.pow(ten, half).cast("long"), F.pow(ten, n - half).cast("long")
    right = F.when(n > half, F.substring(digits, half + 1, n - half).cast("long")).otherwise(F.lit(0).cast("long"))
    s = feistel(key, kind, F.substring(digits, F.lit(1), half).cast("long"), right, m_left, m_right)
    return F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.when(n > half, F.lpad(s["r"].cast("string"), n - half, "0")).otherwise(""))


def _refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in turn."""
    pieces, n = F.split(form, r"\d"), F.length(digits)
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(digits, i, F.lit(1)), F.element_at(pieces, i + 1))), ""))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, from the last if ``odd`` is 0."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == odd, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _phone(key: str, ten: Column) -> Column:
    """Permutes ten digits of a phone number.

    Those with area and exchange from 200 on are permuted among themselves
    (800 areas of 8,000,000 lines), and so are all others: 200 areas of
    10,000,000 lines, then 800 of 2,000,000, numbered through.
    """
    area, line = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 7).cast("long")
    usual = (area >= 200) & (line >= 2_000_000)
    million = F.lit(1_000_000).cast("long")
    nth = F.when(area < 200, area * 10_000_000 + line).otherwise((area - 200) * 2_000_000 + line + 2_000_000_000)
    left = F.when(usual, area - 200).otherwise(F.floor(nth / million))
    right = F.when(usual, line - 2_000_000).otherwise(nth % million)
    digits = lambda area, line: F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad(line.cast("string"), 7, "0"))

    def other(nth: Column) -> Column:
        rest = nth - 2_000_000_000
        return F.when(rest < 0, digits(F.floor(nth / 10_000_000), nth % 10_000_000)).otherwise(digits(F.floor(rest / 2_000_000) + 200, rest % 2_000_000))

    s = feistel(key, "phone", left, right, F.when(usual, 800).otherwise(3600), F.when(usual, 8_000_000).otherwise(million))
    return _let(s, lambda p: F.when(usual, digits(p["l"] + 200, p["r"] + 2_000_000)).otherwise(other(p["l"] * million + p["r"])))


def _alike(key: str, text: Column) -> Column:
    """Permutes letters and digits within their own alphabets, halves against each other; other characters stay."""
    n = F.length(text)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))

    def shifted(part: Column, other: Column, i: Column) -> Column:
        def one(j: Column) -> Column:
            c = F.substring(part, j, F.lit(1))
            k = _prf(key, F.lit("alike"), i, j, other)
            code = F.ascii(c)
            within = lambda low, size: F.chr(((code - low + k % size) % size + low).cast("long"))
            return F.when(c.rlike("^[0-9]$"), within(48, 10)).when(c.rlike("^[a-z]$"), within(97, 26)).when(c.rlike("^[A-Z]$"), within(65, 26)).otherwise(c)

        return F.when(F.length(part) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), one), "")).otherwise("")

    def step(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.greatest(n - half, F.lit(0))).alias("r"))
    s = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step)
    return F.concat(s["l"], s["r"])


def _hex_alike(key: str, text: Column) -> Column:
    """Permutes hexadecimal digits, halves against each other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), lambda j: F.lower(F.hex((F.conv(F.substring(part, j, F.lit(1)), 16, 10).cast("long") + _prf(key, F.lit("hex"), i, j, other)) % 16))), "")

    def step(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"))

    s = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n - half).alias("r")), step)
    return F.concat(s["l"], s["r"])


def kind_of(match: Column) -> Column:
    """The kind of a match, or null if it fails its validation: a card must pass the Luhn test, a date must exist."""
    digits = F.regexp_replace(match, r"\D", "")
    whole = lambda name: match.rlike(f"^(?:{PATTERNS[name]})$")
    card = whole("card") & F.length(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0)
    return (
        F.when(whole("email"), "email").when(whole("date") & F.try_to_date(match, "yyyy-MM-dd").isNotNull(), "date").when(whole("ip"), "ip")
        .when(whole("phone"), "phone").when(whole("ssn"), "ssn").when(card, "card").when(whole("secret"), "secret")
    )


def pseudonym(key: str, match: Column, kind: Column) -> Column:
    """The pseudonym of a validated match; the match itself where kind is null."""
    digits = F.regexp_replace(match, r"\D", "")
    n = F.length(digits)
    # date: days since the first, permuted as 271 * 270 >= DAYS pairs, walked until it is a day again
    day = F.datediff(F.try_to_date(match, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))

    def walk(x: Column) -> Column:
        s = feistel(key, "date", F.floor(x / 271), x % 271, F.lit(270), F.lit(271))
        return s["l"] * 271 + s["r"]

    def onward(state: Column, i: Column) -> Column:
        return F.when((state < DAYS) & (i > 0), state).otherwise(walk(state))

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(11)), day.cast("long"), onward)
    date = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), "yyyy-MM-dd")
    octets = F.transform(F.split(match, r"\."), lambda o: o.cast("long"))
    s = feistel(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536))
    ip = F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)])
    body = F.concat(F.substring(digits, 1, 1), _digits(key, "card", F.substring(digits, F.lit(2), n - 2)))
    card = _refill(match, F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string")))
    moved_phone = F.concat(F.substring(digits, F.lit(1), n - 10), _let(F.substring(digits, n - 9, F.lit(10)), lambda ten: _phone(key, ten)))
    phone = _let(moved_phone, lambda d: _refill(match, d))
    a, b, c = (F.substring(digits, *x).cast("long") for x in ((1, 3), (4, 2), (6, 4)))
    areas = 899 - 1  # 001 to 899 without 666
    q = feistel(key, "ssn", F.when(a > 666, a - 2).otherwise(a - 1), (b - 1) * 9999 + c - 1, F.lit(areas), F.lit(99 * 9999))
    first = F.when(q["l"] + 1 >= 666, q["l"] + 2).otherwise(q["l"] + 1)
    ssn = _refill(match, F.concat(F.lpad(first.cast("string"), 3, "0"), F.lpad((F.floor(q["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((q["r"] % 9999 + 1).cast("string"), 4, "0")))
    email = F.concat(_alike(key, F.regexp_extract(match, "^(.*)@", 1)), F.regexp_extract(match, "(@.*)$", 1))
    secret = F.when(match.rlike("^(?:AKIA|ASIA)"), F.concat(F.substring(match, 1, 4), _alike(key, F.substring(match, F.lit(5), F.length(match) - 4)))).otherwise(_hex_alike(key, match))
    return (
        F.when(kind == "email", email).when(kind == "date", date).when(kind == "ip", ip).when(kind == "phone", phone)
        .when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "secret", secret).otherwise(match)
    )


def key_of(spark: SparkSession) -> str:
    """The key that the session names in ``tidemark.pii.key``; one for trials where it names none."""
    return spark.conf.get("tidemark.pii.key", None) or "for trials only"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text pseudonymised, and pii_count, pii_kinds (sorted, without repeats).

    A null text stays null with count 0. Whole texts are searched once, from
    left to right, in time linear in their length; only rows that have a digit,
    an @ or a key are taken apart. Where kinds overlap, the earlier match counts,
    then the order of ``PATTERNS``. Columns of docs by the new names give way.
    What fails validation stays as it is, and so do the domains of e-mail
    addresses. Equal values get equal pseudonyms in all rows, repeated ones too.
    """
    kept = docs.drop("pii_count", "pii_kinds")
    text = F.col("text")
    suspect = text.rlike(r"[0-9@]|(?:AKIA|ASIA)[A-Z0-9]{16}|[0-9a-f]{40}")
    # gaps and matches in turn; a text that has the edge character itself is searched twice
    once = F.split(F.regexp_replace("text", ANY, f"{_EDGE}$0{_EDGE}"), _EDGE, -1)
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    twice = F.flatten(F.zip_with(F.split("text", ANY, -1), found, lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    parts = kept.withColumn("_parts", F.when(suspect, F.when(F.contains(text, F.lit(_EDGE)), twice).otherwise(once)))
    as_struct = lambda x, i: F.when(i % 2 == 1, F.struct(x.alias("m"), kind_of(x).alias("k"))).otherwise(F.struct(x.alias("m"), F.lit(None).cast("string").alias("k")))
    told = parts.withColumn("_found", F.transform("_parts", as_struct)).drop("_parts")
    kinds = F.transform(F.filter("_found", lambda x: x["k"].isNotNull()), lambda x: x["k"])
    has = F.exists("_found", lambda x: x["k"].isNotNull())
    fresh = F.array_join(F.transform("_found", lambda x: F.when(x["k"].isNull(), x["m"]).otherwise(pseudonym(key, x["m"], x["k"]))), "")
    others = [F.when(has, fresh).otherwise(text).alias("text") if c == "text" else F.col(c) for c in kept.columns]
    return told.select(*others, F.coalesce(F.when(has, F.size(kinds)), F.lit(0)).alias("pii_count"), F.coalesce(F.when(has, F.array_join(F.array_sort(F.array_distinct(kinds)), ",")), F.lit("")).alias("pii_kinds"))
