"""Pseudonyms that keep the format: private values of a text are permuted within their kind by a keyed Feistel network.

A value is read as a number below a * b, split into a part below a and one below b, and in turn each part gets a keyed hash of
the other added, modulo its bound. That is one-to-one, so equal values stay equal in all documents and different ones
different. What comes out is valid in the same format: cards keep their check digit, dates are dates, addresses have octets.
Text columns are worked on by built-in functions only: the text is split at the values, the values are replaced, and
the parts are joined again. Mail addresses and secrets, which are no numbers, get keyed digests of their form.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 that a date may be, 270 * 270 of them.
FIRST_DAY, DAY_PARTS = "1900-01-01", (270, 270)
#: Days after the 12th of a month that a date in month/day order may be, from the same day on.
LATE_PARTS = (210, 210)

MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\d-]|\.\d)"
PHONE = (
    r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}"  # by the numbering plan
    r"|(?:(?:\+1[ .-]?|1[ .-])(?:\(\d{3}\) ?|\d{3}[ .-])|\(\d{3}\) ?)\d{3})[ .-]\d{4}(?![\d-]|\.\d)"  # by its form
)
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
SECRET = r"\bAKIA[A-Z0-9]{16}\b|\b[0-9a-f]{40}\b|\bpassword=[^\s\"']+"
VALUE = "|".join((MAIL, CARD, PHONE, SOCIAL, ADDRESS, DATE, SECRET))


def _digest(key: Column, label: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(label), *(p.cast("string") for p in parts)), 256)


def permuted(number: Column, a: int, b: int, key: Column, label: str) -> Column:
    """A keyed permutation of the numbers below a * b."""

    def moved(part: Column, other: Column, turn: Column, bound: int) -> Column:
        added = F.conv(F.substring(_digest(key, label, turn, other), 1, 15), 16, 10).cast("long")
        return F.pmod(part + F.pmod(added, F.lit(bound)), F.lit(bound)).cast("long")

    def step(held: Column, turn: Column) -> Column:
        left, right = held["left"], held["right"]
        even = F.struct(moved(left, right, turn, a).alias("left"), right.alias("right"))
        odd = F.struct(left.alias("left"), moved(right, left, turn, b).alias("right"))
        return F.when(turn % 2 == 0, even).otherwise(odd)

    # whole-number division: from 2^53 on a quotient of doubles is rounded
    quotient = F.call_function("div", number.cast("long"), F.lit(b).cast("long"))
    start = F.struct(quotient.alias("left"), (number % b).cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda h: h["left"] * b + h["right"])


def _digits(number: Column, size: int) -> Column:
    return F.lpad(number.cast("string"), size, "0")


def _check_sum(digits: Column) -> Column:
    """Luhn sum of digits of which the last is not doubled."""
    turned = F.split(F.reverse(digits), "")
    worth = F.transform(
        turned,
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def card(value: Column, key: Column) -> Column:
    """Keeps the first digit and the spaces or dashes; all between first and check digit is permuted."""
    digits = F.regexp_replace(value, "[ -]", "")
    found = value
    for size in range(13, 20):
        inner = size - 2
        low = inner // 2
        number = F.substring(digits, 2, inner).try_cast("long")
        body = F.concat(F.substring(digits, 1, 1), _digits(permuted(number, 10 ** (inner - low), 10**low, key, f"card{size}"), inner))
        whole = F.concat(body, F.pmod(-_check_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        found = F.when(F.length(digits) == size, whole).otherwise(found)
    mark = F.regexp_extract(value, "[ -]", 0)
    spaced = F.regexp_replace(found, F.lit(r"(\d{4})(?=\d)"), F.concat(F.lit("$1"), mark))
    kept = F.when(mark == "", found).otherwise(spaced)
    return F.when(_check_sum(digits) % 10 == 0, kept).otherwise(value)


def phone(value: Column, key: Column) -> Column:
    """Country code and signs stay. Numbers whose area and exchange are 200 to 999 are permuted among themselves, as are all others."""
    form = r"^(.*?)(\d{3})(\D+)(\d{3})(\D)(\d{4})$"
    part = [F.regexp_extract(value, form, i) for i in range(1, 7)]
    area, exchange, line = (part[i].try_cast("long") for i in (1, 3, 5))

    def made(new: Column, area: Column, exchange: Column) -> Column:
        return F.concat(part[0], _digits(area, 3), part[2], _digits(exchange, 3), part[4], _digits(new % 10000, 4))

    planned = permuted(((area - 200) * 800 + exchange - 200) * 10000 + line, 80000, 80000, key, "phone")
    low = F.when(area < 200, area * 1000 + exchange).otherwise(200000 + (area - 200) * 200 + exchange)  # 360,000 places
    other = permuted(low * 10000 + line, 60000, 60000, key, "phone-other")
    place = F.floor(other / 10000)
    return F.when((area >= 200) & (exchange >= 200), made(planned, F.floor(planned / 8000000) + 200, F.floor(planned / 10000) % 800 + 200)).otherwise(
        made(
            other,
            F.when(place < 200000, F.floor(place / 1000)).otherwise(F.floor((place - 200000) / 200) + 200),
            F.when(place < 200000, place % 1000).otherwise((place - 200000) % 200),
        )
    )


def social(value: Column, key: Column) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999; other numbers are not valid and stay."""
    area, group, serial = (F.element_at(F.split(value, "-"), i).try_cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = permuted((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "social")
    back = F.floor(new / (99 * 9999)) + 1
    back = back + F.when(back >= 666, 1).otherwise(0)
    made = F.concat_ws("-", _digits(back, 3), _digits(F.floor(new / 9999) % 99 + 1, 2), _digits(new % 9999 + 1, 4))
    return F.when(valid, made).otherwise(value)


def address(value: Column, key: Column) -> Column:
    """Four octets of 0 to 255; anything else is not valid and stays."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permuted(number, 65536, 65536, key, "address")
    made = F.concat_ws(".", *(F.shiftright(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
    return F.when(F.array_max(octets) <= 255, made).otherwise(value)


def date(value: Column, key: Column) -> Column:
    """Dates of the days that ``FIRST_DAY`` and the parts give, in their form; no other is touched. 12/11/1999 is read day first."""
    found, (a, b) = value, DAY_PARTS
    for sign, form in (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy")):
        part = F.split(value, r"\." if sign == "." else sign)
        order = part if form.startswith("y") else F.reverse(part)
        day = F.datediff(F.try_to_timestamp(F.concat_ws("-", order), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
        new = permuted(day.cast("long"), a, b, key, "date")
        made = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form)
        valid = value.contains(sign) & day.between(0, a * b - 1)
        found = F.when(valid, made).otherwise(found)
    return F.when(value.rlike(r"^\d{2}/(?:1[3-9]|2\d|3[01])/"), _month_first(value, key)).otherwise(found)


def _month_first(value: Column, key: Column) -> Column:
    """Dates in month/day order of a day after the 12th, which are no dates in the other order; they are permuted among themselves."""
    first, (a, b) = F.lit(FIRST_DAY).cast("date"), LATE_PARTS
    month, day, year = (F.element_at(F.split(value, "/"), i) for i in (1, 2, 3))
    whole = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    months = (year.try_cast("int") - int(FIRST_DAY[:4])) * 12 + month.try_cast("int")
    place = F.datediff(whole, first) - 12 * months  # late days before this one
    new = permuted(place.cast("long"), a, b, key, "date-month-first").cast("int")
    start = lambda m: F.add_months(first, m)
    about = F.floor(new / 18.437).cast("int")
    back = F.array_max(F.filter(F.sequence(about - 2, about + 2), lambda m: F.datediff(start(m), first) - 12 * m <= new))
    made = F.date_format(F.date_add(first, new + 12 * (back + 1)), "MM/dd/yyyy")
    return F.when(place.between(0, a * b - 1), made).otherwise(value)


def mail(value: Column, key: Column) -> Column:
    """The name before the sign becomes 24 keyed letters, 96 bits; the domain stays. Letter case counts for nothing."""
    name = F.translate(F.substring(_digest(key, "mail", F.lower(value)), 1, 24), "0123456789abcdef", "abcdefghijklmnop")
    return F.concat(name, F.lit("@"), F.substring_index(value, "@", -1))


def secret(value: Column, key: Column) -> Column:
    digest = _digest(key, "secret", value)
    return (
        F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))))
        .when(value.startswith("password="), F.concat(F.lit("password="), F.substring(digest, 1, 18)))
        .otherwise(F.substring(digest, 1, 40))
    )


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one value; a value that its kind does not allow stays as it is."""
    whole = lambda pattern: value.rlike("^(?:" + pattern + ")$")
    return (
        F.when(value.contains("@"), mail(value, key))
        .when(whole(SECRET), secret(value, key))
        .when(whole(CARD), card(value, key))
        .when(whole(SOCIAL), social(value, key))
        .when(whole(ADDRESS), address(value, key))
        .when(whole(DATE), date(value, key))
        .otherwise(phone(value, key))
    )


def replaced(text: Column, key: Column) -> Column:
    """(text, n) with every private value of ``text`` replaced; n counts those that changed."""
    values = F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))
    pairs = F.transform(values, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    parts = F.split(text, VALUE, -1)
    ends = F.concat(F.transform(pairs, lambda p: p["new"]), F.array(F.lit("")))
    joined = F.concat_ws("", F.flatten(F.zip_with(parts, ends, lambda a, b: F.array(a, b))))
    changed = F.size(F.filter(pairs, lambda p: p["old"] != p["new"]))
    return F.struct(joined.alias("text"), changed.alias("n"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with private values of ``text`` replaced, other columns as they are; ``count`` names a column of changes.

    Null stays null and counts no change; a text without values is not touched. Repeated rows stay equal. Whole texts are
    searched; numbers that fail validation (check digit, octets, calendar) are no private values. What the plan holds, and so
    what explain and logs can show, is a digest of ``key``, not the key; whoever has that digest can still repeat the pseudonyms.
    """
    made, key = "__made", hashlib.sha256(b"pseudonyms|" + key.encode()).hexdigest()
    some = F.col(text).rlike("[0-9@]") & F.col(text).rlike(VALUE)
    plain = F.struct(F.col(text).alias("text"), F.lit(0).alias("n"))
    wide = docs.withColumn(made, F.when(some, replaced(F.col(text), F.lit(key))).otherwise(plain))
    columns = [F.col(f"{made}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return wide.select(*columns, *([F.col(f"{made}.n").cast("long").alias(count)] if count else []))
