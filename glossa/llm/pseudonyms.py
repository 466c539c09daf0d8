"""Format-preserving pseudonyms of personal numbers and dates by a keyed Feistel network, in Spark expressions only.

Card numbers (Luhn), phone and social security numbers, IPv4 addresses and
dates are found by pattern and validated. Their digits are permuted by a
balanced Feistel network with SHA-256 rounds within the value's own format:
separators, lengths and validity stay, and equal values get equal pseudonyms
in all documents, however they are grouped by separators. Permutations of a
domain that is no power are walked until they hit it (cycle walking), so each
is one-to-one. E-mail addresses have no fixed domain and get a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALK = 128

# Fixed patterns, in the order of preference.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d/-])(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
OTHERS = "|".join((EMAIL, IP, DATE, SSN, PHONE))
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: Digits of a card number, most first.
CARD_DIGITS = range(19, 12, -1)
#: The empty place before what may be a card number and is nothing else.
CARD_START = rf"(?<![\d+])(?!{IP}|{DATE}|{SSN}|{PHONE})(?=\d(?:[ -]?\d){{12,18}}(?!\d))"


def number(key: str, *parts: Column, bits: int = 60) -> Column:
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, bits // 4), 16, 10).cast("long")


def feistel(a: Column, b: Column, a_size: Column, b_size: Column, key: str, tag: Column) -> Column:
    """The pair (a, b), a below a_size and b below b_size, permuted in an even number of rounds."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, a_size).otherwise(b_size)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + number(key, tag, i, s["b"]), size).cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    p = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1, n - u), F.pow(F.lit(10), u).cast("long"), F.pow(F.lit(10), n - u).cast("long"), key, F.concat(F.lit(tag), n.cast("string")))
    return bound(p, lambda x: F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), n - u, "0")))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def walk(start: Column, step, inside) -> Column:
    """step applied until inside holds."""
    s0 = F.struct(step(start).alias("x"), F.lit(0).alias("n"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), s0, lambda s, i: F.when(inside(s["x"]), s).otherwise(F.struct(step(s["x"]).alias("x"), i.cast("int").alias("n"))))
    return end["x"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number that still lacks its check digit."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: bound(F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def check_digit(body: Column) -> Column:
    return F.pmod(10 - luhn_sum(body) % 10, F.lit(10)).cast("string")


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits``, in order."""
    s0 = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, 1).otherwise(0)).cast("int").alias("k"))

    return F.aggregate(F.split(value, ""), s0, put)["out"]


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def card(value: Column, key: str) -> Column:
    return bound(only_digits(value), lambda d: bound(permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda b: refill(value, F.concat(b, check_digit(b)))))


def valid_card(value: Column) -> Column:
    return bound(only_digits(value), lambda d: check_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)))


def phone(value: Column, key: str) -> Column:
    """The country code stays; the ten digits after it are permuted."""
    return bound(only_digits(value), lambda d: refill(value, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permute_digits(F.substr(d, F.length(d) - 9, F.lit(10)), key, "phone"))))


def valid_ssn(d: Column) -> Column:
    return ~F.substr(d, F.lit(1), F.lit(3)).isin("000", "666") & (F.substr(d, F.lit(1), F.lit(1)) != "9") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000")


def ssn(value: Column, key: str) -> Column:
    return refill(value, walk(only_digits(value), lambda d: permute_digits(d, key, "ssn"), valid_ssn))


def octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("long"))


def ip(value: Column, key: str) -> Column:
    size = F.lit(65536).cast("long")
    return bound(octets(value), lambda o: bound(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, key, F.lit("ip")), lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)))


def valid_ip(value: Column) -> Column:
    return ~F.exists(octets(value), lambda o: o > 255)


FIRST, DAYS = "1900-01-01", 73049  # to 2099-12-31


def day(value: Column) -> Column:
    """Days from FIRST, or null for what is no date from 1900 to 2099; of 12/34/5678 forms, day first is tried before month first."""
    year_first = value.rlike("^[0-9]{4}")
    d = only_digits(value)
    iso = F.when(year_first, d).otherwise(F.concat(F.substr(d, F.lit(5), F.lit(4)), F.substr(d, F.lit(3), F.lit(2)), F.substr(d, F.lit(1), F.lit(2))))
    us = F.concat(F.substr(d, F.lit(5), F.lit(4)), F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(3), F.lit(2)))
    x = F.datediff(F.coalesce(F.try_to_date(iso, "yyyyMMdd"), F.when(~year_first, F.try_to_date(us, "yyyyMMdd"))), F.lit(FIRST).cast("date"))
    return F.when((x >= 0) & (x < DAYS), x)


def date(value: Column, key: str) -> Column:
    """Dates are permuted among each other, and those that only a month-first reading makes valid among such: so each form is one-to-one."""
    month_first = F.substr(only_digits(value), F.lit(3), F.lit(2)).cast("int") > 12
    us = ~value.rlike("^[0-9]{4}") & month_first

    def step(x: Column) -> Column:
        return bound(feistel(F.floor(x / 512), x % 512, F.lit(256).cast("long"), F.lit(512).cast("long"), key, F.lit("date")), lambda p: (p["a"] * 512 + p["b"]).cast("long"))

    def inside(x: Column) -> Column:
        return (x < DAYS) & (~us | (F.day(on(x)) > 12))

    def on(x: Column) -> Column:
        return F.date_add(F.lit(FIRST).cast("date"), x.cast("int"))

    d = on(walk(day(value).cast("long"), step, inside))
    return bound(d, lambda x: refill(value, F.when(value.rlike("^[0-9]{4}"), F.date_format(x, "yyyyMMdd")).when(month_first, F.date_format(x, "MMddyyyy")).otherwise(F.date_format(x, "ddMMyyyy"))))


def email(value: Column, key: str) -> Column:
    return bound(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), lambda h: F.concat(F.lit("u"), F.substr(h, F.lit(1), F.lit(12)), F.lit("@"), F.substr(h, F.lit(13), F.lit(6)), F.lit(".invalid")))


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(value: Column) -> Column:
    return (
        F.when(value.rlike("@"), F.lit("email"))
        .when(value.rlike(whole(IP)), F.when(valid_ip(value), F.lit("ip")))
        .when(value.rlike(whole(DATE)), F.when(day(value).isNotNull(), F.lit("date")))
        .when(value.rlike(whole(SSN)), F.when(valid_ssn(only_digits(value)), F.lit("ssn")))
        .when(value.rlike(whole(PHONE)), F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    c = F.when(kind == "email", email(value, key))
    for name, f in (("ip", ip), ("date", date), ("ssn", ssn), ("phone", phone), ("card", card)):
        c = c.when(kind == name, f(value, key))
    return c.otherwise(value)


def piece(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), kind.cast("string").alias("kind"))


def cards(text: Column) -> Column:
    """``text`` as pieces (text, kind): cards and what lies between. The leftmost number wins, then the longest, and numbers do not overlap.

    The text is cut at each place where a card may begin; 19 cuts hold any
    card, whatever digits stand before or after it.
    """

    def length_at(parts: Column, i: Column) -> Column:
        return bound(
            F.substring(F.array_join(F.slice(parts, i + 1, 19), ""), 1, 38),
            lambda near: F.coalesce(F.length(F.get(F.filter(F.array(*(F.regexp_extract(near, rf"^\d(?:[ -]?\d){{{d - 1}}}(?!\d)", 0) for d in CARD_DIGITS)), lambda x: (x != "") & valid_card(x)), F.lit(0))), F.lit(0)),
        )

    # the first part begins the text, whether a card may begin there or not
    begins = text.rlike(f"^{CARD_START}")

    def chosen(parts: Column) -> Column:
        each = F.transform(parts, lambda x, i: F.struct(F.length(x).alias("chars"), F.when((i > 0) | begins, length_at(parts, i)).otherwise(F.lit(0)).alias("card")))
        none = F.array().cast("array<struct<start:int,end:int>>")

        def step(s: Column, x: Column) -> Column:
            hit = (x["card"] > 0) & (s["at"] >= s["until"])
            span = F.struct(s["at"].alias("start"), (s["at"] + x["card"]).alias("end"))
            return F.struct((s["at"] + x["chars"]).cast("int").alias("at"), F.when(hit, span["end"]).otherwise(s["until"]).cast("int").alias("until"), F.when(hit, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), none.alias("spans")), step)["spans"]

    def cut(spans: Column) -> Column:
        def between(i: Column) -> Column:
            return F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])

        inner = F.transform(spans, lambda x, i: F.array(piece(F.substr(text, between(i) + 1, x["start"] - between(i)), F.lit(None)), piece(F.substr(text, x["start"] + 1, x["end"] - x["start"]), F.lit("card"))))
        last = F.array(piece(F.substr(text, F.coalesce(F.element_at(spans, -1)["end"], F.lit(0)) + 1, F.lit(2**31 - 1)), F.lit(None)))
        return F.concat(F.flatten(inner), last)

    whole_text = F.array(piece(text, F.lit(None)))
    return F.when(text.rlike(CARD_START), bound(bound(F.split(text, CARD_START, -1), chosen), lambda s: F.when(F.size(s) == 0, whole_text).otherwise(cut(s)))).otherwise(whole_text)


def others(text: Column) -> Column:
    """``text`` as pieces: addresses, dates, numbers other than cards, and what lies between."""
    found = F.regexp_extract_all(text, F.lit(f"({OTHERS})"), F.lit(1))
    pairs = bound(found, lambda vs: F.zip_with(F.split(text, OTHERS, -1), vs, lambda gap, v: F.array(piece(gap, F.lit(None)), piece(F.coalesce(v, F.lit("")), kind_of(v)))))
    return F.when(text.rlike(OTHERS), F.flatten(pairs)).otherwise(F.array(piece(text, F.lit(None))))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text with pseudonyms, n_<kind> for each kind, n_found.

    Values that match a pattern but are not valid stay as they are. A card
    number is found among other digits too, as long as it begins and ends where
    a group of digits does. Null text stays null, with counts 0. Rows that
    share a doc_id are handled each. Empty table: no rows. Other columns are
    ignored.
    """
    d = docs.select("doc_id", "text", cards(F.coalesce("text", F.lit(""))).alias("pieces"))
    d = d.withColumn("pieces", F.flatten(F.transform("pieces", lambda x: F.when(x["kind"].isNotNull(), F.array(piece(x["text"], x["kind"]))).otherwise(others(x["text"])))))
    text = F.array_join(F.transform("pieces", lambda x: F.when(x["kind"].isNull(), x["text"]).otherwise(pseudonym(x["text"], x["kind"], key))), "")
    counts = {f"n_{k}": F.size(F.filter("pieces", of_kind(k))).cast("long") for k in KINDS}
    d = d.select("doc_id", F.when(F.col("text").isNotNull(), text).alias("text"), *(c.alias(k) for k, c in counts.items()))
    return d.withColumn("n_found", sum((F.col(k) for k in counts), F.lit(0)).cast("long"))
