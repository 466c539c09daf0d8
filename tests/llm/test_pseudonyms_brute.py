"""The whole of op2 against a plain-Python Feistel network: same values found, same pseudonyms, every row."""

import datetime
import hashlib
import os
import random
import re

import pytest

from glossa.llm import pseudonyms as p
from tests.llm.fixtures import odd_documents
from tests.llm.test_records import PII, luhn

KEY = "key of the test"
SMALL = "/root/testdata/sf0.001/documents.parquet"


def keyed_number(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def network(left, right, sizes, tag):
    for i in range(8):
        left, right = right, (left + keyed_number(tag, i, right)) % sizes[i % 2]
    return left, right


def digits_of(value):
    return "".join(c for c in value if c in "0123456789")


def permuted(digits, tag):
    u = len(digits) // 2
    v = len(digits) - u
    a, b = network(int(digits[:u]), int(digits[u:]), (10**u, 10**v), f"{tag}{len(digits)}")
    return f"{a:0{u}d}{b:0{v}d}"


def filled(value, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in value)


def new_card(value):
    body = permuted(digits_of(value)[:-1], "card")
    return filled(value, body + next(c for c in "0123456789" if luhn(body + c)))


def ssn_fine(d):
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def new_ssn(value):
    d = permuted(digits_of(value), "ssn")
    while not ssn_fine(d):
        d = permuted(d, "ssn")
    return filled(value, d)


def new_phone(value):
    d = digits_of(value)
    return filled(value, d[:-10] + permuted(d[-10:], "phone"))


def new_ip(value):
    o = [int(x) for x in value.split(".")]
    a, b = network(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def parsed(value):
    """The date and its form, of year, day and month first in this order."""
    d = digits_of(value)
    forms = {"%Y%m%d": (d[:4], d[4:6], d[6:])} if value[:4].isdigit() else {"%d%m%Y": (d[4:], d[2:4], d[:2]), "%m%d%Y": (d[4:], d[:2], d[2:4])}
    for form, ymd in forms.items():
        try:
            day = datetime.date(*map(int, ymd))
        except ValueError:
            continue
        if 1900 <= day.year <= 2099:
            return day, form
    return None


def new_date(value):
    first = datetime.date(1900, 1, 1)
    day, form = parsed(value)
    x = (day - first).days
    while True:
        a, b = network(x // 512, x % 512, (256, 512), "date")
        x = a * 512 + b
        if x < 73049 and (form != "%m%d%Y" or (first + datetime.timedelta(x)).day > 12):
            return filled(value, (first + datetime.timedelta(x)).strftime(form))


def new_email(value):
    h = hashlib.sha256(f"{KEY}|email|{value.lower()}".encode()).hexdigest()
    return f"u{h[:12]}@{h[12:18]}.invalid"


def others(text, counts):
    def swap(m):
        v = m[0]
        if "@" in v:
            kind = "email"
        elif re.fullmatch(p.IP, v, re.ASCII):
            kind = "ip" if all(int(x) < 256 for x in v.split(".")) else None
        elif re.fullmatch(p.DATE, v, re.ASCII):
            kind = "date" if parsed(v) else None
        elif re.fullmatch(p.SSN, v, re.ASCII):
            kind = "ssn" if ssn_fine(digits_of(v)) else None
        else:
            kind = "phone"
        if kind is None:
            return v
        counts[kind] += 1
        return {"email": new_email, "ip": new_ip, "date": new_date, "ssn": new_ssn, "phone": new_phone}[kind](v)

    return re.sub(p.OTHERS, swap, text, flags=re.ASCII)


def brute(text):
    counts = dict.fromkeys(p.KINDS, 0)
    if text is None:
        return (None, *counts.values())
    start, out, at, done = re.compile(p.CARD_START, re.ASCII), [], 0, 0
    while at < len(text):
        hit = None
        if start.match(text, at):
            lengths = (re.compile(rf"\d(?:[ -]?\d){{{n - 1}}}(?!\d)", re.ASCII).match(text, at) for n in range(19, 12, -1))
            hit = next((m[0] for m in lengths if m and luhn(digits_of(m[0]))), None)
        if hit:
            out += [others(text[done:at], counts), new_card(hit)]
            counts["card"] += 1
            at = done = at + len(hit)
        else:
            at += 1
    return ("".join([*out, others(text[done:], counts)]), *counts.values())


def random_texts(n):
    r = random.Random(8)

    def number(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def card():
        body = number(r.randint(12, 18))
        whole = body + next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))

    makers = [
        card, card, lambda: number(r.randint(1, 20)), lambda: ".".join(str(r.randint(0, 300)) for _ in range(4)), lambda: f"{r.randint(1, 40):02d}/{r.randint(1, 40):02d}/{r.randint(1850, 2150)}",
        lambda: f"{r.randint(1850, 2150)}-{r.randint(0, 14):02d}-{r.randint(0, 33):02d}", lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}.{number(4)}",
        lambda: f"A{number(2)}.b@x{number(1)}.Example.com", lambda: "é word", lambda: "٣٤٥", lambda: "\n", lambda: "x",
    ]
    return ["".join(r.choice(makers)() + r.choice([" ", " ", " ", "", ",", "-", "/", "+", " "]) for _ in range(r.randint(1, 25))) for _ in range(n)]


def test_all_rows_equal_plain_python(spark):
    texts = [*PII, *(t for _, t, *_ in odd_documents(2)), *random_texts(400), "no number here " * 20_000 + "card 4068516892505468 12/25 " + "1.2.3.4 " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, *(r[f"n_{k}"] for k in p.KINDS)) for r in p.pseudonymize(docs, KEY).collect()}
    assert len(got) == len(texts)
    wrong = [(i, t[:200] if t else t) for i, t in enumerate(texts) if got[i] != brute(t)]
    assert not wrong, wrong[:3]
    assert all(sum(g[1 + i] for g in got.values()) > 50 for i in range(len(p.KINDS)))


@pytest.mark.skipif(not os.path.exists(SMALL), reason="the table of documents is not here")
def test_table_equals_plain_python(spark):
    docs = spark.read.parquet(SMALL)
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.text, *(r[f"n_{k}"] for k in p.KINDS)) for r in p.pseudonymize(docs, KEY).collect())
    assert got == want and sum(sum(x[2:]) for x in got) > 20


def test_empty_table(spark):
    assert p.pseudonymize(spark.createDataFrame([], "doc_id long, text string, pieces string"), KEY).count() == 0
