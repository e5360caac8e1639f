"""Pseudonyms against a step-by-step Feistel network, their formats, and that none meet."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from trackweave.llm import pii

KEY = "a key that only the tests have"


def feistel(a, b, size_a, size_b, tweak):
    for i in range(8):
        other = b if i % 2 == 0 else a
        noise = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{other}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + noise % size_a) % size_a
        else:
            b = (b + noise % size_b) % size_b
    return a, b


def digits(d, tweak):
    n = len(d) // 2
    a, b = feistel(int(d[:n] or 0), int(d[n:]), 10**n, 10 ** (len(d) - n), tweak)
    return (str(a).zfill(n) if n else "") + str(b).zfill(len(d) - n)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10


def into(shape, d):
    d = iter(d)
    return "".join(next(d) if c.isdigit() else c for c in shape)


def card(m):
    body = digits(re.sub(r"\D", "", m)[:-1], "card")
    return into(m, body + str(-luhn(body + "0") % 10))


def ip(m):
    p = [int(x) for x in m.split(".")]
    a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def swapped(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["n_pii"] for r in rows]


def test_equals_steps(spark):
    values = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "10.1.2.3", "255.255.255.0", "+44 20 7946 0958", "(415) 555-2671", "415-555-2671"]
    want = [card(values[0]), card(values[1]), card(values[2]), ip(values[3]), ip(values[4]), *[into(v, digits(re.sub(r"\D", "", v), "phone")) for v in values[5:]]]
    got, n = swapped(spark, [f"before {v} after, and {v}." for v in values])
    assert got == [f"before {v} after, and {v}." for v in want]
    assert n == [2] * len(values)
    assert all(luhn(re.sub(r"\D", "", v)) == 0 for v in want[:3])


def test_what_does_not_validate_stays(spark):
    texts = ["4111 1111 1111 1112", "2024-13-40", "000-12-3456", "666-12-3456", "300.1.2.3", "version 1.2.3", "call 12345", "a@b", "2023-02-29", "", "no digits"]
    got, n = swapped(spark, texts)
    assert got == texts and n == [0] * len(texts)


@pytest.mark.parametrize("kind", ["date", "ssn", "phone"])
def test_no_two_meet(spark, kind):
    day = datetime.date(1999, 1, 1)
    values = {"date": [str(day + datetime.timedelta(k)) for k in range(3000)], "ssn": [f"{a:03d}-{b:02d}-0001" for a in (1, 665, 667, 899) for b in range(1, 100)], "phone": [f"415-555-{k:04d}" for k in range(1000)]}[kind]
    got, n = swapped(spark, [f"x {v} y" for v in values])
    assert n == [1] * len(values) and len(set(got)) == len(values)
    for v in got:
        inner = v[2:-2]
        if kind == "date":
            assert 1900 <= datetime.date.fromisoformat(inner).year <= 2099
        else:
            assert re.fullmatch(r"\d{3}-\d\d-\d{4}" if kind == "ssn" else r"\d{3}-\d{3}-\d{4}", inner)
            assert kind == "phone" or (inner[:3] not in ("000", "666") and inner[:3] < "900" and inner[4:6] != "00" and inner[7:] != "0000")
    if kind == "date":
        leap = [g for g, v in zip(got, values, strict=True) if v.endswith("02-29")]
        assert leap and all(g.endswith("02-29 y") for g in leap) and sum("02-29" in g for g in got) == len(leap)


def test_mail_is_linked_across_documents(spark):
    got, n = swapped(spark, ["to ann.lee@mail.example.org now", "Cc Ann.Lee@mail.example.org.", "bob@mail.example.org"])
    names = [re.search(r"(\S+)@example\.invalid", g)[1] for g in got]
    assert n == [1, 1, 1] and names[0] == names[1] != names[2]


def test_odd_rows(spark, odd_docs, no_docs):
    x = odd_docs.withColumn("n_pii", F.lit("own"))
    got = {r["doc_id"]: (r["text"], r["n_pii"]) for r in pii.pseudonymise(x).collect()}
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5] == ("  \t\n ", 0)
    assert pii.pseudonymise(odd_docs).drop("n_pii").columns == odd_docs.columns
    assert pii.pseudonymise(no_docs).collect() == []
    long = "word " * 200_000 + "10.0.0.1"
    assert swapped(spark, [long])[0] == ["word " * 200_000 + ip("10.0.0.1")]


def test_cards_with_digits_beside(spark):
    c, d, a = "4111 1111 1111 1111", "5500000000000004", "3400 000000 00009"
    cases = [f"{c} 123", f"{d} 12/26", f"123 {c}", f"no 2024 {c} 12", f"{d} {c}", f"{a} 1234", f"77 {a}", f"{c} 2001-02-03 9"]
    got, n = swapped(spark, cases)
    for v in (c, d, a):
        cases = [t.replace(v, card(v)) for t in cases]
    assert [g for g, t in zip(got, cases) if "2001" not in t] == cases[:-1] and n == [1, 1, 1, 1, 2, 1, 1, 2]
    assert got[-1].startswith(card(c)) and "2001-02-03" not in got[-1]


def test_dates_day_or_month_first(spark):
    day = datetime.date(1999, 1, 1)
    days = [day + datetime.timedelta(k) for k in range(800)]
    for pattern in ("%d.%m.%Y", "%m/%d/%Y", "%d-%m-%Y"):
        values = [x.strftime(pattern) for x in days] + [x.strftime("%d/%m/%Y") for x in days if x.day > 12 and pattern == "%m/%d/%Y"]
        got, n = swapped(spark, [f"on {v}." for v in values])
        assert n == [1] * len(values) and len(set(got)) == len(values)
        for v, g in zip(values, got):
            datetime.datetime.strptime(g[3:-1], pattern if int(v[:2]) <= 12 or pattern != "%m/%d/%Y" else "%d/%m/%Y")
    got, n = swapped(spark, ["32.12.1999", "13/13/1999", "30.2.2000", "1.2.3.1999", "1/2/1999", "31.12.1999"])
    assert n == [0, 0, 0, 0, 1, 1] and got[:4] == ["32.12.1999", "13/13/1999", "30.2.2000", "1.2.3.1999"] and got[5] != "31.12.1999"


def test_keys(spark):
    """No key that others know: short ones are an error, and without one the session's own links equal values."""
    docs = spark.createDataFrame([(1, "card 4111111111111111"), (2, "4111111111111111 again")], "doc_id long, text string")
    for key in ("", "short"):
        with pytest.raises(ValueError, match="key"):
            pii.pseudonymise(docs, key)
    drawn = [re.search(r"\d{16}", r["text"])[0] for r in pii.pseudonymise(docs).collect()]
    keyed = [re.search(r"\d{16}", r["text"])[0] for r in pii.pseudonymise(docs, KEY).collect()]
    assert drawn[0] == drawn[1] != keyed[0] == keyed[1]


def mod97(t):
    return int("".join(str(int(c, 36)) for c in t)) % 97


def test_account_numbers(spark):
    """Both writings, letters among the digits, a word behind, check digits that are wrong, and a card behind letters."""
    values = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606", "BE68 5390 0754 7034"]
    got, n = swapped(spark, [f"pay {v} now" for v in values] + ["pay BE68 5390 0754 7034 EUR", "pay DE88 3704 0044 0532 0130 00", "AB12 4111 1111 1111 1111"])
    assert n[:6] == [1] * 6 and n[6:] == [0, 1]
    for v, g in zip(values, got, strict=False):
        new = g.removeprefix("pay ").removesuffix(" now")
        plain, old = new.replace(" ", ""), v.replace(" ", "")
        assert new != v and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", v) and mod97(plain[4:] + plain[:4]) == 1
        assert re.sub(r"\D", "", plain[4:]) == digits(re.sub(r"\D", "", old[4:]), "iban")
    assert got[0].replace(" ", "") == got[1].replace(" ", "")
    assert got[5] == got[4].replace("now", "EUR") and got[6].endswith("DE88 3704 0044 0532 0130 00")
    assert got[7] == "AB12 " + card("4111 1111 1111 1111")


def test_key_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "call 415-555-2671")], "doc_id long, text string")
    out = pii.pseudonymise(docs, KEY)
    out.collect()
    assert KEY not in out._jdf.queryExecution().toString() and KEY not in out._jdf.queryExecution().executedPlan().toString()
    shown = spark.sql("set").collect()
    pii.session_key(spark)
    assert all(r["value"] != spark.conf.get(pii.KEY) for r in shown)
    assert re.search("(?i)secret|password|token|access[.]?key", pii.KEY)
    with pytest.raises(ValueError):
        pii.pseudonymise(docs.withColumn("_pii_key", F.lit("x")), KEY)
