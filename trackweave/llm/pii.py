"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

Card numbers, account numbers (IBAN), telephone numbers, IPv4 addresses, social security numbers, dates and the names in e-mail
addresses are found by one pattern, validated, and moved by a keyed Feistel permutation within their own
format: a card keeps its length, separators and a right check digit, an account its country, letters, length and right check digits, a date of 1900 to 2099 stays a date in its order of
day, month and year, an address an address. In a run of numbers that is no card as a whole, each card grouping, date,
social security and telephone number in it is tried by itself. Equal values get equal pseudonyms in every document; different ones stay different. What
doesn't validate (a long number without a right check digit) is left alone.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"
DATE = r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])|" + "|".join(rf"(?<![\d-])(?<!\d[./])\d\d?{s}\d\d?{s}(?:19|20)\d\d(?!\d|[./-]\d)" for s in (r"\.", "/", "-"))
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
#: Numbers one after another, among which there may be cards; it takes no digits of an address behind.
RUN = r"(?<![\d.-])\d[\d -]{11,}\d(?![\d-]|\.\d|[A-Za-z0-9._%+-]*@|[./]\d\d?[./]\d{4})"
#: An account number in groups of four or without spaces; the last group may be shorter.
GROUPS = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}"
IBAN = rf"{GROUPS}(?: ?[A-Z0-9]{{1,4}})?(?![A-Za-z0-9])"
PATTERN = "|".join((EMAIL, IBAN, DATE, SSN, IP, PHONE, RUN, CARD))
#: Cards as they are written. One of a kind may start at a number.
CARDS = (r"\d{13,19}", r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}", r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{3}", r"\d{4}([ -])\d{6}\2\d{5}", r"\d{4}([ -])\d{6}\2\d{4}")


def let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _noise(key: Column, tweak: str, i: Column, x: Column, modulus: Column) -> Column:
    """0 to modulus - 1 from the key, the format, the round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, tweak: str) -> Column:
    """A permutation of pairs (a, b), 0 <= a < size_a, 0 <= b < size_b: rounds add noise of one half to the other in turn."""
    def step(acc: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(F.pmod(acc.a + _noise(key, tweak, i, acc.b, size_a), size_a).alias("a"), acc.b.alias("b"))).otherwise(
            F.struct(acc.a.alias("a"), F.pmod(acc.b + _noise(key, tweak, i, acc.a, size_b), size_b).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _digits_permuted(digits: Column, key: Column, tweak: str) -> Column:
    """A string of up to 36 digits to another of the same length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    part = lambda s: F.coalesce(F.when(s != "", s).cast("bigint"), F.lit(0))
    out = feistel(part(F.substring(digits, F.lit(1), left)), part(F.substring(digits, left + 1, right)), power(left), power(right), key, tweak)
    return let(out, lambda o: F.concat(F.when(left > 0, F.lpad(o["a"].cast("string"), left, "0")).otherwise(""), F.lpad(o["b"].cast("string"), right, "0")))


def _into(shape: Column, digits: Column) -> Column:
    """The digits of `shape` replaced, in order; all else stays."""
    def places(d: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(d, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1))))
    return let(digits, lambda d: F.array_join(places(d), ""))


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits, the last one counted once; 0 modulo 10 if the check digit is right."""
    n = F.length(digits)
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = _digits_permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _into(m, let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))


def _mod97(text: Column) -> Column:
    """Digits and capital letters, A as 10 to Z as 35, as one number modulo 97."""
    def add(acc: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c)))


def _iban_holds(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "))
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def _iban(m: Column, key: Column) -> Column:
    """The digits behind the check digits are permuted, the check digits follow."""
    plain = F.replace(m, F.lit(" "))
    body = F.substring(plain, F.lit(5), F.length(plain))
    permuted = _digits_permuted(F.regexp_replace(body, "[^0-9]", ""), key, "iban")
    check = lambda d: F.lpad((98 - _mod97(F.concat(_into(body, d), F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    return let(permuted, lambda d: _into(m, F.concat(check(d), d)))


def _ip(m: Column, key: Column) -> Column:
    p = F.split(m, r"\.")
    n = [p[i].cast("int") for i in range(4)]
    out = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip")
    return let(out, lambda o: F.concat_ws(".", F.floor(o["a"] / 256).cast("int"), (o["a"] % 256).cast("int"), F.floor(o["b"] / 256).cast("int"), (o["b"] % 256).cast("int")))


def _date_read(m: Column) -> tuple[Column, Column, Column]:
    """The date or null, whether its month comes first, and whether that is against its separator's habit (month first with /, day first with . and -) as the other reading is none."""
    iso = m.rlike(r"^\d{4}")
    part = lambda i: F.lpad(F.regexp_extract(m, r"(\d+)\D(\d+)\D(\d+)", i), 2, "0")
    late = ~iso & F.when(m.contains("/"), part(1) > "12").otherwise(part(2) > "12")
    month_first = ~iso & (m.contains("/") != late)
    text = F.when(iso, m).when(month_first, F.concat_ws("-", F.substring(m, -4, 4), part(1), part(2))).otherwise(F.concat_ws("-", F.substring(m, -4, 4), part(2), part(1)))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), month_first, late


def _date(m: Column, key: Column) -> Column:
    """Within 1900-2099: 29 February to 29 February, other days to other days, those against the habit to days from the 13th on, so that no two dates meet."""
    read = F.struct(*(c.alias(n) for c, n in zip(_date_read(m), ("d", "month_first", "late"), strict=True)))
    return let(read, lambda r: let(_day(r["d"], r["late"], key), lambda o: F.when(m.rlike(r"^\d{4}"), F.date_format(o, "yyyy-MM-dd")).otherwise(_date_written(m, o, r["month_first"]))))


def _date_written(m: Column, day: Column, month_first: Column) -> Column:
    """With the separator of m, and with leading zeros unless m leaves one out."""
    two = lambda c: F.when(m.rlike(r"^\d\D|\D\d\D"), c.cast("string")).otherwise(F.lpad(c.cast("string"), 2, "0"))
    d, mo = two(F.dayofmonth(day)), two(F.month(day))
    between = F.substring(m, -5, 1)
    return F.concat(F.when(month_first, mo).otherwise(d), between, F.when(month_first, d).otherwise(mo), between, F.year(day).cast("string"))


def _day(d: Column, late: Column, key: Column) -> Column:
    year, leap = F.year(d), (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    first = F.lit("2001-01-01").cast("date")
    day = F.datediff(F.make_date(F.lit(2001), F.month(d), F.when(leap, 28).otherwise(F.dayofmonth(d))), first)
    placed = lambda y, n: F.make_date(y.cast("int"), F.month(F.date_add(first, n.cast("int"))), F.dayofmonth(F.date_add(first, n.cast("int"))))
    plain = let(feistel(year - 1900, day, F.lit(200), F.lit(365), key, "date"), lambda o: placed(1900 + o["a"], o["b"]))
    # days from the 13th on, counted without the first twelve of each month
    months = lambda n: sum((F.when(n >= c, 1).otherwise(0) for c in (19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)), F.lit(1))
    rest = let(feistel(year - 1900, day - 12 * F.month(d), F.lit(200), F.lit(221), key, "late"), lambda o: placed(1900 + o["a"], o["b"] + 12 * months(o["b"])))
    k = F.floor((year - 1904) / 4)
    feb = feistel(F.floor(k / 7), k % 7, F.lit(7), F.lit(7), key, "leap")
    return F.when(leap, let(feb, lambda f: F.make_date((1904 + 4 * (f["a"] * 7 + f["b"])).cast("int"), F.lit(2), F.lit(29)))).when(late, rest).otherwise(plain)


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999: a permutation of just these."""
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    rank = area - F.when(area > 666, 2).otherwise(1)
    out = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    def written(o: Column) -> Column:
        r = F.floor(o["a"] / 99)
        return F.concat_ws("-", F.lpad((r + F.when(r + 1 >= 666, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((o["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((o["b"] + 1).cast("string"), 4, "0"))
    return let(out, written)


def _email(m: Column, key: Column) -> Column:
    """The name before @ becomes as many letters of a keyed digest, and the domain a reserved one; no two names of up to 2**64 meet but by chance."""
    name = F.substring_index(m, "@", 1)
    digest = F.translate(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)).cast("binary"), 256), "0123456789", "ghijklmnop")
    return F.concat(F.substring(digest, F.lit(1), F.greatest(F.length(name), F.lit(12))), F.lit("@example.invalid"))


def kind(m: Column) -> Column:
    """Kind of a match that validates, else null."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    area = F.substring(m, 1, 3)
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(whole(IBAN), F.when(_iban_holds(m), F.lit("iban")))
        .when(whole(r"\d{4}-\d\d-\d\d|\d\d?([./-])\d\d?\1\d{4}"), F.when(_date_read(m)[0].isNotNull(), F.lit("date")))
        .when(whole(r"\d{3}-\d\d-\d{4}"), F.when(~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), F.lit("ssn")))
        .when(whole(r"\d{1,3}(\.\d{1,3}){3}"), F.lit("ip"))
        .when(whole(CARD), F.when(_luhn(digits) % 10 == 0, F.lit("card")))
        .when(whole(r"[\d -]{13,}") & ~whole(PHONE), F.lit(None))
        .when(F.length(digits) >= 7, F.lit("phone"))
    )


def pseudonym(m: Column, key: Column) -> Column:
    """m, if it validates, moved within its format; else m itself."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return let(kind(m), lambda k: (
        F.when(k == "card", _card(m, key)).when(k == "iban", _iban(m, key)).when(k == "ip", _ip(m, key)).when(k == "date", _date(m, key)).when(k == "ssn", _ssn(m, key))
        .when(k == "email", _email(m, key)).when(k == "phone", _into(m, _digits_permuted(digits, key, "phone"))).otherwise(m)
    ))


def resolved(m: Column, key: Column) -> Column:
    """A match with its pseudonyms as (text, n): of the whole, if it validates, else of the values in a run of numbers."""
    inner = [F.regexp_extract_all(m, F.lit(f"({CARD})"), F.lit(1)), *(F.regexp_extract_all(m, F.lit(rf"(?<!\d)(?=({c})(?!\d))"), F.lit(1)) for c in CARDS), F.regexp_extract_all(m, F.lit(f"({DATE}|{SSN}|{PHONE})"), F.lit(1)), F.regexp_extract_all(m, F.lit(f"({GROUPS})(?![A-Z0-9])"), F.lit(1))]
    def step(acc: Column, v: Column) -> Column:
        place = F.concat(F.lit(r"(?<!\d)"), v, F.lit(r"(?!\d)"))
        n = F.regexp_count(acc["text"], place)
        return F.when(n > 0, F.struct(F.regexp_replace(acc["text"], place, pseudonym(v, key)).alias("text"), (acc["n"] + n).alias("n"))).otherwise(acc)
    values = F.filter(F.array_distinct(F.concat(*inner)), lambda v: kind(v).isNotNull())
    within = F.aggregate(values, F.struct(m.alias("text"), F.lit(0).alias("n")), step)
    is_run = m.rlike(rf"^(?:[\d -]{{13,}}|{IBAN})$")
    return let(kind(m), lambda k: F.when(k.isNotNull() | ~is_run, F.struct(pseudonym(m, key).alias("text"), k.isNotNull().cast("int").alias("n"))).otherwise(within))


#: The session's setting with the secret key, 16 characters or more; without it a session draws its own, so that pseudonyms of different sessions don't link. Its name is one that
#: spark.redaction.regex covers by default.
KEY = "trackweave.pii.secret"


def session_key(spark: SparkSession) -> str:
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with the column _pii_key: a value of a local row that is joined, as plans show a local table's columns, but no values."""
    row = docs.sparkSession.sql("select * from values (:k) t(_pii_key)", args={"k": key})
    return docs.crossJoin(F.broadcast(row))


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """All columns of the table, `text` with pseudonyms, and n_pii (validated values found). key: secret, of 16 characters or more, else an error; that of the session if none is given.

    A null text stays null, with n_pii 0, and so does an empty one; texts are read whole; repeated rows stay repeated and get
    the same pseudonyms; an own column n_pii of the table is replaced, one named _pii_key is an error. The key stands in no plan.
    """
    key = session_key(docs.sparkSession) if key is None else key
    if len(key) < 16:
        raise ValueError("a key of 16 characters or more is needed: whoever has it can invert the pseudonyms")
    if "_pii_key" in docs.columns:
        raise ValueError("_pii_key is the operator's own column")
    t, columns, docs, key = F.col(text), docs.columns, keyed(docs, key), F.col("_pii_key")
    found = F.regexp_extract_all(t, F.lit(f"({PATTERN})"), F.lit(1))
    parts = F.split(t, PATTERN, -1)
    hit = t.contains("@") | t.rlike("[0-9]")  # in every match; a text without is left as it is
    done = F.transform(found, lambda m: resolved(m, key))
    joined = lambda x: F.array_join(F.zip_with(parts, F.concat(F.transform(x, lambda r: r["text"]), F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    out = let(done, lambda x: F.struct(joined(x).alias("text"), F.aggregate(x, F.lit(0), lambda n, r: n + r["n"]).alias("n")))
    docs = docs.withColumn("n_pii", F.when(hit, out))
    return docs.withColumns({"n_pii": F.coalesce(F.col("n_pii.n"), F.lit(0)).cast("bigint"), text: F.when(hit, F.col("n_pii.text")).otherwise(t)}).select(*(c for c in columns if c != "n_pii"), "n_pii")
