"""Personal data: format-preserving Feistel pseudonyms. SQL functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, text_of

ROUNDS = 10
#: Steps along a permutation until a value of a kind is met again; three of five are of that kind, so the steps suffice.
WALK = 60
#: The setting that names the key of a session.
KEY = "spark.fringelake.pii.key"
FIRST_DAY, DAYS = "1900-01-01", (250, 292)  # dates up to 2099-11-12
#: Candidates, in the order in which they are tried at one place. Each is validated before it is replaced. A group that may
#: repeat without end must be possessive: such groups are matched in a loop, others by recursion, which ends in an overflow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)++",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d.\-/])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![.\-/]?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![-]?\d)",
    "phone": r"(?<![\d+(])(?:(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}|\+1[ .-]?\d{3}[ .-]\d{3}|(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2})[ .-]\d{4}(?!\d)",
    "card": r"(?<![\d])\d(?:[ -]?\d){12,18}(?!\d)",
}
KINDS = tuple(PATTERNS)
#: Group references count within the whole pattern.
WHOLE = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _noise(key: str, tweak: str, number: Column, value: Column, modulus: Column) -> Column:
    """Keyed pseudo-random number under modulus: 60 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), number.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def permuted(value: Column, left: Column, right: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the numbers under left * right: an unbalanced Feistel network whose rounds add a function of
    one half to the other, modulo its size. Each round can be undone, so different values stay different."""

    def step(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        return F.when(i % 2 == 0, F.struct(F.pmod(a + _noise(key, tweak, i, b, left), left).alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), F.pmod(b + _noise(key, tweak, i, a, right), right).alias("b")))

    first = F.struct(F.pmod(F.floor(value / right), left).cast("long").alias("a"), F.pmod(value, right).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda h: h["a"] * right + h["b"])


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _fill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order; other characters stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(done: Column, c: Column) -> Column:
        number = c.between("0", "9")
        return F.struct(F.concat(done["out"], F.when(number, F.substring(digits, done["next"], F.lit(1))).otherwise(c)).alias("out"), (done["next"] + number.cast("int")).alias("next"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda d: d["out"])


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of all digits, counted from the right."""

    def step(t: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(t["odd"], 2).otherwise(1)
        return F.struct((t["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~t["odd"]).alias("odd"))

    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda t: t["sum"])


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, in halves; the last is set so that the number stays valid."""

    def body(d: Column) -> Column:
        n = F.length(d) - 1
        low = F.floor(n / 2)
        ten = lambda e: F.pow(F.lit(10.0), e).cast("long")
        moved = permuted(F.substring(d, F.lit(1), n).cast("long"), ten(n - low), ten(low), key, "card")
        text = F.lpad(moved.cast("string"), n, F.lit("0"))
        return let(text, lambda t: _fill(m, F.concat(t, F.pmod(10 - F.pmod(_luhn_sum(F.concat(t, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))))

    return let(_digits(m), lambda d: F.when((_luhn_sum(d) % 10 == 0) & (F.length(F.regexp_replace(d, F.substring(d, 1, 1), F.lit(""))) > 0), body(d)))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    fine = F.forall(parts, lambda x: x < 256)
    number = F.aggregate(parts, _long(0), lambda t, x: t * 256 + x)
    moved = permuted(number, _long(65536), _long(65536), key, "ip")
    return F.when(fine, let(moved, lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / (256 ** i)), F.lit(256)).cast("string") for i in (3, 2, 1, 0)])))


def _phone(m: Column, key: str) -> Column:
    """Area and exchange that begin with 2 to 9 do so before and after; where one of them does not, their first digits stay."""

    def body(d: Column) -> Column:
        area, exchange, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        valid = (area >= 200) & (exchange >= 200)
        moved = permuted(((area - 200) * 800 + exchange - 200) * 10000 + line, _long(640000), _long(10000), key, "phone")
        fine = let(moved, lambda x: F.concat((F.floor(x / 8000000) + 200).cast("string"), (F.pmod(F.floor(x / 10000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(x, F.lit(10000)).cast("string"), 4, "0")))
        other = permuted((F.pmod(area, F.lit(100)) * 100 + F.pmod(exchange, F.lit(100))) * 10000 + line, _long(10000), _long(10000), key, "line")
        rest = let(F.lpad(other.cast("string"), 8, "0"), lambda x: F.concat(F.substring(d, 1, 1), F.substring(x, 1, 2), F.substring(d, 4, 1), F.substring(x, 3, 6)))
        return F.when(valid, fine).otherwise(rest)

    ten = F.substring(_digits(m), F.length(_digits(m)) - 9, F.lit(10))
    country = F.when(F.length(_digits(m)) == 11, F.lit("1")).otherwise(F.lit(""))
    return _fill(m, F.concat(country, let(ten, body)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = (area - 1 - (area > 666).cast("long")) * 99 + group - 1
    moved = permuted(index * 9999 + serial - 1, _long(898 * 99), _long(9999), key, "ssn")

    def shown(x: Column) -> Column:
        first = F.floor(x / (9999 * 99)) + 1
        return F.concat_ws("-", F.lpad((first + (first >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(x / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(fine, let(moved, shown))


def _date(m: Column, key: str) -> Column:
    """Year first, or day and month before the year; with slashes the month comes first, or where that is no date, the day.
    Days since 1900 are permuted. A day that must come first with slashes, as no month has its number, stays one that must:
    the permutation is followed until it meets such a day again, so different dates stay different there too."""
    year_first = m.rlike(r"^\d{4}")
    mark = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    a, b, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    day = lambda y, month, d: F.try_to_date(F.concat_ws("-", y, month, d), "yyyy-MM-dd")
    first = F.lit(FIRST_DAY).cast("date")
    american = (mark == "/") & day(year, a, b).isNotNull()
    date = F.when(year_first, day(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))).when(american, day(year, a, b)).otherwise(day(year, b, a))
    size = DAYS[0] * DAYS[1]
    moved = lambda x: permuted(x, _long(DAYS[0]), _long(DAYS[1]), key, "date")
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    followed = lambda i: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(i), lambda x, _: F.when(late(x), x).otherwise(moved(x)))

    def shown(x: Column) -> Column:
        d = F.date_add(first, x.cast("int"))
        y, mm, dd = (F.date_format(d, p) for p in ("yyyy", "MM", "dd"))
        return F.when(year_first, F.concat(y, mark, mm, mark, dd)).when(american, F.concat(mm, mark, dd, mark, y)).otherwise(F.concat(dd, mark, mm, mark, y))

    def body(i: Column) -> Column:
        to = F.when(~year_first & ~american & (mark == "/"), followed(i)).otherwise(moved(i))
        return F.when((i >= 0) & (i < size), let(to, shown))

    return let(F.date_diff(date, first).cast("long"), body)


def _shifted(c: Column, by: Column) -> Column:
    """A letter or digit moved within its kind; other characters stay."""
    code, out = F.ascii(c), c
    for start, n in ((97, 26), (65, 26), (48, 10)):
        out = F.when((code >= start) & (code < start + n), F.char(F.pmod(code - start + by, F.lit(n)) + start)).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    """The part before the @ is permuted, the domain stays: a Feistel network over characters, whose rounds move the letters and
    digits of one half by a function of the other half and the domain. Each round can be undone, so different addresses
    stay different, and capital letters stay such: addresses that differ in these only get pseudonyms that do too."""
    at = F.instr(m, "@")
    name, domain = F.filter(F.split(F.substring(m, F.lit(1), at - 1), ""), lambda c: c != ""), F.substring(m, at, F.length(m))
    low = lambda x: F.lower(F.array_join(x, ""))

    def by(other: Column, i: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.lower(domain), low(other)), 256)

    def turned(half: Column, other: Column, i: Column) -> Column:
        noise = lambda d: F.transform(half, lambda c, at: _shifted(c, F.conv(F.substring(d, 2 * at + 1, F.lit(2)), 16, 10).cast("int")))
        return let(by(other, i), noise)

    def step(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        return F.when(i % 2 == 0, F.struct(turned(a, b, i).alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), turned(b, a, i).alias("b")))

    def body(c: Column) -> Column:
        half = F.ceil(F.size(c) / 2).cast("int")
        first = F.struct(F.slice(c, F.lit(1), half).alias("a"), F.slice(c, half + 1, F.size(c)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda h: F.array_join(F.concat(h["a"], h["b"]), ""))

    return F.concat(let(name, body), domain)


_REPLACE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    """Which pattern a candidate is of."""
    out = F.lit(KINDS[-1])
    for k, p in reversed(list(PATTERNS.items())[:-1]):
        own = p.replace(r"\2", r"\3").replace(r"\1", r"\2")
        out = F.when(m.rlike(f"^({own})$"), F.lit(k)).otherwise(out)
    return out


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting spark.fringelake.pii.key names. Without it a public key, with a warning: then anyone
    can undo the pseudonyms, which is fit for synthetic tables only."""
    key = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not key:
        warnings.warn(f"{KEY} is not set: pseudonyms are made with a public key and can be undone", stacklevel=2)
        key = "a public key for synthetic tables"
    return key


def pseudonymise(docs: DataFrame, key: str, found: str = "found") -> DataFrame:
    """docs (doc_id, text and whatever else) with personal data in text replaced, and a column `found`, whose name docs must not
    have: an array of the kinds replaced. An empty key raises ValueError.

    E-mail addresses, IPv4 addresses, calendar dates, social security numbers, North American phone numbers and Luhn-valid
    card numbers are validated; they are permuted within their format under the key, so equal values get one
    pseudonym in all documents, different values of one format different ones, and the result is valid too. Phone
    numbers in brackets or with +1 count whatever their first digits. Candidates that fail validation stay, and so do dates before
    1900-01-01 or after 2099-11-12. A day-first date with slashes has another pseudonym than its ISO form. Null text stays null, empty stays empty; rows are judged one by one, so repeated rows come as
    often as they are there; an empty table gives an empty result; all columns are kept.
    """
    if not key or found.lower() in {c.lower() for c in docs.columns}:
        raise ValueError("pseudonyms need a key" if not key else f"there is a column {found}")
    own = fresh(docs, "pieces")[0]
    text = text_of()
    pieces = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({WHOLE})".replace(r"\2", r"\3").replace(r"\1", r"\2")), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def replaced(m: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            out = F.lit(None).cast("string")
            for k, f in _REPLACE.items():
                out = F.when(kind == k, f(m, key)).otherwise(out)
            return F.struct(m.alias("raw"), kind.alias("kind"), out.alias("pseudonym"))

        return let(_kind(m), by_kind)

    out = docs.withColumn(own, F.transform(pieces, replaced))
    gaps = F.split("text", WHOLE, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, own, lambda g, m: F.array(g, F.coalesce(m["pseudonym"], m["raw"], F.lit(""))))), "")
    kinds = F.transform(F.filter(own, lambda m: m["pseudonym"].isNotNull()), lambda m: m["kind"])
    return out.withColumn("text", F.when(F.size(own) > 0, whole).otherwise(F.col("text"))).withColumn(found, kinds).drop(own)
