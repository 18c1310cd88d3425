"""PII: format-preserving keyed pseudonyms, in DataFrame functions only.

Validated values are replaced by values of the same format: the same value becomes the same pseudonym in every
document (under one key), different values stay different. Each kind is a set of pairs (x, y), x below a and y
below b, and a Feistel network of ``ROUNDS`` rounds, whose round function is SHA-256 over key, kind, round and
the other half, permutes that set. The kinds, their checks and their domains:

* card: 13 to 19 digits, whole, in groups of four, or of four, six and five, that pass the Luhn check; all but the last digit are
  permuted and the check digit is made anew;
* ssn: ddd-dd-dddd, area neither 000, 666 nor from 900, group not 00, serial not 0000; stays valid;
* phone: ten digits with separators, perhaps behind a country prefix; the last ten digits are permuted;
* ip: four numbers up to 255; the 32 bits are permuted;
* date: a day of the calendar from 1800 to 2199, yyyy-mm-dd or dd/mm/yyyy; the 146 097 days are permuted (189 times 773 pairs);
* email: letters and digits of the local part keep their class and case and are permuted, the domain stays.

What looks like one of these but fails its check is left as it is. Null texts stay null, empty ones empty; equal rows become equal rows; an empty table
stays empty; other columns pass through, whatever their names. The text is parted at the matches and joined again, so all else keeps every character.

The key is the session's ``spark.moderix.pii.key``: who has it can undo the pseudonyms. Where that is unset each driver process makes a random one, so values
are linked within its runs and not beyond.
"""

from __future__ import annotations

import secrets
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
CONF = "spark.moderix.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
ANY = "|".join((EMAIL, DATE, SSN, IP, CARD, PHONE))
#: Texts without any of this hold no value of any kind.
MAYBE = r"@|[0-9]{3}|[0-9]\.[0-9]"
DAYS, DAY_A, DAY_B, EPOCH = 146_097, 189, 773, "1800-01-01"


@cache
def _own_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(CONF, None) or _own_key()


def _num(x: Column) -> Column:
    return x.cast("long")


def _round(key: str, kind: Column, r: Column, other: Column) -> Column:
    """60 bits that depend on all of these."""
    said = F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), other.cast("string")).cast("binary"), 256)
    return _num(F.conv(F.substring(said, 1, 15), 16, 10))


def feistel(key: str, kind: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """struct(x, y): a keyed permutation of the pairs below (a, b)."""

    def step(acc: Column, r: Column) -> Column:
        m = F.when(r % 2 == 0, a).otherwise(b)
        return F.struct(acc["y"].alias("x"), F.pmod(acc["x"] + F.pmod(_round(key, kind, r, acc["y"]), m), m).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_num(x).alias("x"), _num(y).alias("y")), step)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _at(d: Column, start: int | Column, n: int | Column) -> Column:
    lit = lambda k: k if isinstance(k, Column) else F.lit(k)
    return F.substring(d, lit(start), lit(n))


def _pow10(n: Column) -> Column:
    return _num(F.rpad(F.lit("1"), n + 1, F.lit("0")))


def permuted_digits(key: str, kind: Column, d: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(d)
    u = (n / 2).cast("int")
    z = feistel(key, F.concat(kind, n.cast("string")), _num(_at(d, 1, u)), _num(_at(d, u + 1, n)), _pow10(u), _pow10(n - u))
    return F.transform(F.array(z), lambda p: F.concat(F.lpad(p["x"].cast("string"), u, F.lit("0")), F.lpad(p["y"].cast("string"), n - u, F.lit("0"))))[0]


def luhn_digit(d: Column) -> Column:
    """The digit that completes d."""

    def worth(i: Column) -> Column:
        k = _at(d, F.length(d) - i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(k > 9, k - 9).otherwise(k)

    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + worth(i))
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _fitted(v: Column, digits: Column) -> Column:
    """The last digits of v replaced in order by the given ones; all else stays."""
    skip = F.length(_digits(v)) - F.length(digits)

    def step(acc: Column, c: Column) -> Column:
        number = c.rlike("^[0-9]$")
        new = F.when(number & (acc["k"] >= skip), _at(digits, acc["k"] - skip + 1, 1)).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + F.when(number, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(v, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


def _one(x: Column, f) -> Column:  # noqa: ANN001
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def card(key: str, v: Column) -> Column:
    d = _digits(v)
    body = _at(d, 1, F.length(d) - 1)
    new = _one(permuted_digits(key, F.lit("card"), body), lambda p: F.concat(p, luhn_digit(p)))
    return F.when(luhn_digit(body) == _at(d, F.length(d), 1), _fitted(v, new)).otherwise(v)


def phone(key: str, v: Column) -> Column:
    d = _digits(v)
    return _fitted(v, permuted_digits(key, F.lit("phone"), _at(d, F.length(d) - 9, 10)))


def ssn(key: str, v: Column) -> Column:
    area, group, serial = (_num(_at(v, s, n)) for s, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    x = area - F.when(area > 666, 2).otherwise(1)
    z = feistel(key, F.lit("ssn"), x, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def out(p: Column) -> Column:
        a = p["x"] + F.when(p["x"] >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", a, (p["y"] / 9999).cast("long") + 1, p["y"] % 9999 + 1)

    return F.when(ok, _one(z, out)).otherwise(v)


def ip(key: str, v: Column) -> Column:
    o = F.transform(F.split(v, r"\."), _num)
    z = feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    out = lambda p: F.concat_ws(".", *(x.cast("string") for x in ((p["x"] / 256).cast("long"), p["x"] % 256, (p["y"] / 256).cast("long"), p["y"] % 256)))
    return F.when(F.forall(o, lambda k: k < 256), _one(z, out)).otherwise(v)


def date(key: str, v: Column) -> Column:
    iso = F.substring(v, 5, 1) == "-"
    day = F.coalesce(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(v, F.lit("dd/MM/yyyy")).cast("date"))
    at = F.datediff(day, F.to_date(F.lit(EPOCH)))
    z = feistel(key, F.lit("date"), (at / DAY_B).cast("long"), at % DAY_B, F.lit(DAY_A), F.lit(DAY_B))

    def out(p: Column) -> Column:
        new = F.date_add(F.to_date(F.lit(EPOCH)), (p["x"] * DAY_B + p["y"]).cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd/MM/yyyy"))

    return F.when((at >= 0) & (at < DAYS), _one(z, out)).otherwise(v)


def email(key: str, v: Column) -> Column:
    local = F.substring_index(v, "@", 1)
    u = (F.length(local) / 2).cast("int")
    low, high, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def shifted(text: Column, said: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = _num(F.conv(_at(said, F.pmod(i, F.lit(16)) * 4 + 1, 4), 16, 10))
            return F.when(c.rlike("^[a-z]$"), _move(low, c, by)).when(c.rlike("^[A-Z]$"), _move(high, c, by)).when(c.rlike("^[0-9]$"), _move(num, c, by)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(acc: Column, r: Column) -> Column:
        said = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), r.cast("string"), acc["y"]).cast("binary"), 256)
        return F.struct(acc["y"].alias("x"), shifted(acc["x"], said).alias("y"))

    start = F.struct(_at(local, 1, u).alias("x"), _at(local, u + 1, F.length(local)).alias("y"))
    z = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(z["x"], z["y"], F.lit("@"), F.substring_index(v, "@", -1))


def _move(alphabet: str, c: Column, by: Column) -> Column:
    return _at(F.lit(alphabet), F.pmod(F.position(c, F.lit(alphabet)) - 1 + by, F.lit(len(alphabet))) + 1, 1)


KINDS = ((EMAIL, email), (DATE, date), (SSN, ssn), (IP, ip), (CARD, card), (PHONE, phone))


def pseudonym(key: str, v: Column) -> Column:
    """The pseudonym of one matched value."""
    out = v
    for pattern, f in reversed(KINDS):
        out = F.when(v.rlike(f"^(?:{pattern})$"), f(key, v)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """docs with every validated value of the text replaced; count_col: a further column, how many were."""
    key = key or session_key(docs.sparkSession)
    t = F.col(f"`{text_col}`")
    old, new = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{x}{k}") not in docs.columns) for x in ("old", "new"))
    made = docs.withColumn(old, F.when(t.rlike(MAYBE), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    made = made.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda v: pseudonym(key, v))))
    woven = F.array_join(F.zip_with(F.split(t, ANY, -1), F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    made = made.withColumn(text_col, F.when(F.size(new) > 0, woven).otherwise(t))
    if count_col:
        changed = F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)
        made = made.withColumn(count_col, F.coalesce(F.size(changed), F.lit(0)).cast("long"))
    return made.drop(old, new)
