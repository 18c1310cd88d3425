"""Text functions as column expressions: Turkish case, folds, tokens, checksums, formats, simple repairs.

Case is translated before ``lower`` wherever a letter's lower form would depend on a locale or have two code points.
Word patterns carry (?U), as a word is a word in any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tr_lower(x: Column) -> Column:
    """Turkish lower case: I to dotless i, dotted capital I to i."""
    return F.lower(F.translate(x, "Iİ", "ıi"))


def fold(x: Column) -> Column:
    """Turkish letters to their ASCII neighbours."""
    return F.translate(x, "çğıöşü", "cgiosu")


def accents(x: Column) -> Column:
    """Accents on Latin letters that Turkish does not have."""
    return F.translate(x, "áàãäåéèêëíìïóòõúùýñ", "aaaaaeeeeiiiooouuyn")


def tokens(x: Column) -> Column:
    """Words of the lower-cased text, without the tags of anonymised addresses."""
    found = F.regexp_extract_all(tr_lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin("@user", "url"))


def repeats_folded(x: Column) -> Column:
    """Three or more of one letter become one."""
    return F.regexp_replace(x, r"(\p{L})\1{2,}", "$1")


def unspaced(x: Column) -> Column:
    """Three or more single letters with one space in between become one word."""
    return F.when(F.regexp_like(x, F.lit(r"(?<!\S)\p{L}(?: \p{L}){2,}(?!\S)")), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(?<!\S)\p{L}(?: \p{L}){2,}(?!\S)|(?s:.)"), F.lit(0)), lambda p: F.when(F.length(p) >= 5, F.replace(p, F.lit(" "), F.lit(""))).otherwise(p)), "")).otherwise(x)


def unpunctuated(x: Column) -> Column:
    """One word whose letters are all parted by the same sign."""
    shape = r"^\p{L}([.\-_,/+|])\p{L}(?:\1\p{L})+\1?$"
    return F.when(x.rlike(shape), F.regexp_replace(x, r"[.\-_,/+|]", "")).otherwise(x)


def phonetic(x: Column) -> Column:
    """q, w and x in a word that is otherwise of Turkish letters."""
    ok = x.rlike("[qwx]") & x.rlike(r"^(?:[abcçdefgğhıijklmnoöprsştuüvyzâîûqwx]|\P{L})+$")
    return F.when(ok, F.replace(F.translate(x, "qw", "kv"), F.lit("x"), F.lit("ks"))).otherwise(x)


def censored(x: Column) -> Column:
    """A masked word: letters, then stars or hashes, then letters."""
    return x.rlike(r"(?U)\p{L}+[*#]+\p{L}+")


def visible(x: Column) -> Column:
    """Control and format characters shown as their code."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)[\p{Cc}\p{Cf}\p{Mn}]|[^\p{Cc}\p{Cf}\p{Mn}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^[\p{Cc}\p{Cf}\p{Mn}]$"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(p))), F.lit("}"))).otherwise(p)), "")


def digits_of(x: Column) -> Column:
    return F.transform(F.split(x, ""), lambda c: c.cast("int"))


def tckn_valid(x: Column) -> Column:
    """Eleven digits, the first not 0; the tenth is 7 times the odd places' sum less the even places' sum, the eleventh the
    sum of ten, both modulo 10."""
    d = lambda i: F.substring(x, i, 1).cast("int")
    odd, even = sum(d(i) for i in (1, 3, 5, 7, 9)), sum(d(i) for i in (2, 4, 6, 8))
    ok = (F.pmod(odd * 7 - even, F.lit(10)) == d(10)) & ((odd + even + d(10)) % 10 == d(11))
    return F.when(F.coalesce(x.rlike(r"^[1-9]\d{10}$"), F.lit(False)), ok).otherwise(False)


def tckn_sums(n: Column) -> Column:
    """The two sums of ``tckn_valid`` for the last eleven digits of a whole number, in SQL's arithmetic: null stays null, no digit is
    ruled out, and a remainder has the sign of its dividend, so that a negative difference of the sums only fits a tenth digit 0."""
    base = {i: F.call_function("div", n, F.lit(10 ** (11 - i)).cast("long")) % 10 for i in range(1, 12)}
    odd, even = sum(base[i] for i in (1, 3, 5, 7, 9)), sum(base[i] for i in (2, 4, 6, 8))
    return ((odd * 7 - even) % 10 == base[10]) & ((odd + even + base[10]) % 10 == base[11])


def iban_valid(x: Column) -> Column:
    """A TR account number of 26 characters whose rearranged number is 1 modulo 97."""
    s = F.upper(F.regexp_replace(x, r"\s", ""))
    number = F.concat(F.substring(s, 5, 22), F.lit("2927"), F.substring(s, 3, 2)).cast("decimal(38,0)")
    return F.when(F.coalesce(s.rlike(r"^TR\d{24}$"), F.lit(False)), number % 97 == 1).otherwise(False)


def engine(source: Column) -> Column:
    """Which engine a source names before its channel."""
    module = F.substring_index(source, "@", 1)
    return F.when(module == "m1_lexicon", "lexicon").when(module.isin("m3_encoder", "m4_implicit", "m5_sarcasm"), "model").otherwise("rule")


def preview(x: Column, n: int = 96) -> Column:
    one = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, n - 1)), F.lit("…")))


def initials(x: Column) -> Column:
    """Up to two first letters, upper case."""
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def ago(seconds: Column) -> Column:
    return F.when(seconds < 60, "now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" d")))


def tr_number(x: Column, places: int = 1) -> Column:
    """Thousands by points, decimals by a comma."""
    return F.translate(F.format_number(x, places), ",.", ".,")


def clean_input(x: Column, most: int = 4000) -> Column:
    """Without control characters but tab and line end, trimmed, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(x, r"[\p{C}&&[^\t\n]]", "")), 1, most)


def valid_text(x: Column, most: int = 5000) -> Column:
    return F.coalesce((F.length(F.trim(x)) > 0) & (F.length(x) <= most), F.lit(False))


def valid_nickname(x: Column) -> Column:
    n = F.length(F.trim(x))
    return F.coalesce((n >= 1) & (n <= 32) & ~x.rlike(r"\p{Cntrl}"), F.lit(False))
