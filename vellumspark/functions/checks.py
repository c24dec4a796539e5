"""Check digits of identifiers as Column expressions: cards, accounts, tax numbers, articles and books. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control letters of national identity numbers, by remainder modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Control letters of company tax numbers, by control digit.
CIF_LETTERS = "JABCDEFGHI"
#: Account number lengths by country.
IBAN_LENGTHS = {"AD": 24, "AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "PL": 28, "PT": 25}


def compact(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s.\-/]", ""))


def digits(c: Column | str) -> Column:
    """The signs of a number's digits as integers."""
    return F.transform(F.regexp_extract_all(c if isinstance(c, Column) else F.col(c), F.lit(r"\d"), F.lit(0)), lambda d: d.cast("int"))


def weighted(ds: Column, odd: int, even: int) -> Column:
    """Sum of digits times `odd` at even places from 0 and `even` at odd places."""
    return F.aggregate(F.transform(ds, lambda d, i: d * F.when(i % 2 == 0, odd).otherwise(even)), F.lit(0), lambda a, x: a + x)


def luhn(c: Column | str) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(c, r"[\s\-]", ""))


def iban(c: Column | str) -> Column:
    s = compact(c)
    turned = F.concat(F.substring(s, F.lit(5), F.char_length(s)), F.substring(s, 1, 4))
    values = F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[0-9]"), x).otherwise((F.ascii(x) - 55).cast("string")))
    rest = F.aggregate(F.split(F.array_join(values, ""), ""), F.lit(0), lambda r, d: (r * 10 + F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))) % 97)
    size = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.char_length(s) == F.element_at(size, F.substring(s, 1, 2))) & (rest == 1)


def dni(c: Column | str) -> Column:
    s = compact(c)
    n = F.regexp_extract(s, r"^(\d{8})[A-Z]$", 1)
    return F.when(n == "", False).otherwise(F.substring(F.lit(DNI_LETTERS), F.try_to_number(n, F.lit("99999999")).cast("int") % 23 + 1, F.lit(1)) == F.substring(s, 9, 1))


def nie(c: Column | str) -> Column:
    s = compact(c)
    return s.rlike(r"^[XYZ]\d{7}[A-Z]$") & dni(F.concat(F.translate(F.substring(s, 1, 1), "XYZ", "012"), F.substring(s, 2, 8)))


def cif(c: Column | str) -> Column:
    s = compact(c)
    ds = digits(F.substring(s, 2, 7))
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 0, F.floor(d * 2 / 10).cast("int") + d * 2 % 10).otherwise(d)), F.lit(0), lambda a, x: a + x)
    control = (10 - total % 10) % 10
    last = F.substring(s, 9, 1)
    digit, letter = last == control.cast("string"), last == F.substring(F.lit(CIF_LETTERS), control + 1, F.lit(1))
    kind = F.substring(s, 1, 1)
    good = F.when(kind.isin(*"PQRSNW"), letter).when(kind.isin(*"ABEH"), digit).otherwise(digit | letter)
    return s.rlike(r"^[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]$") & good


def nif(c: Column | str) -> Column:
    """Any of the tax numbers, and those of persons without an identity number: K, L or M, seven digits and the letter of the digits."""
    s = compact(c)
    special = s.rlike(r"^[KLM]\d{7}[A-Z]$") & dni(F.concat(F.lit("0"), F.substring(s, 2, 8)))
    return dni(c) | nie(c) | cif(c) | special


def ean(c: Column | str) -> Column:
    """Article numbers of 8, 12, 13 or 14 digits: weights 1 and 3 from the right add up to a multiple of ten."""
    s = compact(c)
    return s.rlike(r"^(\d{8}|\d{12,14})$") & (weighted(F.reverse(digits(s)), 1, 3) % 10 == 0)


def isbn(c: Column | str) -> Column:
    """Book numbers of ten signs (weights 10 to 1, modulo 11, X is ten) or thirteen digits."""
    s = compact(c)
    parts = F.transform(F.split(s, ""), lambda x: F.when(x == "X", 10).when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(0))
    ten = F.aggregate(F.transform(parts, lambda d, i: d * (10 - i)), F.lit(0), lambda a, x: a + x) % 11 == 0
    return (s.rlike(r"^\d{9}[\dX]$") & ten) | (s.rlike(r"^97[89]\d{10}$") & ean(s))


def ups(c: Column | str) -> Column:
    """Parcel numbers 1Z and sixteen signs: letters count as their place in the alphabet plus two, modulo ten; every second sign doubles."""
    s = compact(c)
    value = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise((F.ascii(x) - 63) % 10)
    total = F.aggregate(F.transform(F.split(F.substring(s, 3, 15), ""), lambda x, i: value(x) * F.when(i % 2 == 1, 2).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return s.rlike("^1Z[0-9A-Z]{15}[0-9]$") & (((10 - total % 10) % 10).cast("string") == F.substring(s, 18, 1))


def s10(c: Column | str) -> Column:
    """Postal item numbers, two letters, nine digits, two letters: weighted sum modulo eleven, 10 standing for 0 and 11 for 5."""
    s = compact(c)
    weights = F.array(*[F.lit(w) for w in (8, 6, 4, 2, 3, 5, 9, 7)])
    total = F.aggregate(F.zip_with(digits(F.substring(s, 3, 8)), weights, lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    check = 11 - total % 11
    want = F.when(check == 10, 0).when(check == 11, 5).otherwise(check)
    return s.rlike("^[A-Z]{2}[0-9]{9}[A-Z]{2}$") & (want.cast("string") == F.substring(s, 11, 1))


def carrier(c: Column | str) -> Column:
    """What a parcel number's form and check digit say of its carrier; null where nothing."""
    s = compact(c)
    return F.when(ups(c), "ups").when(s10(c), "post").when(s.rlike(r"^\d{12}$"), "express").when(s.rlike(r"^JJD\d{12,}$"), "parcel")
