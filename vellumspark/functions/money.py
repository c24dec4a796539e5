"""Money and numbers as Column expressions on exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Currency markers and their codes.
CURRENCIES = {"€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "$": "USD", "usd": "USD", "us$": "USD", "£": "GBP", "gbp": "GBP", "chf": "CHF", "jpy": "JPY", "¥": "JPY"}


def parse_amount(c: Column | str, comma: bool | None = None) -> Column:
    """Exact amount of a text, or null. The last separator with one or two digits after it marks decimals; a lone one with three digits
    after it groups thousands, unless `comma` says which one marks decimals (True: comma, False: point)."""
    s = F.regexp_replace(F.regexp_replace(c, "[\\s  ']", ""), r"[^\d.,\-]", "")
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    s = F.replace(s, F.lit("-"), F.lit(""))
    both = s.contains(".") & s.contains(",")
    last = F.regexp_extract(s, r"([.,])[^.,]*$", 1)
    after = F.char_length(F.regexp_extract(s, r"[.,]([^.,]*)$", 1))
    seps = F.char_length(F.regexp_replace(s, r"[^.,]", ""))
    if comma is None:
        mark = F.when(both, last).when((seps == 1) & (after != 3), last).otherwise("")
    else:
        mark = F.lit("," if comma else ".")
    plain = F.when(mark == ",", F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(mark == ".", F.replace(s, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(s, "[.,]", ""))
    return (F.when(plain.rlike(r"^\d+(\.\d+)?$|^\.\d+$"), plain.try_cast("decimal(18,4)")) * sign).cast("decimal(18,4)")


def to_cents(c: Column | str) -> Column:
    """Whole cents, halves away from zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)") * 100, 0).cast("long")


def from_cents(c: Column | str) -> Column:
    return ((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)") / 100).cast("decimal(18,2)")


def format_money(c: Column | str, currency: str = "EUR", spanish: bool = True) -> Column:
    """1.234,50 € in Spanish, €1,234.50 in English; other codes stand for themselves."""
    sign = {v: k for k, v in reversed(CURRENCIES.items()) if len(k) == 1}.get(currency, currency)
    n = F.format_number((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"), 2)
    return F.concat(F.translate(n, ".,", ",."), F.lit(f" {sign}")) if spanish else F.concat(F.lit(sign), n)


def currency_of(c: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv]), F.lower(F.trim(c)))


def split_shares(df: DataFrame, group: list[str], total: str, weight: str, order: list[str], out: str = "share") -> DataFrame:
    """Whole cents of `total` by whole-number `weight` within each group: floors first, then a cent each to the largest remainders, ties by `order`."""
    w = W.partitionBy(*group)
    exact = F.col(total).cast("long") * F.col(weight).cast("long")
    df = df.withColumn("_sum", F.sum(F.col(weight).cast("long")).over(w)).withColumn("_rest", exact % F.col("_sum"))
    df = df.withColumn("_floor", F.call_function("div", exact - F.col("_rest"), F.col("_sum")))
    rank = F.row_number().over(w.orderBy(F.desc("_rest"), *order))
    left = F.col(total) - F.sum("_floor").over(w)
    return df.withColumn(out, F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).drop("_sum", "_floor", "_rest")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))
