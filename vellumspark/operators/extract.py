"""Extraction from paperwork as relational steps: kinds, dates and their roles, periods, amounts, references, deadlines.

Texts are cut into lines once; rules are tables or column expressions over the folded lines, and each choice is an aggregate or a
window over what the rules found. Nothing leaves the JVM. A null text has no lines and yields no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import money, rules
from vellumspark.functions.text import fold


def needed(pattern: str) -> list[str] | None:
    """Words of which one stands in whatever a pattern matches, the longest of each alternative; None where an alternative has no fixed word.

    What is optional, a class, an escape or looks around is no fixed word; a group counts by its own alternatives where it must occur.
    """
    branches, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            i = pattern.index("]", i + 2)
        elif pattern[i] in "()":
            depth += 1 if pattern[i] == "(" else -1
        elif pattern[i] == "|" and depth == 0:
            branches.append(pattern[at:i])
            at = i + 1
        i += 1
    out: list[str] = []
    for b in [*branches, pattern[at:]]:
        word, found, i = "", [], 0
        while i < len(b):
            start, inner = i, None
            if b[i] == "\\":
                i += 2
            elif b[i] == "[":
                i = b.index("]", i + 2) + 1
            elif b[i] == "(":
                deep, i = 1, i + 1
                while deep:
                    if b[i] == "\\":
                        i += 1
                    elif b[i] == "[":
                        i = b.index("]", i + 2)
                    else:
                        deep += {"(": 1, ")": -1}.get(b[i], 0)
                    i += 1
                inner = b[start:i]
            else:
                i += 1
            least = 0 if b[i:i + 1] in ("?", "*") or b[i:i + 2] == "{0" else 1
            many = b[i:i + 1] in tuple("?*+{")
            if many:
                i = b.index("}", i) + 1 if b[i] == "{" else i + 1
                i += b[i:i + 1] in ("?", "+")
            if inner is None and len(b[start]) == 1 and re.fullmatch("[a-z0-9]", b[start]) and least:
                word += b[start]
                if not many:
                    continue
            found, word = [*found, [word]], ""
            if inner is not None and least and inner.startswith("(?:") and (own := needed(inner[3:-1])):
                found.append(own)
        found = [ws for ws in [*found, [word]] if min(map(len, ws)) >= 2]
        if not found:
            return None
        out += max(found, key=lambda ws: (min(map(len, ws)), -len(ws)))
    return sorted(set(out))


def holds(c: Column, pattern: str) -> Column:
    """Whether a text has a word that a pattern needs, which is much cheaper to see than a match; true where it needs none."""
    words = needed(pattern)
    return reduce(or_, [c.contains(w) for w in words]) if words else c.isNotNull()


def spots(c: Column, pattern: str) -> Column:
    """array<struct<start,end,raw>> of a pattern's matches in a text, positions from 0; a text without the words that the pattern needs isn't searched."""
    found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.char_length(x))

    def at(raw: Column, i: Column) -> Column:
        start = size(F.slice(gaps, F.lit(1), i + 1)) + size(F.slice(found, F.lit(1), i))
        return F.struct(start.alias("start"), (start + F.char_length(raw)).alias("end"), raw.alias("raw"))

    return F.when(holds(c, pattern), F.transform(found, at)).when(c.isNotNull(), F.array().cast("array<struct<start:int,end:int,raw:string>>"))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def tagged(c: Column, pattern: str, **tags) -> Column:
    """array<struct<start,end,raw,tags>> of a pattern's matches, each with the given literals."""
    return F.transform(spots(c, pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), *[F.lit(v).alias(k) for k, v in tags.items()]))


def last_label(c: Column, labels: list[tuple[str, str]]) -> Column:
    """struct<end,size,name,raw> of the label that ends last in a text, the longest of those; null where there is none."""
    found = F.concat(*[tagged(c, p, name=name) for name, p in labels])
    return F.array_max(F.transform(found, lambda s: F.struct(s["end"].alias("end"), (s["end"] - s["start"]).alias("size"), s["name"].alias("name"), s["raw"].alias("raw"))))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, line, f): the lines of each text from 0, as they are and folded."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("f", fold("line"))


def kinds(docs: DataFrame, id_col: str, text_col: str, trade_col: str | None = None) -> DataFrame:
    """(doc, kind, score, margin): weighted words of each kind, with what the issuer's trade adds.

    Scores that are close to the best are decided by the more specific kind; below the least score it is "other".
    """
    f = F.coalesce(fold(text_col), F.lit(""))
    trade = F.col(trade_col) if trade_col else F.lit(None).cast("string")

    def points(k: str) -> Column:
        """Each pattern of a kind is counted only where a word that it needs occurs."""
        own = [F.when(holds(F.col("f"), p), F.least(F.regexp_count(F.col("f"), F.lit(p)), F.lit(most)) * w).otherwise(0) for kind, w, most, p in rules.KINDS if kind == k]
        return reduce(add, own)

    df = docs.select(F.col(id_col).alias("doc"), f.alias("f"), trade.alias("trade")).select("doc", "f", "trade", *[points(k).alias(k) for k in rules.KIND_ORDER])

    def minus(k: str, *losses: tuple[int, Column]) -> Column:
        out = F.col(k)
        for n, when in losses:
            out = F.when(when, F.greatest(out - n, F.lit(0))).otherwise(out)
        return out

    pay, fine = F.col("payslip") >= 8, F.col("fine") >= 8
    changed = {"invoice": minus("invoice", (6, F.col("f").rlike(r"factura\s+simplificada"))), "tax": minus("tax", (6, pay)), "official": minus("official", (4, pay), (4, fine)), "vehicle": minus("vehicle", (3, fine))}
    df = df.select("doc", "trade", *[changed.get(k, F.col(k)).alias(k) for k in rules.KIND_ORDER])

    def plus(k: str) -> Column:
        out = F.col(k)
        for who, kind, bonus in rules.TRADE_BONUS:
            if kind == k:
                out = out + F.when((F.col("trade") == who) & ((F.col(k) > 0) | F.lit(k == "insurance")), bonus).otherwise(0)
        return out

    df = df.select("doc", *[plus(k).alias(k) for k in rules.KIND_ORDER])
    every = F.array(*[F.struct(F.col(k).alias("score"), F.lit(i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(rules.KIND_ORDER)])
    # each choice is a column of its own, so that it is made once a text and not once for each kind it is compared with
    df = df.select("doc", every.alias("every"), F.greatest(*rules.KIND_ORDER).alias("best"))
    close = F.filter("every", lambda x: (x["score"] >= F.col("best") - rules.CLOSE) & (x["score"] >= rules.LEAST_SCORE))
    won = F.array_min(F.transform(close, lambda x: F.struct(x["rank"].alias("rank"), x["kind"].alias("kind"), x["score"].alias("score"))))
    df = df.select("doc", "every", "best", won.alias("won"))
    second = F.array_max(F.transform(F.filter("every", lambda x: x["kind"] != F.col("won.kind")), lambda x: x["score"]))
    ranked = F.transform(F.sort_array("every", asc=False), lambda x: x["score"])
    other = F.col("best") < rules.LEAST_SCORE
    return df.select(
        "doc",
        F.when(other, "other").otherwise(F.col("won.kind")).alias("kind"),
        F.when(other, F.col("best")).otherwise(F.col("won.score")).cast("int").alias("score"),
        F.when(other, F.col("best") - F.get(ranked, F.lit(1))).otherwise(F.col("won.score") - second).cast("int").alias("margin"),
    )


_M = "(?:" + "|".join(rules.MONTHS) + ")[a-z]*"
#: Notations of a date, in one pattern, so that the leftmost and longest is found: year first, day first by numbers, day and month name, month name and day.
DATE = rf"(?<![\w/.-])(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})|\d{{1,2}}(?:\s+de)?\s+{_M}\.?(?:\s+(?:de|del))?,?\s+\d{{4}}|{_M}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})(?![\w/-])"


def date_of(raw: Column) -> Column:
    """The day that a notation means, day before month, years of two digits from 2000; null where there is no such day or it is not in 1990 to 2100."""
    months = F.create_map(*[F.lit(x) for kv in rules.MONTHS.items() for x in kv])

    def day(n: Column) -> Column:
        """Of a notation's numbers: year, month and day, or day, month and year, or day and year beside the name of a month."""
        at = lambda i: F.get(n, F.lit(i))
        named, iso = F.size(n) == 2, F.char_length(at(0)) == 4
        month = F.when(named, F.element_at(months, F.regexp_extract(raw, f"({'|'.join(rules.MONTHS)})", 1)).cast("string")).otherwise(at(1))
        year = F.when(named, at(1)).when(iso, at(0)).otherwise(at(2)).try_cast("int")
        rest = F.concat(F.lit("-"), month, F.lit("-"), F.when(iso & ~named, at(2)).otherwise(at(0)))
        full = lambda y: F.when(y.between(1990, 2100), F.try_to_date(F.concat(y.cast("string"), rest)))
        return once(F.when(year < 100, year + 2000).otherwise(year), full)

    return once(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), day)


def dates(ls: DataFrame) -> DataFrame:
    """(doc, n, start, end, raw, date) of `lines`: every date with its year."""
    return _dates(ls, "doc", "n")


def _dates(ls: DataFrame, *columns: str) -> DataFrame:
    """`dates` with these columns of their lines."""
    # the day is worked out within the array: as a column that is filtered on, it would be worked out again for the filter
    day = F.transform(spots(F.col("f"), DATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), date_of(s["raw"]).alias("date")))
    found = ls.where(F.col("f").rlike(r"\d{4}|\d[/.-]\d")).select(*columns, F.explode(F.filter(day, lambda s: s["date"].isNotNull())).alias("s"))
    return found.select(*columns, "s.start", "s.end", "s.raw", "s.date")


def date_roles(ls: DataFrame, window: int = 90, gap: int = 40, alone: int = 12) -> DataFrame:
    """(doc, n, start, date, raw, role, label, evidence): what each date is for.

    The role is that of the label that ends nearest before the date on its line, after the date before it; for a line's first date
    without one, of a label at the end of the line above. The second date of a range takes the role that goes with the first's.
    """
    row = W.partitionBy("doc", "n").orderBy("start")
    # dates are looked for in lines with the line above them, so that all is one shuffle by texts
    text = ls.where("doc IS NOT NULL").select("doc", "n", "line", "f", F.lag(F.trim("f")).over(W.partitionBy("doc").orderBy("n")).alias("above"))
    d = _dates(text, "doc", "n", "line", "f", "above").withColumn("before", F.lag("end").over(row))
    begin = F.greatest(F.col("start") - window, F.coalesce("before", F.lit(0)))
    d = d.withColumn("context", F.substring("f", begin + 1, F.col("start") - begin)).withColumn("own", last_label(F.col("context"), rules.ROLES))
    d = d.withColumn("own", F.when(F.char_length("context") - F.col("own.end") <= gap, F.col("own")))
    up = last_label(F.col("above"), rules.ROLES)
    d = d.withColumn("up", F.when(F.col("own").isNull() & F.col("before").isNull() & (F.char_length("above") <= 70), up))
    d = d.withColumn("up", F.when(F.char_length("above") - F.col("up.end") <= alone, F.col("up")))
    d = d.withColumn("label", F.coalesce("own.raw", "up.raw")).withColumn("role", F.coalesce("own.name", "up.name"))
    link = F.col("before").isNotNull() & F.substring("f", F.col("before") + 1, F.col("start") - F.col("before")).rlike(rules.RANGE)
    prev, first = F.lag("role").over(row), F.lag("context").over(row)
    plain = prev.isNull() | (prev == "issue")
    kind = F.when(first.rlike("periodo|facturacion|consumo|liquidacion|billing"), "period").otherwise("effect")
    # the range's own end first, then what it makes of its beginning
    d = d.withColumn("to", F.when(link, F.when(prev == "effect_from", "effect_to").when(prev == "period_from", "period_to").when(plain, F.concat(kind, F.lit("_to")))))
    begins = F.regexp_replace(F.lead("to").over(row), "_to$", "_from")
    role = F.coalesce("to", F.when(F.col("role").isNull() | (F.col("role") == "issue"), begins), "role")
    return d.select("doc", "n", "start", "date", "raw", role.alias("role"), F.trim("label").alias("label"), F.substring(F.trim("line"), 1, 170).alias("evidence"))


_WORDS = "|".join(sorted(rules.NUMBERS, key=len, reverse=True))
PERIOD = (
    rf"(?<![\w/.,-])(?:\d{{1,3}}|(?:{_WORDS})(?:\s+y\s+(?:{_WORDS}))?)(?:\s*\(\s*\d{{1,3}}\s*\))?\s*(?:(?:working|business|calendar|natural)\s+)?"
    r"(?:dias?|meses|mes|anos?|years?|months?|days?|semanas?|weeks?)\b(?:\s*(?:habiles|naturales|laborables|calendario|working|business|calendar))?"
)


def periods(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, start, n, unit, working, purpose, base, raw): periods in days, months or years, what for and from when.

    Purpose and base come from the words around, within the paragraph: the purpose whose word is nearest, the first base that is named.
    """
    paras = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(fold(text_col), "\n\n")).alias("para", "f"))
    p = paras.select("doc", "para", "f", F.explode(spots(F.col("f"), PERIOD)).alias("s"))
    word = F.regexp_extract("s.raw", rf"^(\d{{1,3}}|(?:{_WORDS})(?:\s+y\s+(?:{_WORDS}))?)", 1)
    numbers = F.create_map(*[F.lit(x) for kv in rules.NUMBERS.items() for x in kv])
    spoken = F.aggregate(F.split(word, r"\s+y\s+"), F.lit(0), lambda a, x: a + F.element_at(numbers, x))
    n = F.coalesce(F.try_to_number(F.when(word.rlike(r"^\d+$"), word), F.lit("999")).cast("int"), spoken)
    unit = F.regexp_extract("s.raw", r"(dia|mes|ano|year|month|day|semana|week)", 1)
    week = unit.isin("semana", "week")
    begin = F.greatest(F.col("s.start") - 160, F.lit(0))
    # a column of its own, so that it is cut out once and not for each rule
    p = p.select("doc", "para", "s", begin.alias("begin"), F.substring("f", begin + 1, F.col("s.end") + 200 - begin).alias("around"))
    begin, around = F.col("begin"), F.col("around")
    near = F.concat(*[tagged(around, pattern, i=i, name=name, bonus=bonus) for i, (name, bonus, pattern) in enumerate(rules.PURPOSES)])
    near = F.transform(near, lambda x: F.struct((F.abs(begin + x["start"] - F.col("s.start")) - x["bonus"]).alias("d"), x["i"].alias("i"), x["name"].alias("name")))
    base = F.lit("")
    for name, pattern in reversed(rules.BASES):
        base = F.when(around.rlike(pattern), name).otherwise(base)
    working = F.when(F.col("s.raw").rlike("habiles|laborables|working|business"), True).when(F.col("s.raw").rlike("naturales|calendario|calendar|natural"), False)
    out = p.select(
        "doc", "para", F.col("s.start").alias("start"), F.when(week, n * 7).otherwise(n).alias("n"),
        F.when(week | unit.isin("dia", "day"), "day").when(unit.isin("mes", "month"), "month").otherwise("year").alias("unit"),
        working.alias("working"), F.coalesce(F.array_min(near)["name"], F.lit("generic")).alias("purpose"), base.alias("base"), F.col("s.raw").alias("raw"), n.alias("_n"),
    )
    return out.where(F.col("_n").between(1, 120)).drop("_n")


_CUR = r"(?:€|eur(?:os?)?|usd|\$|£|gbp)"
_NUM = r"(?:\d{1,3}(?:[.,\s]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
MONEY = rf"(?:{_CUR}\s*)?{_NUM}(?!\d)(?:\s*{_CUR})?"


def value_of(raw: Column) -> Column:
    """The amount of a number with its currency marker: points mark decimals where only a marker stands before it, commas otherwise."""
    number = F.regexp_extract(raw, _NUM, 0)
    english = raw.rlike(rf"^{_CUR}") & ~raw.rlike(rf"{_CUR}$")
    return F.when(english, money.parse_amount(number, None)).otherwise(money.parse_amount(number))


def currency(raw: Column) -> Column:
    return F.coalesce(money.currency_of(F.regexp_extract(raw, _CUR, 0)), F.lit("EUR"))


def prices(ls: DataFrame) -> DataFrame:
    """(doc, n, start, amount, currency, raw): numbers with a currency marker, in reading order."""
    return _prices(ls).drop("f")


def _prices(ls: DataFrame) -> DataFrame:
    """`prices` with their lines. Lines without a marker or a digit aren't searched."""
    m = ls.where(F.col("f").rlike(_CUR) & F.col("f").rlike(r"\d")).select("doc", "n", "f", F.explode(spots(F.col("f"), MONEY)).alias("s")).where(F.col("s.raw").rlike(_CUR))
    return m.select("doc", "n", "s.start", value_of(F.col("s.raw")).alias("amount"), currency(F.col("s.raw")).alias("currency"), "s.raw", "f").where("amount < 1000000000")


def amounts(ls: DataFrame) -> DataFrame:
    """(doc, amount, currency, priority, label): the amount to pay of each document that has one.

    That after the strongest total label wins, the first of equals: the number that follows on the line and is no part of a date, a time
    or a share, or stands alone on the next line. Without a label it is the largest price on a line that names no tax or base.
    """
    nextline = F.lead("f").over(W.partitionBy("doc").orderBy("n"))
    text = ls.withColumn("below", nextline)
    clean = rf"(?<![/:\w-]){MONEY}(?![/:%\d])(?!\s*%)"
    found = text.select("doc", "n", "f", "below", F.explode(F.concat(*[tagged(F.col("f"), p, priority=k) for k, p in rules.TOTALS])).alias("s")).withColumn("priority", F.col("s.priority"))
    rest = F.expr("substring(f, s.end + 1)")
    before = F.expr("substring(f, greatest(s.start - 29, 1), least(s.start, 30))")
    found = found.select("n", "doc", "below", "s", "priority", rest.alias("rest"), before.alias("before"))
    found = found.withColumn("same", F.get(spots(F.col("rest"), clean), F.lit(0))).withColumn("alone", F.get(spots(F.col("below"), clean), F.lit(0)))
    rest, before, same, alone = (F.col(c) for c in ("rest", "before", "same", "alone"))
    use = F.when(same.isNotNull() & (same["start"] <= 60) & F.substring(rest, 1, 40).rlike(r"\d"), same["raw"]).when((F.char_length(F.trim("below")) <= 24) & (alone["start"] <= 3), alone["raw"])
    weak = (F.col("priority") <= 5) & before.rlike(rules.NO_TOTAL_BEFORE)
    labelled = found.where(~weak & ~rest.rlike(rules.NO_TOTAL_AFTER)).select("doc", use.alias("raw"), "priority", "n", F.col("s.start").alias("start"), F.col("s.raw").alias("label")).where("raw IS NOT NULL")
    labelled = labelled.select("doc", value_of(F.col("raw")).alias("amount"), currency(F.col("raw")).alias("currency"), "priority", "label", (-F.col("n")).alias("up"), (-F.col("start")).alias("left"))
    plain = _prices(ls).where(~F.expr("substring(f, 1, start)").rlike(rules.NO_TOTAL_BEFORE))
    plain = plain.select("doc", "amount", "currency", F.lit(0).alias("priority"), F.lit(None).cast("string").alias("label"), (-F.col("n")).alias("up"), (-F.col("start")).alias("left"))
    rank = F.struct("priority", F.when(F.col("priority") == 0, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,4)")).alias("a"), "up", "left")
    best = labelled.union(plain).groupBy("doc").agg(F.max_by(F.struct("amount", "currency", "priority", "label"), rank).alias("b"))
    return best.select("doc", "b.*")


def references(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, start, value, what, stable): reference numbers after their labels, each place once, under the first label that fits."""
    token = r"[a-z0-9][a-z0-9\-/._]{3,34}"
    df = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), fold(text_col).alias("f"))
    found = []
    for i, (label, what, stable) in enumerate(rules.REFERENCES):
        size = F.char_length(F.regexp_extract("s.raw", rf"^((?:{label})){token}$", 1))
        found.append((tagged(F.col("f"), rf"(?<![a-z0-9])(?:{label}){token}", what=what, stable=stable, rule=i), size))
    hit = df.select("doc", "text", F.explode(F.concat(*[x for x, _ in found])).alias("s"))
    # the label again, to know where the token begins
    skip = F.lit(0)
    for i, (_, size) in enumerate(found):
        skip = F.when(F.col("s.rule") == i, size).otherwise(skip)
    out = hit.select("doc", "text", "s", "s.what", "s.stable", "s.rule", (F.col("s.start") + skip).alias("start"))
    raw = F.regexp_replace(F.expr("substring(text, start + 1, s.end - start)"), r"[.\-_/]+$", "")
    out = out.withColumn("value", raw).where(F.col("value").rlike(r"\d") & (F.char_length("value") >= 4))
    first = W.partitionBy("doc", "start").orderBy("rule")
    return out.withColumn("k", F.row_number().over(first)).where("k = 1").select("doc", "start", "value", "what", "stable")


def choose_reference(refs: DataFrame, kind_of: DataFrame) -> DataFrame:
    """(doc, ref, series_ref): the reference that is preferred for the document's kind, and the one that stays the same across periods."""
    order = F.create_map(*[F.lit(x) for k, v in rules.REFERENCE_ORDER.items() for x in (k, v)])
    r = refs.join(kind_of.select("doc", "kind"), "doc").withColumn("rank", F.array_position(F.split(F.coalesce(F.element_at(order, F.col("kind")), F.lit(rules.ANY_REFERENCE)), " "), F.col("what")))
    r = r.withColumn("rank", F.when(F.col("rank") == 0, 99).otherwise(F.col("rank")))
    g = r.groupBy("doc").agg(F.min_by(F.struct("value", "stable"), F.struct("rank", "start")).alias("main"), F.min_by("value", F.when(F.col("stable") & F.col("what").isin("policy", "contract", "supply"), F.col("start"))).alias("other"))
    return g.select("doc", F.col("main.value").alias("ref"), F.when(F.col("main.stable"), F.col("main.value")).otherwise(F.col("other")).alias("series_ref"))


def first_by_role(roles: DataFrame) -> DataFrame:
    """(doc, days): a map from each role to its first date."""
    first = roles.groupBy("doc", F.coalesce("role", F.lit("none")).alias("role")).agg(F.min_by("date", F.struct("n", "start")).alias("date"))
    return first.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("role", "date"))).alias("days"))


def deadlines(kind_of: DataFrame, roles: DataFrame, relative: DataFrame, today: str) -> DataFrame:
    """(doc, key, kind, date): what a document asks for or ends, each (key, date) once, none before `today` but warranties.

    Manuals ask for nothing. A payment is due, an insurance renews (at its renewal, the end of its term, or a year after its start) and can
    be ended a month before; a contract's commitment ends at its date or after its period; a purchase has a warranty, of three years if
    the text names no other; an inspection and a document's validity end; a period to appeal or pay, in calendar days, months or years,
    runs from the notification or else from the day of issue. Periods in working days need the calendar and are left to it.
    """
    own = relative.groupBy("doc").agg(F.collect_list(F.struct("n", "unit", "working", "purpose", "base")).alias("periods"))  # those of one text
    d = kind_of.select("doc", F.col("kind").alias("_k")).where("_k <> 'manual'").join(first_by_role(roles), "doc", "left").join(own, "doc", "left")
    d = d.select("doc", "_k", "periods", *[F.element_at("days", r).alias(r) for r in [*dict(rules.ROLES), "period_to"]])
    k = F.col("_k")
    renews = F.coalesce("renewal", "effect_to", F.add_months("effect_from", 12))
    drafts = [
        ("payment", "payment", F.col("due"), k.isin("invoice", "bill", "subscription", "insurance", "receipt", "contract")),
        ("renewal", "renewal", renews, k == "insurance"), ("cancel_by", "cancel", F.add_months(renews, -1), k == "insurance"),
        ("renewal", "renewal", F.col("renewal"), k.isin("subscription", "contract")), ("permanence_end", "permanence", F.col("permanence_end"), k.isin("contract", "bill", "invoice")),
        ("expiry", "expiry", F.col("expiry"), k.isin("identity", "contract", "warranty", "vehicle")), ("itv", "inspection", F.col("itv_next"), k == "vehicle"),
        ("fine_discount", "fine", F.date_add(F.coalesce("notified", "issue"), 20), k == "fine"),
    ]
    fixed = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.when(ok, day).alias("date")) for key, kind, day, ok in drafts])
    bought = F.coalesce("delivery", "purchase", "issue")

    def ends(p: Column) -> Column:
        months = F.when(p["unit"] == "year", p["n"] * 12).otherwise(p["n"])
        base = F.when(p["base"] == "effect", F.col("effect_from")).when(p["base"] == "delivery", F.col("delivery"))
        base = F.coalesce(base, "notified", "issue", "purchase", "effect_from")
        end = F.when(p["unit"] == "day", F.when(~F.coalesce(p["working"], F.lit(True)), F.date_add(base, p["n"]))).otherwise(F.add_months(base, months))
        kind = F.when(p["purpose"].isin("appeal", "pay", "fine_pay") & k.isin("official", "tax", "fine"), p["purpose"]).when((p["purpose"] == "permanence") & k.isin("contract", "bill"), "permanence").when((p["purpose"] == "warranty") & k.isin("receipt", "invoice", "warranty"), "warranty")
        return F.struct(F.concat(kind, F.lit("_"), p["n"].cast("string"), p["unit"]).alias("key"), kind.alias("kind"), F.coalesce(F.when(kind == "warranty", F.add_months(bought, months)), end).alias("date"))

    periods = F.coalesce("periods", F.array().cast(own.schema["periods"].dataType))
    by_law = k.isin("receipt", "warranty") & ~F.exists(periods, lambda p: p["purpose"] == "warranty")
    law = F.array(F.struct(F.lit("warranty_36month").alias("key"), F.when(by_law, "warranty").alias("kind"), F.add_months(bought, 36).alias("date")))
    every = d.select("doc", F.explode_outer(F.concat(fixed, F.transform(periods, ends), law)).alias("x")).select("doc", "x.*").where("kind IS NOT NULL AND date IS NOT NULL")
    return every.where((F.col("kind") == "warranty") | (F.col("date") >= F.lit(today).cast("date"))).distinct()
