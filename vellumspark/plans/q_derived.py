"""Queries of extraction and scalar functions over texts that Spark writes from given rows, in several notations, and the SQL that knows what was written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import calendar, checks, formats, money, text
from vellumspark.operators import extract, mail, pieces
from vellumspark.session import table

from .q_calendar import _EASTER, YEARS, _cal_sql

MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
ENGLISH = "January February March April May June July August September October November December".split()


def _of(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), n)


def _spanish(amount: Column) -> Column:
    return F.translate(F.format_number(amount, 2), ".,", ",.")


def _papers(spark, sf):
    """One paper for each order: an invoice, an English invoice, a contract or an office's notice, by its key."""
    # a small file is one task's, and a paper takes much longer to read than its row, so rows are dealt to all cores
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("d")).repartition(4 * spark.sparkContext.defaultParallelism)
    d, k, key, total = F.col("d"), F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    due, n = F.date_add(d, 30), (F.col("o_orderkey") % 20 + 5).cast("string")
    named = lambda x, names, f: f(F.dayofmonth(x).cast("string"), _of(names, F.month(x)), F.year(x).cast("string"))
    es = lambda x: named(x, MONTHS, lambda a, b, c: F.concat_ws(" de ", a, b, c))
    us = lambda x: named(x, ENGLISH, lambda a, b, c: F.concat(b, F.lit(" "), a, F.lit(", "), c))
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    paper = (
        F.when(k == 0, join("FACTURA\nNº de factura: F-", key, "/2\nBase imponible e IVA al dorso\nFecha de emisión: ", F.date_format(d, "dd/MM/yyyy"), "\nFecha de vencimiento: ", es(due), "\nImporte total: ", _spanish(total), " €"))
        .when(k == 1, join("INVOICE\nInvoice number: INV-", key, "\nInvoice date: ", us(d), "\nDue date: ", F.date_format(due, "yyyy-MM-dd"), "\nAmount due: $", F.format_number(total, 2)))
        .when(k == 2, join("CONTRATO de mantenimiento\nCondiciones particulares\nNº de contrato: CTR-", key, "\nFecha de alta: ", F.date_format(d, "dd.MM.yyyy"), "\nCon una permanencia de ", n, " meses desde la activación."))
        .otherwise(join("NOTIFICACIÓN de una resolución\nExpediente: EX-", key, "/1\nNotificado el ", F.date_format(d, "d/M/yyyy"), "\n\nPuede presentar recurso de reposición o alegaciones en ", n, " días naturales."))
    )
    return o.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("trade"), paper.alias("text"))


_O = "o AS (SELECT o_orderkey AS doc, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 30 AS due, o_orderkey % 20 + 5 AS n, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS total FROM orders)"


def kinds(spark, sf):
    return extract.kinds(_papers(spark, sf), "id", "text", "trade").select("doc", "kind")


KINDS = f"WITH {_O} SELECT doc, ['invoice', 'invoice', 'contract', 'official'][k + 1] AS kind FROM o"


def _lines(spark, sf):
    return extract.lines(_papers(spark, sf), "id", "text")


def dates(spark, sf):
    return extract.dates(_lines(spark, sf)).select("doc", F.col("n").cast("long").alias("line"), "date")


DATES = f"""WITH {_O} SELECT doc, CAST(CASE k WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS BIGINT) AS line, d AS date FROM o
UNION ALL SELECT doc, CASE k WHEN 0 THEN 4 ELSE 3 END, due FROM o WHERE k < 2"""


def roles(spark, sf):
    return extract.date_roles(_lines(spark, sf)).select("doc", "date", "role")


ROLES = f"WITH {_O} SELECT doc, d AS date, ['issue', 'issue', 'effect_from', 'notified'][k + 1] AS role FROM o UNION ALL SELECT doc, due, 'due' FROM o WHERE k < 2"


def periods(spark, sf):
    return extract.periods(_papers(spark, sf), "id", "text").select("doc", F.col("n").cast("long").alias("n"), "unit", "working", "purpose", "base")


PERIODS = f"WITH {_O} SELECT doc, n, CASE k WHEN 2 THEN 'month' ELSE 'day' END AS unit, CASE k WHEN 3 THEN false END AS working, CASE k WHEN 2 THEN 'permanence' ELSE 'appeal' END AS purpose, CASE k WHEN 2 THEN 'effect' ELSE '' END AS base FROM o WHERE k >= 2"


def amounts(spark, sf):
    return extract.amounts(_lines(spark, sf)).select("doc", F.col("amount").cast("decimal(18,2)").alias("amount"), "currency", F.col("priority").cast("long").alias("priority"))


AMOUNTS = f"WITH {_O} SELECT doc, total AS amount, ['EUR', 'USD'][k + 1] AS currency, CAST([9, 10][k + 1] AS BIGINT) AS priority FROM o WHERE k < 2"


def prices(spark, sf):
    return extract.prices(_lines(spark, sf)).select("doc", F.col("n").cast("long").alias("line"), F.col("amount").cast("decimal(18,2)").alias("amount"), "currency")


PRICES = f"WITH {_O} SELECT doc, CAST([5, 4][k + 1] AS BIGINT) AS line, total AS amount, ['EUR', 'USD'][k + 1] AS currency FROM o WHERE k < 2"


def references(spark, sf):
    return extract.references(_papers(spark, sf), "id", "text").select("doc", "value", "what", "stable")


_REF = "['F-' || doc || '/2', 'INV-' || doc, 'CTR-' || doc, 'EX-' || doc || '/1'][k + 1]"
REFERENCES = f"WITH {_O} SELECT doc, {_REF} AS value, ['invoice', 'invoice', 'contract', 'expedient'][k + 1] AS what, k = 2 AS stable FROM o"


def chosen(spark, sf):
    p = _papers(spark, sf)
    return extract.choose_reference(extract.references(p, "id", "text"), extract.kinds(p, "id", "text", "trade"))


CHOSEN = f"WITH {_O} SELECT doc, {_REF} AS ref, CASE k WHEN 2 THEN {_REF} END AS series_ref FROM o"


def deadlines(spark, sf):
    from .q_extract import _settled

    p = _papers(spark, sf)
    kind_of = _settled(spark, extract.kinds(p, "id", "text", "trade"), "kinds")
    found, relative = _settled(spark, extract.date_roles(_lines(spark, sf)), "roles"), _settled(spark, extract.periods(p, "id", "text"), "periods")
    return extract.deadlines(kind_of, found, relative, "1990-01-01").select("doc", "key", "date")


DEADLINES = f"""WITH {_O} SELECT doc, 'payment' AS key, due AS date FROM o WHERE k < 2
UNION ALL SELECT doc, CASE k WHEN 2 THEN 'permanence_' || n || 'month' ELSE 'appeal_' || n || 'day' END, CASE k WHEN 2 THEN CAST(d + to_months(CAST(n AS INT)) AS DATE) ELSE d + CAST(n AS INT) END FROM o WHERE k >= 2"""


def easter(spark, sf):
    """Easter of two centuries and of every other year in which orders came."""
    came = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("y")).where("y IS NOT NULL")
    y = came.union(spark.range(1900, 2100)).distinct()
    return y.select("y", calendar.easter(F.col("y").cast("int")).alias("easter"))


EASTER = f"""SELECT y, easter FROM ({_EASTER.format(a=1900, b=2100)})
UNION SELECT y, easter FROM ({_EASTER.format(a=1583, b=4100)}) WHERE y IN (SELECT year(o_orderdate) FROM orders)"""


def order_days(spark, sf):
    """The working-day calendar of the days on which orders came, with their number."""
    n = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return calendar.calendar(spark, *YEARS, "ES-VC").join(n, "day")


ORDER_DAYS = f"WITH {_cal_sql()} SELECT cal.*, n.orders FROM cal JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) n USING (day)"


def ids(spark, sf):
    """Identity, card, article and account numbers written from customer keys, every other one with a wrong check."""
    c = table(spark, sf, "customer").select("c_custkey")
    k, off = F.col("c_custkey"), F.col("c_custkey") % 2
    digits = lambda s: F.transform(F.split(s, ""), lambda x: x.cast("int"))
    total = lambda s, f: F.aggregate(F.transform(digits(s), f), F.lit(0), lambda a, x: a + x)
    number = (k * 7919 % 100000000).cast("long")
    nif = F.concat(F.lpad(number.cast("string"), 8, "0"), F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), ((number + off) % 23 + 1).cast("int"), F.lit(1)))
    card = F.concat(F.lit("4539"), F.lpad((k * 104729 % 100000000000).cast("string"), 11, "0"))
    luhn = (10 - total(card, lambda x, i: F.when(i % 2 == 0, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)) % 10) % 10
    article = F.concat(F.lit("840"), F.lpad((k * 6151 % 1000000000).cast("string"), 9, "0"))
    ean = (10 - total(article, lambda x, i: F.when(i % 2 == 1, x * 3).otherwise(x)) % 10) % 10
    account = F.concat(F.lit("21000418"), F.lpad((k * 15485863 % 1000000000000).cast("string"), 12, "0"))
    iban = 98 - (F.concat(account, F.lit("142800")).cast("decimal(38,0)") % 97).cast("int")
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    rows = F.array(
        row("nif", nif), row("luhn", F.concat(card, ((luhn + off) % 10).cast("string"))), row("ean", F.concat(article, ((ean + off) % 10).cast("string"))),
        row("iban", F.concat(F.lit("ES"), F.lpad(((iban + off - 2) % 97 + 2).cast("string"), 2, "0"), account)),
    )
    d = c.select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", "r.*")
    ok = F.when(F.col("kind") == "luhn", checks.luhn("value")).when(F.col("kind") == "iban", checks.iban("value")).when(F.col("kind") == "nif", checks.nif("value")).otherwise(checks.ean("value"))
    return d.select("c_custkey", "kind", ok.alias("ok"))


IDS = """WITH c AS (SELECT c_custkey, c_custkey % 2 AS off FROM customer)
SELECT c_custkey, kind, off = 0 AS ok FROM c, (VALUES ('nif'), ('luhn'), ('ean'), ('iban')) AS t(kind)"""


def parse_amounts(spark, sf):
    """Prices of lines in four notations."""
    li, n = table(spark, sf, "lineitem"), F.col("l_linenumber") % 4
    plain = F.format_number("l_extendedprice", 2)
    raw = F.when(n == 0, plain).when(n == 1, F.concat(_spanish(F.col("l_extendedprice")), F.lit(" €"))).when(n == 2, F.translate(plain, ",.", " ,")).otherwise(F.concat(F.lit("-"), _spanish(F.col("l_extendedprice"))))
    return li.select("l_orderkey", "l_linenumber", money.parse_amount(raw).alias("amount"))


PARSE_AMOUNTS = "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) * CASE l_linenumber % 4 WHEN 3 THEN -1 ELSE 1 END AS DECIMAL(18,4)) AS amount FROM lineitem"


def contacts(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    post = F.when(even, F.concat(F.lit("Cust <A.Cust"), k, F.lit("+news@GMail.com>"))).otherwise(F.concat(F.lit("C"), k, F.lit("@Example.ORG")))
    phone = F.when(even, F.concat(F.lit("600 "), F.regexp_replace(F.lpad(k, 6, "0"), "^(...)", "$1 "))).otherwise(F.concat(F.lit("+44 (20) 7"), F.lpad(k, 7, "0")))
    return c.select("c_custkey", text.email(post).alias("email"), text.phone(phone).alias("number"))


CONTACTS = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'acust' || c_custkey || '@gmail.com' ELSE 'c' || c_custkey || '@example.org' END AS email,
CASE WHEN c_custkey % 2 = 0 THEN '+34600' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE '+44207' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS number FROM customer"""


def spoken(spark, sf):
    """Days said from the shipping day on, in sixteen ways: by date, in so many days, weeks or months, by day of the week or month, or not at all."""
    day, line = F.to_date("l_shipdate"), F.col("l_orderkey") + F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    text, due = q.cast("string"), F.date_add(day, q)
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    ways = [
        F.date_format(due, "yyyy-MM-dd"), join("el ", F.date_format(due, "d/M/yyyy")), join("en ", text, " días"), join("dentro de ", text, " semanas"), join("in ", text, " days"), join("in ", text, " months"), F.lit("dentro de dos semanas"), F.lit("in one month"),
        F.lit("pasado mañana"), F.lit("mañana por la mañana"), F.lit("hoy"), F.lit("el viernes"), F.lit("next thursday"), join("el día ", ((q - 1) % 28 + 1).cast("string")), F.lit("fin de mes"), F.when(q % 2 == 0, "por la mañana").otherwise("algún día"),
    ]
    said = F.lit(None).cast("string")
    for i, way in enumerate(ways):
        said = F.when(line % 16 == i, way).otherwise(said)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", formats.spoken_date(said, day).alias("day"))


SPOKEN = """
WITH l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 16 AS way, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE way WHEN 0 THEN d + q WHEN 1 THEN d + q WHEN 2 THEN d + q WHEN 3 THEN d + 7 * q WHEN 4 THEN d + q WHEN 5 THEN d + to_months(q) WHEN 6 THEN d + 14 WHEN 7 THEN d + to_months(1)
  WHEN 8 THEN d + 2 WHEN 9 THEN d + 1 WHEN 10 THEN d WHEN 11 THEN d + CAST(1 + (11 - isodow(d)) % 7 AS INT) WHEN 12 THEN d + CAST(1 + (10 - isodow(d)) % 7 AS INT)
  WHEN 13 THEN date_trunc('month', d + to_months(CASE WHEN (q - 1) % 28 + 1 >= day(d) THEN 0 ELSE 1 END)) + to_days((q - 1) % 28) WHEN 14 THEN last_day(d) END AS DATE) AS day FROM l"""


def quantities(spark, sf):
    li, n = table(spark, sf, "lineitem"), F.col("l_linenumber") % 3
    plain = F.format_number("l_extendedprice", 2)
    raw = F.when(n == 0, plain).when(n == 1, F.translate(plain, ".,", ",.")).otherwise(F.translate(plain, ",.", " ,"))
    return li.select("l_orderkey", "l_linenumber", formats.quantity(raw).alias("amount"))


QUANTITIES = "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM lineitem"


def fiscal(spark, sf):
    o, d = table(spark, sf, "orders"), F.to_date("o_orderdate")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Ejercicio "), (F.year(d) - 1).cast("string"), F.lit(", cuota"))).otherwise(F.lit("sin año"))
    return o.select("o_orderkey", formats.fiscal_year(said, d).alias("year"))


FISCAL = "SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS year FROM orders"


def versions(spark, sf):
    """Parts in the order of version numbers made of their sizes and keys, some of them release candidates."""
    k = F.col("p_partkey")
    v = F.concat(F.concat_ws(".", F.col("p_size").cast("string"), (k % 12).cast("string"), (k % 7).cast("string")), F.when(k % 3 == 0, F.concat(F.lit("-rc."), (k % 13).cast("string"))).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", F.rank().over(W.partitionBy("p_size").orderBy(formats.version_key(v))).cast("long").alias("place"))


VERSIONS = "SELECT p_partkey, rank() OVER (PARTITION BY p_size ORDER BY p_partkey % 12, p_partkey % 7, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 13 ELSE 99 END) AS place FROM part"


def addresses(spark, sf):
    k = F.col("c_custkey")
    octets = [_of("10 172 192 127 169 100 224 255 0 8 203".split(), (k % 11 + 1).cast("int")), F.when(k % 11 == 2, F.when(k % 2 == 0, "168").otherwise("167")).when(k % 11 == 4, "254").otherwise((k * 7 % 256).cast("string")), (k % 200).cast("string"), (k % 250).cast("string")]
    return table(spark, sf, "customer").select("c_custkey", formats.address_class(F.concat_ws(".", *octets)).alias("kind"))


ADDRESSES = """WITH c AS (SELECT c_custkey, [10, 172, 192, 127, 169, 100, 224, 255, 0, 8, 203][c_custkey % 11 + 1] AS a, CASE WHEN c_custkey % 11 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 168 ELSE 167 END WHEN c_custkey % 11 = 4 THEN 254 ELSE c_custkey * 7 % 256 END AS b, c_custkey % 200 AS x, c_custkey % 250 AS y FROM customer)
SELECT c_custkey, CASE WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link_local' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'shared'
WHEN a = 224 THEN 'multicast' WHEN a = 0 AND b + x + y = 0 THEN 'unspecified' WHEN a = 0 OR a >= 240 THEN 'reserved' ELSE 'public' END AS kind FROM c WHERE c_custkey % 11 <> 8"""


def addresses_query(spark, sf):
    return addresses(spark, sf).where("c_custkey % 11 <> 8")


_SMALL, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстуввхуз", "αβψδεφγηιξκλμνοπρρστθωωχυζ"


def scripts(spark, sf):
    """The script of each document, German ones put into Cyrillic letters and Spanish ones into Greek."""
    t = F.when(F.col("lang") == "de", F.translate(F.lower("text"), _SMALL, _CYRILLIC)).when(F.col("lang") == "es", F.translate(F.lower("text"), _SMALL, _GREEK)).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", formats.script(t).alias("script"))


_RE2 = {"latin": "Latin", "cyrillic": "Cyrillic", "greek": "Greek", "arabic": "Arabic", "hebrew": "Hebrew", "cjk": "Han", "kana": "Hiragana", "kata": "Katakana", "ko": "Hangul", "devanagari": "Devanagari", "thai": "Thai"}
_SCRIPTS = list(formats.SCRIPTS)
#: Letters counted by script, Han with kana where there is kana; of equal counts the first script; a null text has none.
SCRIPTS = rf"""
WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN translate(lower(text), '{_SMALL}', '{_CYRILLIC}') WHEN lang = 'es' THEN translate(lower(text), '{_SMALL}', '{_GREEK}') ELSE text END AS t FROM documents),
c AS (SELECT doc_id, t, {", ".join(rf"len(regexp_extract_all(t, '\p{{{v}}}')) AS {k}" for k, v in _RE2.items())} FROM d),
n AS (SELECT * REPLACE (CASE WHEN kana + kata > 0 THEN 0 ELSE cjk END AS cjk), CASE WHEN kana + kata > 0 THEN kana + kata + cjk ELSE 0 END AS ja FROM c),
m AS (SELECT *, greatest({", ".join(_SCRIPTS)}) AS most FROM n)
SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN regexp_matches(regexp_replace(t, '\p{{Latin}}', '', 'g'), '\p{{L}}') THEN CASE WHEN most = 0 THEN '' {" ".join(f"WHEN {k} = most THEN '{k}'" for k in _SCRIPTS)} END
  WHEN latin > 0 THEN 'latin' ELSE '' END AS script FROM m"""


def unwrapped(spark, sf):
    raw = F.concat(F.lit("https://r.example/x?a=1&url="), F.url_encode("url"))
    return table(spark, sf, "pages").select("page_id", text.unwrap(raw).alias("target"))


UNWRAPPED = "SELECT page_id, url AS target FROM pages"


def parcels(spark, sf):
    """Postal parcel numbers written from order keys, every third with a wrong check digit."""
    k = F.col("o_orderkey")
    number = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")
    weights = [8, 6, 4, 2, 3, 5, 9, 7]
    total = sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    check = 11 - total % 11
    check = F.when(check == 10, 0).when(check == 11, 5).otherwise(check)
    raw = F.concat(F.lit("RB"), number, F.when(k % 3 == 0, (check + 1) % 10).otherwise(check).cast("string"), F.lit("GB"))
    return table(spark, sf, "orders").select("o_orderkey", checks.carrier(raw).alias("carrier"))


PARCELS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'post' END AS carrier FROM orders"


def spots(spark, sf):
    """Where an address and an identity number stand in a letter to each customer."""
    k = F.col("c_custkey")
    number = k * 7919 % 100000000
    dni = F.concat(F.lpad(number.cast("string"), 8, "0"), F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (number % 23 + 1).cast("int"), F.lit(1)))
    letter = F.concat(F.lit("Escriba a c"), k.cast("string"), F.lit("@correo.example, titular "), dni, F.lit(" desde hoy."))
    d = table(spark, sf, "customer").select(k.alias("id"), letter.alias("text"))
    return pieces.personal(d, "id", "text").select("doc", "kind", F.col("start").cast("long").alias("begin"), F.col("end").cast("long").alias("finish"))


SPOTS = """WITH c AS (SELECT c_custkey AS doc, 26 + length(CAST(c_custkey AS VARCHAR)) AS e FROM customer)
SELECT doc, 'email' AS kind, CAST(10 AS BIGINT) AS begin, CAST(e AS BIGINT) AS finish FROM c UNION ALL SELECT doc, 'dni', CAST(e + 10 AS BIGINT), CAST(e + 19 AS BIGINT) FROM c"""


def mails(spark, sf):
    """A message for each order: an invoice with its PDF, an advertisement, a photograph of paper, small talk."""
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    one = lambda name, size, mime: F.array(F.struct(F.lit(name).alias("name"), F.lit(size).cast("bigint").alias("size"), F.lit(mime).alias("mime"), F.concat(F.lit("s"), key).alias("sha")))
    none = F.lit(None).cast("array<struct<name:string,size:bigint,mime:string,sha:string>>")
    m = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 0, F.concat(F.lit("Su factura "), key)).when(k == 1, F.lit("Rebajas: 40 % de descuento")).when(k == 2, F.lit("Fotos del recibo")).otherwise(F.concat(F.lit("Hola "), key)).alias("subject"),
        F.when(k == 0, F.lit("Total factura 12 €")).when(k == 1, F.lit("Newsletter. Para darte de baja pulsa aquí.")).when(k == 2, F.lit("Te lo mando")).otherwise(F.lit("¿Comemos el jueves?")).alias("text"),
        F.lit("ana@correo.example").alias("sender"), F.lit(None).cast("string").alias("trade"), (F.col("o_orderkey") % 8 == 4).alias("from_self"),
        F.when(k == 0, one("factura.pdf", 90_000, "application/pdf")).when(k == 2, one("foto.jpg", 200_000, "image/jpeg")).otherwise(none).alias("attachments"),
    )
    return mail.classify(m).select("doc", "kind", "attachments")


MAILS = "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 8 = 4 THEN 'noise' ELSE ['doc', 'noise', 'maybe', 'noise'][o_orderkey % 4 + 1] END AS kind, CAST(CASE WHEN o_orderkey % 8 = 4 THEN 0 ELSE [1, 0, 1, 0][o_orderkey % 4 + 1] END AS BIGINT) AS attachments FROM orders"


def sections(spark, sf):
    note = F.concat(F.lit("# "), F.col("c_name"), F.lit("\n"), F.col("c_mktsegment"), F.lit("\n```\n# no heading\n```\n## Balance ##\n"), F.col("c_custkey").cast("string"))
    s = pieces.sections(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), note.alias("text")), "id", "text")
    return s.select("doc", F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), "title", F.char_length("text").cast("long").alias("size"))


SECTIONS = """SELECT c_custkey AS doc, CAST(1 AS BIGINT) AS section, CAST(1 AS BIGINT) AS level, c_name AS title, CAST(length(c_name) + length(c_mktsegment) + 24 AS BIGINT) AS size FROM customer
UNION ALL SELECT c_custkey, 2, 2, 'Balance', CAST(14 + length(CAST(c_custkey AS VARCHAR)) AS BIGINT) FROM customer"""


def markdown(spark, sf):
    raw = F.concat(F.lit("# "), F.col("c_name"), F.lit("\n\n> *quoted* **"), F.col("c_mktsegment"), F.lit("** `code`\n- [link](http://x.example/"), F.col("c_custkey").cast("string"), F.lit(")"))
    return table(spark, sf, "customer").select("c_custkey", text.markdown_plain(raw).alias("plain"))


MARKDOWN = "SELECT c_custkey, c_name || chr(10) || chr(10) || 'quoted ' || c_mktsegment || ' code' || chr(10) || 'link' AS plain FROM customer"


def front(spark, sf):
    """Notes on customers: with a title and a language, with a title only, and with a block that stands too late or is none."""
    n, title = F.col("c_custkey") % 4, F.concat(F.lit("---\ntitle: "), F.col("c_name"))
    full = F.concat(title, F.lit("\nlang: "), F.lower("c_mktsegment"), F.lit("\n---\nbody"))
    note = F.when(n == 0, full).when(n == 1, F.concat(title, F.lit("\n---"))).when(n == 2, F.concat(F.lit("no block "), F.col("c_name"))).otherwise(F.concat(F.lit("late\n"), full))
    m = text.front_matter(note)
    return table(spark, sf, "customer").select("c_custkey", F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("lang")).alias("lang"))


FRONT = "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) END AS lang FROM customer"


def page_lists(spark, sf):
    size = F.col("p_size")
    raw = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit("-"))).when(size % 3 == 1, F.concat(F.lit("-"), size.cast("string"))).otherwise(F.concat(F.lit("last,"), size.cast("string"), F.lit(",1-2")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.page_list(raw, 60), " ").alias("pages"))


PAGE_LISTS = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN array_to_string(range(p_size, 61), ' ') WHEN 1 THEN array_to_string(range(1, p_size + 1), ' ') ELSE '60 ' || p_size || CASE WHEN p_size = 2 THEN ' 1' ELSE ' 1 2' END END AS pages FROM part"""

QUERIES = {
    "kind_classify": (kinds, KINDS), "find_dates": (dates, DATES), "date_roles": (roles, ROLES), "periods": (periods, PERIODS), "labelled_amounts": (amounts, AMOUNTS), "find_prices": (prices, PRICES), "refs": (references, REFERENCES), "choose_ref": (chosen, CHOSEN), "deadlines": (deadlines, DEADLINES),
    "easter": (easter, EASTER), "calendar": (order_days, ORDER_DAYS), "id_checks": (ids, IDS), "parse_amount": (parse_amounts, PARSE_AMOUNTS), "contacts": (contacts, CONTACTS), "spoken_date": (spoken, SPOKEN), "parse_qty": (quantities, QUANTITIES), "fiscal_year": (fiscal, FISCAL),
    "version_order": (versions, VERSIONS), "address_class": (addresses_query, ADDRESSES), "script_of": (scripts, SCRIPTS), "unwrap_redirect": (unwrapped, UNWRAPPED), "parcel_numbers": (parcels, PARCELS), "pii_spots": (spots, SPOTS), "mail_class": (mails, MAILS), "markdown_sections": (sections, SECTIONS),
    "markdown_plain": (markdown, MARKDOWN), "front_matter": (front, FRONT), "page_list": (page_lists, PAGE_LISTS),
}
