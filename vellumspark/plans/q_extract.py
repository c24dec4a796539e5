"""Queries of document extraction over invented paperwork, each text written for what it exercises."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import extract
from vellumspark.streaming.jobs import place

#: id, issuer's trade, text.
PAPERS = [
    (1, "insurer", "Seguros Roble\nPÓLIZA nº: RB-448812/3\nTomador: Lía Soto   Asegurado: Lía Soto\nFecha de efecto: 01/03/2026 hasta el 28/02/2027\nPrima total: 412,60 €"),
    (2, None, "BOLETÍN DE DENUNCIA nº 7781-2026-44\nInfracción: exceso de velocidad\nFecha de notificación: 5 de octubre de 2026\nImporte de la multa: 200,00 €\nPronto pago con reducción del 50 % en 20 días naturales"),
    (3, "utility", "Suministro de agua\nPeriodo de facturación: 01/07/2026 al 31/08/2026\nFecha de cargo: 2026-10-12\nConsumo 14 m3\nBase imponible 40,00 €\nIVA 4,00 €\nTotal factura: 44,00 €\nNº de contrato: AG-90017"),
    (4, "shop", "TICKET\nFecha de compra: 14.09.2026\n1 cafetera 89,90 €\nTotal (IVA incluido): 89,90 €\nGracias por su compra\nPedido: 302-1234567-7654321"),
    (5, "telco", "CONTRATO de línea móvil\nCondiciones particulares\nFecha de alta: 10 octubre 2026\nEl cliente acepta una permanencia de doce (12) meses desde la activación.\nCuota mensual: 19,95 €"),
    (6, None, "AYUNTAMIENTO DE VALDERRÍO\nNotificación del expediente: EX-2026/0912\nNotificado el 01/10/2026\n\nContra esta resolución puede presentar recurso de reposición en el plazo de un mes desde la notificación.\n\nPodrá formular alegaciones en diez (10) días hábiles."),
    (7, None, "Inspección técnica\nITV favorable\nMatrícula 0000-XYZ\nPróxima inspección:\n20/05/2028"),
    (8, None, "MANUAL DE INSTRUCCIONES\nLea atentamente estas instrucciones.\nGarantía de 2 años. Fecha de edición: 03/2024"),
    (9, None, "Invoice number: INV-2026-118\nInvoice date: March 3, 2026\nDue date: December 1, 2026\nSubtotal $1,100.00\nVAT $231.00\nAmount due: $1,331.00"),
    (10, None, "Notas sueltas sobre el tiempo y la huerta."),
    (11, None, None),
]


def _papers(spark):
    return spark.createDataFrame(PAPERS, "id long, trade string, text string")


def _lines(spark):
    return extract.lines(_papers(spark), "id", "text")


def _values(names: str, rows: list[tuple], kinds: str) -> str:
    """SQL of literal rows."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names.split(), kinds.split(), strict=True))
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({', '.join(names.split())})"


def kinds(spark, sf):
    return extract.kinds(_papers(spark), "id", "text", "trade").select("doc", "kind")


KINDS = _values("doc kind", [(1, "insurance"), (2, "fine"), (3, "bill"), (4, "receipt"), (5, "contract"), (6, "official"), (7, "vehicle"), (8, "manual"), (9, "invoice"), (10, "other"), (11, "other")], "BIGINT VARCHAR")


def dates(spark, sf):
    return extract.dates(_lines(spark)).select("doc", F.col("n").cast("long").alias("line"), "date")


DATES = _values("doc line date", [(1, 3, "2026-03-01"), (1, 3, "2027-02-28"), (2, 2, "2026-10-05"), (3, 1, "2026-07-01"), (3, 1, "2026-08-31"), (3, 2, "2026-10-12"), (4, 1, "2026-09-14"), (5, 2, "2026-10-10"), (6, 2, "2026-10-01"), (7, 4, "2028-05-20"), (9, 1, "2026-03-03"), (9, 2, "2026-12-01")], "BIGINT BIGINT DATE")


def roles(spark, sf):
    return extract.date_roles(_lines(spark)).select("doc", "date", "role")


ROLES = _values("doc date role", [(1, "2026-03-01", "effect_from"), (1, "2027-02-28", "effect_to"), (2, "2026-10-05", "notified"), (3, "2026-07-01", "period_from"), (3, "2026-08-31", "period_to"), (3, "2026-10-12", "due"), (4, "2026-09-14", "purchase"), (5, "2026-10-10", "effect_from"), (6, "2026-10-01", "notified"), (7, "2028-05-20", "itv_next"), (9, "2026-03-03", "issue"), (9, "2026-12-01", "due")], "BIGINT DATE VARCHAR")


def periods(spark, sf):
    return extract.periods(_papers(spark), "id", "text").select("doc", F.col("n").cast("long").alias("n"), "unit", "working", "purpose", "base")


PERIODS = _values("doc n unit working purpose base", [(2, 20, "day", False, "fine_pay", "notified"), (5, 12, "month", None, "permanence", "effect"), (6, 1, "month", None, "appeal", "notified"), (6, 10, "day", True, "appeal", ""), (8, 2, "year", None, "warranty", "")], "BIGINT BIGINT VARCHAR BOOLEAN VARCHAR VARCHAR")


def amounts(spark, sf):
    return extract.amounts(_lines(spark)).select("doc", F.col("amount").cast("decimal(18,2)").alias("amount"), "currency", F.col("priority").cast("long").alias("priority"))


AMOUNTS = _values("doc amount currency priority", [(1, 412.60, "EUR", 9), (2, 200.00, "EUR", 10), (3, 44.00, "EUR", 9), (4, 89.90, "EUR", 9), (5, 19.95, "EUR", 7), (9, 1331.00, "USD", 10)], "BIGINT DECIMAL(18,2) VARCHAR BIGINT")


def prices(spark, sf):
    return extract.prices(_lines(spark)).select("doc", F.col("n").cast("long").alias("line"), F.col("amount").cast("decimal(18,2)").alias("amount"), "currency")


PRICES = _values("doc line amount currency", [(1, 4, 412.60, "EUR"), (2, 3, 200.00, "EUR"), (3, 4, 40.00, "EUR"), (3, 5, 4.00, "EUR"), (3, 6, 44.00, "EUR"), (4, 2, 89.90, "EUR"), (4, 3, 89.90, "EUR"), (5, 4, 19.95, "EUR"), (9, 3, 1100.00, "USD"), (9, 4, 231.00, "USD"), (9, 5, 1331.00, "USD")], "BIGINT BIGINT DECIMAL(18,2) VARCHAR")


def references(spark, sf):
    return extract.references(_papers(spark), "id", "text").select("doc", "value", "what", "stable")


REFERENCES = _values("doc value what stable", [(1, "RB-448812/3", "policy", True), (2, "7781-2026-44", "bulletin", False), (3, "AG-90017", "contract", True), (4, "302-1234567-7654321", "order", False), (6, "EX-2026/0912", "expedient", False), (9, "INV-2026-118", "invoice", False)], "BIGINT VARCHAR VARCHAR BOOLEAN")


def chosen(spark, sf):
    p = _papers(spark)
    return extract.choose_reference(extract.references(p, "id", "text"), extract.kinds(p, "id", "text", "trade"))


CHOSEN = _values("doc ref series_ref", [(1, "RB-448812/3", "RB-448812/3"), (2, "7781-2026-44", None), (3, "AG-90017", "AG-90017"), (4, "302-1234567-7654321", None), (6, "EX-2026/0912", None), (9, "INV-2026-118", None)], "BIGINT VARCHAR VARCHAR")


def _settled(spark, df, name: str):
    """A step's result as a table, so that what comes after plans over columns and not over all rules at once."""
    at = place(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def deadlines(spark, sf):
    p = _papers(spark)
    kind_of = _settled(spark, extract.kinds(p, "id", "text", "trade"), "kinds")
    roles, relative = _settled(spark, extract.date_roles(_lines(spark)), "roles"), _settled(spark, extract.periods(p, "id", "text"), "periods")
    return extract.deadlines(kind_of, roles, relative, "2026-10-01").select("doc", "key", "date")


DEADLINES = _values("doc key date", [
    (1, "renewal", "2027-02-28"), (1, "cancel_by", "2027-01-28"), (2, "fine_discount", "2026-10-25"), (2, "fine_pay_20day", "2026-10-25"), (3, "payment", "2026-10-12"), (4, "warranty_36month", "2029-09-14"),
    (5, "permanence_12month", "2027-10-10"), (6, "appeal_1month", "2026-11-01"), (7, "itv", "2028-05-20"), (9, "payment", "2026-12-01"),
], "BIGINT VARCHAR DATE")

#: Rows of our own with the values they must give; the tests run them.
CASES = {
    "kind_classify": (kinds, KINDS), "find_dates": (dates, DATES), "date_roles": (roles, ROLES), "periods": (periods, PERIODS), "labelled_amounts": (amounts, AMOUNTS), "find_prices": (prices, PRICES),
    "refs": (references, REFERENCES), "choose_ref": (chosen, CHOSEN), "deadlines": (deadlines, DEADLINES),
}

QUERIES = {}
