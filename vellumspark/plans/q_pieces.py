"""Queries: mail classes, personal data, sections, units, aliases over invented rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import mail, pieces
from vellumspark.session import table

from .q_extract import _values

MAILS = [
    (1, "Su factura de octubre", "Base imponible 10 €. IVA 2 €. Total factura 12 €", "cobros@luzviva.example", "utility", False, [("factura.pdf", 90_000, "application/pdf", "a1")]),
    (2, "Rebajas de otoño: 40 % de descuento", "Newsletter. Para darte de baja pulsa aquí.", "tienda@moda.example", "shop", False, []),
    (3, "Tienes nuevas solicitudes", "Mira quién te sigue", "notify@linkedin.com", None, False, []),
    (4, "Fotos del recibo", "Te lo mando", "ana@correo.example", None, False, [("foto.jpg", 200_000, "image/jpeg", "b2"), ("logo.png", 90_000, "image/png", "c3"), ("mini.png", 900, "image/png", "d4")]),
    (5, "Hola", "¿Comemos el jueves?", "luis@correo.example", None, False, None),
    (6, "Póliza de hogar", "Tomador: Eva. Asegurado: Eva. Prima: 90 €. Póliza 7788.", "info@roble.example", "insurer", False, []),
    (7, "Factura", "mía", "yo@correo.example", None, True, [("f.pdf", 10, "application/pdf", "e5")]),
]


def mails(spark, sf):
    m = spark.createDataFrame(MAILS, "id long, subject string, text string, sender string, trade string, from_self boolean, attachments array<struct<name:string,size:bigint,mime:string,sha:string>>")
    return mail.classify(m).select("doc", "kind", "attachments")


MAILS_SQL = _values("doc kind attachments", [(1, "doc", 1), (2, "noise", 0), (3, "noise", 0), (4, "maybe", 1), (5, "noise", 0), (6, "doc", 0), (7, "noise", 0)], "BIGINT VARCHAR BIGINT")

TEXTS = [
    (1, "Escriba a eva.soto@correo.example o llame al +34 612 345 678."), (2, "Cuenta ES91 2100 0418 4502 0005 1332, titular 12345678Z."), (3, "Tarjeta 4111 1111 1111 1111, no 4111 1111 1111 1112."),
    (4, "NIE X1234567L y NIF A58818501; 12345678A no vale."), (5, "Nada que ver aquí 2026-10-01."), (6, None),
]


def spots(spark, sf):
    d = spark.createDataFrame(TEXTS, "id long, text string")
    return pieces.personal(d, "id", "text").select("doc", "kind", F.col("start").cast("long").alias("begin"), F.col("end").cast("long").alias("finish"))


SPOTS = _values("doc kind begin finish", [(1, "email", 10, 33), (1, "phone", 45, 60), (2, "iban", 7, 36), (2, "dni", 46, 55), (3, "card", 8, 27), (4, "nie", 4, 13), (4, "cif", 20, 29)], "BIGINT VARCHAR BIGINT BIGINT")

NOTES = [(1, "Intro\n\n# One\ntext a\n```\n# no heading\n```\n## Two ##\ntext b\n"), (2, "plain only"), (3, "# A\n# B\nx"), (4, "")]


def sections(spark, sf):
    s = pieces.sections(spark.createDataFrame(NOTES, "id long, text string"), "id", "text")
    return s.select("doc", F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), "title", F.char_length("text").cast("long").alias("size"))


SECTIONS = _values("doc section level title size", [(1, 0, 0, "", 5), (1, 1, 1, "One", 33), (1, 2, 2, "Two", 16), (2, 0, 0, "", 10), (3, 1, 1, "A", 3), (3, 2, 1, "B", 5)], "BIGINT BIGINT BIGINT VARCHAR BIGINT")

UNITS = [(1, ["aaaaaaaaaa", "b", "cc", "dddddddd", "e"]), (2, ["x"]), (3, [])]


def units(spark, sf):
    u = spark.createDataFrame(UNITS, "id long, parts array<string>")
    return u.select("id", F.array_join(pieces.merge_units(F.col("parts"), 8), "|").alias("merged"))


UNITS_SQL = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'aaaaaaaaaa|b' || chr(10) || 'cc' || chr(10) || 'dddddddd' || chr(10) || 'e'), (2, 'x'), (3, '')) AS t(id, merged)"


def aliases(spark, sf):
    """Nation names, some misspelt, against the nations themselves and a few other names of theirs."""
    n = table(spark, sf, "nation").select("n_name")
    asked = n.select(F.initcap("n_name").alias("asked")).union(n.select(F.concat(F.substring("n_name", 1, 3), F.lit("x"), F.expr("substring(n_name, 4)")).alias("asked"))).union(spark.createDataFrame([("Great Britain",), ("Nowhere",)], "asked string"))
    known = n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("entity")).union(spark.createDataFrame([("Great-Britain", "UNITED KINGDOM")], "alias string, entity string"))
    return pieces.alias_lookup(asked, "asked", known, "alias", "entity").withColumnRenamed("name", "asked")


ALIASES = """WITH n AS (SELECT trim(n_name) AS n FROM nation), t AS (SELECT n, array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS c FROM n)
SELECT c AS asked, n AS entity, 'exact' AS how FROM t UNION ALL SELECT n[1:3] || 'x' || n[4:], n, 'fuzzy' FROM n WHERE length(n) >= 4 UNION ALL SELECT 'Great Britain', 'UNITED KINGDOM', 'exact'"""

QUERIES = {"mail_class": (mails, MAILS_SQL), "pii_spots": (spots, SPOTS), "markdown_sections": (sections, SECTIONS), "merge_units": (units, UNITS_SQL), "alias_lookup": (aliases, ALIASES)}

#: Rows of our own with the values they must give; the tests run them, the registry has queries over given tables.
CASES = {k: QUERIES.pop(k) for k in ("mail_class", "pii_spots", "markdown_sections", "merge_units")}
