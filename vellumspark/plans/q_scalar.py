"""Queries: scalar functions over inline rows with the values they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import checks, text
from vellumspark.session import table


def _sql(names: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


PARCELS = [("1Z999AA10123456784", "ups"), ("1Z999AA10123456785", None), ("RB123456785GB", "post"), ("RB123456784GB", None), ("123456789012", "express"), ("JJD0001234567890", "parcel"), ("hello", None)]
UNWRAP = [("https://r.example/x?url=https%3A%2F%2Fa.example%2Fp%3Fq%3D1", "https://a.example/p?q=1"), ("https://a.example/?q=shoes", "https://a.example/?q=shoes"), ("https://r.example/l?u=https://b.example/", "https://b.example/")]
MARK = [("# Title\n\n> *quoted* **bold** `code`\n- [link](http://x) ![alt](y)", "Title\n\nquoted bold code\nlink alt"), ("plain", "plain")]
PAGES = [("1-3,5,8-", "1 2 3 5 8 9 10"), ("last,odd", "10 1 3 5 7 9"), ("-2", "1 2"), ("20", ""), ("all", "1 2 3 4 5 6 7 8 9 10")]
FRONT = [("---\ntitle: A tale\nlang: en\n---\nbody", "A tale", "en"), ("no block", None, None), ("---\ntitle: x\n---", "x", None)]


def _frame(spark, rows, name="raw"):
    return spark.createDataFrame([(r[0],) for r in rows], f"{name} string")


def parcels(spark, sf):
    return _frame(spark, PARCELS).select("raw", checks.carrier("raw").alias("carrier"))


def unwrapped(spark, sf):
    return _frame(spark, UNWRAP).select("raw", text.unwrap("raw").alias("target"))


def markdown(spark, sf):
    return _frame(spark, MARK).select("raw", text.markdown_plain("raw").alias("plain"))


def pages(spark, sf):
    return _frame(spark, PAGES).select("raw", F.array_join(text.page_list("raw", 10), " ").alias("pages"))


def front(spark, sf):
    m = text.front_matter("raw")
    return _frame(spark, FRONT).select("raw", F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("lang")).alias("lang"))


def snippets(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"(?i)\blicen"))
    return d.select("doc_id", text.snippet("text", ["licen"], 80).alias("snippet"))


SNIPPETS = r"""WITH d AS (SELECT doc_id, text, greatest(length(regexp_extract(text, '(?s)^(.*?)(?i:\blicen)', 1)) - 40, 0) AS p0 FROM documents WHERE regexp_matches(text, '(?i)\blicen'))
SELECT doc_id, regexp_replace(text[p0 + 1:p0 + 80], '(?i)(\b(licen)[0-9A-Za-z_]*)', '<mark>\1</mark>', 'g') AS snippet FROM d"""

QUERIES = {
    "parcel_numbers": (parcels, _sql("raw, carrier", PARCELS)), "unwrap_redirect": (unwrapped, _sql("raw, target", UNWRAP)), "markdown_plain": (markdown, _sql("raw, plain", MARK)),
    "page_list": (pages, _sql("raw, pages", PAGES)), "front_matter": (front, _sql("raw, title, lang", FRONT)), "snippets": (snippets, SNIPPETS),
}

#: Rows of our own with the values they must give; the tests run them, the registry has queries over given tables.
CASES = {k: QUERIES.pop(k) for k in ("parcel_numbers", "unwrap_redirect", "markdown_plain", "page_list", "front_matter")}
