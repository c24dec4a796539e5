"""Queries: differences of texts, applied changes, recurring dates, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import versions
from vellumspark.session import table

from .q_extract import _values

OLD = [(1, "Clause one\nRent: 700 EUR\n\nNotice   two months\nEnd"), (2, "same\ntext"), (3, "only here"), (4, None)]
NEW = [(1, "Clause one\nRent: 750 EUR\nNotice two months\nPets allowed\nEnd"), (2, "same\n\n  text"), (4, "new text")]


def _pair(spark):
    return spark.createDataFrame(OLD, "id long, text string"), spark.createDataFrame(NEW, "id long, text string")


def _flat(df):
    return df.select("id", "kind", F.array_join("before", "|").alias("was"), F.array_join("after", "|").alias("now"))


def line_changes(spark, sf):
    return _flat(versions.compare(*_pair(spark), "id", "text"))


LINE_CHANGES = _values("id kind was now", [(1, "replace", "Rent: 700 EUR", "Rent: 750 EUR"), (1, "insert", "", "Pets allowed"), (3, "delete", "only here", ""), (4, "insert", "", "new text")], "BIGINT VARCHAR VARCHAR VARCHAR")


def word_changes(spark, sf):
    return _flat(versions.compare(*_pair(spark), "id", "text", words=True))


WORD_CHANGES = _values("id kind was now", [(1, "replace", "700", "750"), (1, "insert", "", "Pets|allowed"), (3, "delete", "only|here", ""), (4, "insert", "", "new|text")], "BIGINT VARCHAR VARCHAR VARCHAR")


def changed_documents(spark, sf):
    """How many lines changed between each document and the next, over the whole table; one whose neighbour is missing is compared with nothing."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = versions.compare(d, d.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.sum(F.size("before")).cast("long").alias("lines_out"), F.sum(F.size("after")).cast("long").alias("lines_in"))


def changes(spark, sf):
    o = table(spark, sf, "orders")
    base = o.where("o_orderkey % 4 <> 3").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    ops = F.array(
        F.when(k % 3 == 0, F.struct(F.lit(1).alias("at"), F.lit("update").alias("op"), F.lit("X").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))),
        F.when(k % 5 == 0, F.struct(F.lit(2).alias("at"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))),
        F.when((k % 4 == 3) | (k % 10 == 0), F.struct(F.lit(3).alias("at"), F.lit("create").alias("op"), F.lit("N").alias("o_orderstatus"), F.lit("9-NEW").alias("o_orderpriority"))),
        F.when(k % 7 == 0, F.struct(F.lit(4).alias("at"), F.lit("update").alias("op"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit("8-LATE").alias("o_orderpriority"))),
    )
    log = o.select("o_orderkey", F.explode(F.filter(ops, lambda x: x.isNotNull())).alias("c")).select("o_orderkey", "c.*")
    return versions.apply_changes(base, log, "o_orderkey", "at", "op", ["o_orderstatus", "o_orderpriority"])


CHANGES = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 4 <> 3 AS was, o_orderkey % 5 = 0 AS del, o_orderkey % 4 = 3 OR o_orderkey % 10 = 0 AS made FROM orders)
SELECT k AS o_orderkey, CASE WHEN made THEN 'N' WHEN k % 3 = 0 THEN 'X' ELSE s END AS o_orderstatus, CASE WHEN k % 7 = 0 THEN '8-LATE' WHEN made THEN '9-NEW' ELSE p END AS o_orderpriority
FROM o WHERE made OR (was AND NOT del)
"""


def recurring(spark, sf):
    d = F.to_date("o_orderdate")
    step = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(12)
    return table(spark, sf, "orders").select("o_orderkey", versions.next_occurrence(d, step, F.lit("1997-02-28").cast("date")).alias("day"))


RECURRING = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 12 END AS m FROM orders)
SELECT o_orderkey, min(CAST(d + to_months(CAST(k * m AS INT)) AS DATE)) AS day FROM o, range(0, 140) AS r(k) WHERE CAST(d + to_months(CAST(k * m AS INT)) AS DATE) > DATE '1997-02-28' GROUP BY o_orderkey
"""


def signatures(spark, sf):
    """Groups of orders that are the same but for their number and clerk."""
    o = table(spark, sf, "orders").select(versions.signature([F.col(c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")]).alias("sig"), "o_custkey")
    return o.groupBy("sig").agg(F.count("*").alias("n"), F.min("o_custkey").alias("o_custkey")).select("n", "o_custkey")


SIGNATURES = "SELECT count(*) AS n, o_custkey FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority"

QUERIES = {
    "line_changes": (line_changes, LINE_CHANGES), "word_changes": (word_changes, WORD_CHANGES), "changed_documents": (changed_documents, None), "apply_changes": (changes, CHANGES), "next_occurrence": (recurring, RECURRING), "row_signature": (signatures, SIGNATURES),
}

#: Rows of our own with the values they must give; the tests run them, the registry has queries over given tables.
CASES = {k: QUERIES.pop(k) for k in ("line_changes", "word_changes")}
