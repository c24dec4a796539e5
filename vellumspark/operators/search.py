"""Ranked search over documents, and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import money, text

K1, B, FLOOR = 1.2, 0.75, 0.1


def postings(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, len, term, tf) of the documents that hold a term; the corpus figures n_docs and avg_len ride on each row.

    One scan: each document counts its own terms, only hits are exploded, and the corpus figures are one small aggregate.
    """
    t = docs.select(F.col(id_col).alias("id"), text.tokens(text_col).alias("tok")).select("id", F.size("tok").alias("len"), "tok")

    def tf(term: str) -> Column:
        return F.struct(F.lit(term).alias("term"), F.size(F.filter("tok", lambda w: w == term)).alias("tf"))

    hits = t.select("id", "len", F.explode(F.filter(F.array(*[tf(x) for x in terms]), lambda s: s["tf"] > 0)).alias("h")).select("id", "len", "h.term", "h.tf")
    whole = docs.select(F.size(text.tokens(text_col)).alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    return hits.crossJoin(F.broadcast(whole))  # one row


def bm25(docs: DataFrame, query: list[str], top: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the best documents of a query by BM25 with a floor under each term's weight; ties go to the smaller id."""
    p = postings(docs, id_col, text_col, query)
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    p = p.join(F.broadcast(df), "term")  # a row per query term
    idf = F.greatest(F.lit(FLOOR), F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = p.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return scores.orderBy(F.desc("score"), "id").limit(top)


def matches(words: Column, query: list[str], mode: str) -> Column:
    """Whether a text's words hold all terms ("and"), a word beginning with each ("prefix"), or any term ("or")."""
    def one(term: str) -> Column:
        return F.exists(words, lambda w: w.startswith(term)) if mode == "prefix" else F.array_contains(words, term)

    out = one(query[0])
    for term in query[1:]:
        out = (out | one(term)) if mode == "or" else (out & one(term))
    return out


def ladder(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rung): the strictest of and (1), prefix (2), or (3) that has any document, and its documents."""
    w = text.tokens(text_col)
    rung = F.when(matches(w, query, "and"), 1).when(matches(w, query, "prefix"), 2).when(matches(w, query, "or"), 3)
    found = docs.select(F.col(id_col).alias("id"), rung.alias("rung")).where(F.col("rung").isNotNull())
    best = found.agg(F.min("rung").alias("rung"))
    return found.join(F.broadcast(best), "rung").select("id", "rung")


def reciprocal_ranks(ranked: DataFrame, key: str, rank: str, k: int = 60, weight: Column | None = None) -> DataFrame:
    """(key, score): the sum over lists of weight / (k + rank)."""
    w = F.lit(1.0) if weight is None else weight
    return ranked.groupBy(key).agg(F.round(F.sum(w / (k + F.col(rank))), 9).alias("score"))


def fuse_scaled(scored: DataFrame, lists: str, key: str, score: str) -> DataFrame:
    """(key, score): each list's scores brought to 0 to 1 (a constant list to 1), then averaged over the lists."""
    ends = scored.groupBy(lists).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    n = ends.agg(F.count("*").alias("lists_n"))
    s = scored.join(F.broadcast(ends), lists).crossJoin(F.broadcast(n))
    part = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return s.groupBy(key).agg(F.round(F.sum(part / F.col("lists_n")), 9).alias("score"))


def cosine_top(vectors: DataFrame, query: Column, top: int, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.0) -> DataFrame:
    score = F.round(money.cosine(F.col(vec_col), query), 6)
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)


def top_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
