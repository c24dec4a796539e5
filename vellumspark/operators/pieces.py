"""Pieces of texts: personal data with its place, sections of marked-down texts, units put together, names looked up among aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import checks
from vellumspark.functions.text import fold

from .extract import spots

#: Personal data: kind, pattern, and the check that a match must pass. Where two overlap, the earlier kind counts.
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", None),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b", checks.iban),
    ("card", r"\b\d(?:[ -]?\d){12,18}\b", checks.luhn),
    ("nie", r"\b[XYZ][ -]?\d{7}[ -]?[A-Z]\b", checks.nie),
    ("dni", r"\b\d{8}[ -]?[A-Z]\b", checks.dni),
    ("cif", r"\b[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]\b", checks.cif),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?[6789]\d{2}[ .-]?\d{3}[ .-]?\d{3}(?!\w)", None),
]


def personal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, kind, start, end, raw): personal data in a text, positions in signs from 0; numbers only with the right check digits."""
    found = F.concat(*[F.transform(spots(F.col(text_col), p), _tag(k, i)) for i, (k, p, _) in enumerate(PERSONAL)])
    d = docs.select(F.col(id_col).alias("doc"), F.explode(found).alias("x")).select("doc", "x.*")
    ok = F.lit(True)
    for k, _, check in PERSONAL:
        if check is not None:
            ok = F.when(F.col("kind") == k, F.coalesce(check("raw"), F.lit(False))).otherwise(ok)
    d = d.where(ok)
    # of overlapping finds the kind that comes first counts: one that a better find covers goes
    every = d.groupBy("doc").agg(F.collect_list(F.struct("rank", "start", "end", "kind", "raw")).alias("xs"))  # finds of one text
    covered = lambda a: F.exists("xs", lambda b: (b["rank"] < a["rank"]) & (b["start"] < a["end"]) & (a["start"] < b["end"]))
    return every.select("doc", F.explode(F.filter("xs", lambda a: ~covered(a))).alias("x")).select("doc", "x.kind", "x.start", "x.end", "x.raw")


def _tag(kind: str, rank: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, section, level, title, text): a marked-down text cut before each heading; what stands before the first is section 0 of level 0. Lines within code fences are no headings."""
    ls = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    w = W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    ls = ls.withColumn("fence", F.sum(F.col("line").rlike("^```").cast("int")).over(w) % 2 == 1)
    head = ~F.col("fence") & F.col("line").rlike(r"^#{1,6}\s+\S")
    ls = ls.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 1)
    g = ls.groupBy("doc", "section").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.char_length(mark))), F.lit(0)).alias("level"),
        F.coalesce(F.max(F.when(F.col("head"), F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 2))), F.lit("")).alias("title"),
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"),
    )
    g = g.select("doc", "section", "level", "title", F.trim(F.array_join(F.col("ls.line"), "\n"), F.lit(" \n")).alias("text"))
    return g.where("text <> ''")


def merge_units(units: Column, least: int) -> Column:
    """An array of texts with those put together that are shorter than `least`, each with what follows; a short last one joins the one before."""
    joined = F.aggregate(
        units,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda a, u: _flush(a["done"], F.when(a["open"] == "", u).otherwise(F.concat(a["open"], F.lit("\n"), u)), least),
    )
    done, rest = joined["done"], joined["open"]
    last = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n"), rest)))
    return F.when(rest == "", done).when(F.size(done) == 0, F.array(rest)).otherwise(last)


def _flush(done: Column, text: Column, least: int) -> Column:
    full = F.char_length(text) >= least
    return F.struct(F.when(full, F.concat(done, F.array(text))).otherwise(done).alias("done"), F.when(full, "").otherwise(text).alias("open"))


def name_key(c: Column | str) -> Column:
    """Folded letters and digits of a name, single blanks between."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def alias_lookup(names: DataFrame, name: str, aliases: DataFrame, alias: str, entity: str, least: int = 5) -> DataFrame:
    """(name, entity, how): the entity of each name: by its key, or else by the nearest alias one edit away.

    Names one edit apart are equal after one sign is taken out of either, so keys of `least` signs and more are joined on their
    deletions, and of several hits the one with the smallest distance counts, then the first entity. Names without a hit are left out.
    """
    n = names.select(F.col(name).alias("name")).distinct().withColumn("key", name_key("name")).where("key <> ''")
    a = aliases.select(F.col(entity).alias("entity"), name_key(alias).alias("alias_key")).where("alias_key <> ''").distinct()

    def deletions(k: str) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.char_length(k)), lambda i: F.concat(F.substring(F.col(k), F.lit(1), i - 1), F.substring(F.col(k), i + 1, F.char_length(k))))
        return F.explode(F.array_distinct(F.concat(F.array(k), F.when(F.char_length(k) >= least, cut).otherwise(F.array().cast("array<string>")))))

    hits = n.withColumn("d", deletions("key")).join(a.withColumn("d", deletions("alias_key")), "d")
    hits = hits.withColumn("distance", F.levenshtein("key", "alias_key")).where((F.col("distance") == 0) | ((F.col("distance") == 1) & (F.least(F.char_length("key"), F.char_length("alias_key")) >= least - 1)))
    best = hits.groupBy("name").agg(F.min(F.struct("distance", "entity")).alias("b"))
    return best.select("name", F.col("b.entity").alias("entity"), F.when(F.col("b.distance") == 0, "exact").otherwise("fuzzy").alias("how"))
