"""Document operators: chunks, pages, clauses, tables, claims, masks, journals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Chunk size, overlap, shortest tail, and how strongly each kind of break is preferred: white space after a sentence or clause, after a comma, and any.
SIZE, OVERLAP, MIN_TAIL = 900, 150, 200
BREAKS = ((r"\n\n", 5), (r"(?<=[.!?…;:])\s+", 3), (r"\n", 4), (r"(?<=,)\s+", 2), (r"\s+", 1))
EARLY = 0.4
_BREAK = re.compile("|".join(f"({p})" for p, _ in sorted(BREAKS, key=lambda b: (b[0] != r"\n\n", b[0] != r"\n"))))
_STRENGTH = [w for _, w in sorted(BREAKS, key=lambda b: (b[0] != r"\n\n", b[0] != r"\n"))]


def cut_points(text: str, size: int = SIZE, overlap: int = OVERLAP, tail: int = MIN_TAIL) -> list[tuple[int, int]]:
    """[start, end) of each chunk: it ends after its strongest break that doesn't end in its first two fifths, the last of equals; a short tail joins the last chunk."""
    overlap, out, at, n = min(overlap, size // 2), [], 0, len(text)
    while n - at > size + tail:
        window, best = text[at : at + size], (0, size)
        for m in _BREAK.finditer(window):
            if m.end() >= size * EARLY:
                best = max(best, (_STRENGTH[m.lastindex - 1], m.end()))
        end = at + best[1]
        out.append((at, end))
        back = max(at + 1, end - overlap)
        k = text.find(" ", back, end)
        at = k + 1 if k >= 0 else end
    if at < n:
        out.append((at, n))
    return out


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, start, end, chunk). Each chunk's place depends on the one before, so a text is walked once in Python, a batch at a time."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (a, b) in enumerate(cut_points(t or "")):
                    for c, v in zip(out, (i, k, a, b, t[a:b]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *[pa.array(c, pa.int32()) for c in out[1:4]], pa.array(out[4], pa.string())], names=["id", "ordinal", "start", "end", "chunk"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ordinal int, start int, end int, chunk string")


def clauses(lines: DataFrame, doc: str, number: str, line: str, heading: str = r"^(\d+(\.\d+)*[.)]|[IVX]+\.|(clause|clausula|article|articulo)\s+\w+)") -> DataFrame:
    """(doc, clause, first, lines, text): lines from one heading to the next; what stands before the first heading is clause 0."""
    head = F.lower(F.col(line)).rlike(heading.lower())
    k = F.sum(head.cast("int")).over(W.partitionBy(doc).orderBy(number).rowsBetween(W.unboundedPreceding, 0))
    g = lines.withColumn("clause", k).groupBy(doc, "clause")
    return g.agg(F.min(number).alias("first"), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, line))), lambda x: x[line]), "\n").alias("text"))


def table_runs(lines: DataFrame, doc: str, number: str, line: str, mark: str, least: int = 3) -> DataFrame:
    """(doc, first, rows, cells): runs of at least `least` consecutive lines with the same number, above one, of cells."""
    n = F.size(F.split(F.col(line), F.lit(mark)))
    t = lines.select(doc, number, n.alias("cells")).where("cells > 1")
    t = t.withColumn("run", F.col(number) - F.row_number().over(W.partitionBy(doc, "cells").orderBy(number)))
    return t.groupBy(doc, "cells", "run").agg(F.min(number).alias("first"), F.count("*").alias("rows")).where(F.col("rows") >= least).drop("run")


def claim_status(claims: DataFrame, group: list[str], source: str, value: str) -> DataFrame:
    """(group, sources, values, status, nature) of what sources say on the same point.

    single: one source; agree: all sources give the same set of values; conflict else: internal within one source, disjoint if two sources
    share nothing, partial otherwise.
    """
    own = claims.groupBy(*group, source).agg(F.array_sort(F.collect_set(value)).alias("vs"))
    g = own.groupBy(*group).agg(F.count("*").alias("sources"), F.collect_list("vs").alias("sets"))
    whole = F.array_distinct(F.flatten("sets"))
    apart = F.exists("sets", lambda a: F.exists("sets", lambda b: ~F.arrays_overlap(a, b)))
    same = F.size(F.array_distinct("sets")) == 1
    status = F.when(F.col("sources") == 1, F.when(F.size(whole) > 1, "conflict").otherwise("single")).when(same, "agree").otherwise("conflict")
    nature = F.when(status == "conflict", F.when(F.col("sources") == 1, "internal").when(apart, "disjoint").otherwise("partial"))
    return g.select(*group, "sources", F.size(whole).cast("long").alias("values"), status.alias("status"), nature.alias("nature"))


#: What is masked in texts, in this order, and what stands for it.
MASKS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[email]"),
    (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b", "[iban]"),
    (r"\b[0-9]{13,19}\b", "[card]"),
    (r"\b[0-9]{8}[A-Z]\b", "[id]"),
    (r"\+[0-9][0-9 ()-]{7,}[0-9]", "[phone]"),
)


def mask(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for pattern, to in MASKS:
        out = F.regexp_replace(out, pattern, F.lit(to))
    return out


def above(path: Column) -> Column:
    """A path's beginnings: its first part, its first two, and so on to the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def undo_plan(journal: DataFrame, session: str) -> DataFrame:
    """(seq, object, action): a session's successful writes, newest first, that nothing has undone.

    A write is in conflict if a later successful write of another session, itself not undone, touches the same object, one above it or one below it.
    Of the others' writes only the latest one at a path, and the latest at it or below it, can matter, so a busy object is one row of each.
    """
    done = journal.where("ok AND undoes IS NOT NULL").select(F.col("undoes").alias("seq"))
    live = journal.where("ok AND undoes IS NULL").join(done, "seq", "left_anti")
    mine = live.where(F.col("session") == session)
    other = live.where(F.col("session") != session).groupBy("object").agg(F.max("seq").alias("later"))
    below = other.select(F.explode(above(F.col("object"))).alias("object"), "later").groupBy("object").agg(F.max("later").alias("later"))
    spots = mine.select("seq", F.explode(above(F.col("object"))).alias("at"), "object")
    over = spots.where("at <> object").join(other.withColumnRenamed("object", "at"), "at").select("seq", "later")
    at = mine.select("seq", "object").join(below, "object").select("seq", "later")
    hit = over.union(at).where("later > seq").select("seq").distinct().withColumn("hit", F.lit(True))
    return mine.join(hit, "seq", "left").select("seq", "object", F.when(F.col("hit"), "conflict").otherwise("undo").alias("action"))


def name_similarity(names: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """(a, b, score), a < b: names whose words have a Jaccard similarity of at least `least`, which must be above one half.

    Two names of n words that are so similar share at least `least` * n of them; so, with the words in one order (the rarer first), they
    share two of their first n - `least` * n + 2, and are joined on such pairs. Names of one word are joined on it.
    """
    if least <= 0.5:
        raise ValueError("the least similarity must be above one half")
    words = names.select(F.col(key).alias("k"), F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")).alias("ws"))
    each = words.select("k", F.explode("ws").alias("w"))
    rank = each.groupBy("w").agg(F.count("*").alias("held"))
    sets = each.join(rank, "w").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "w"))), lambda x: x["w"]).alias("ws"))
    n = F.size("ws")
    first = F.slice("ws", F.lit(1), F.least(n, n - F.ceil(n * least - 1e-9).cast("int") + 2))
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, n), lambda y: F.concat_ws(" ", x, y))))
    keyed = sets.select("k", "ws", F.explode(F.when(n == 1, F.col("ws")).otherwise(pairs)).alias("pair"))
    a, b = (keyed.select(F.col("k").alias(x), F.col("ws").alias(f"w{x}"), "pair") for x in "ab")
    score = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return a.join(b, "pair").where("a < b").select("a", "b", F.round(score, 6).alias("score")).where(F.col("score") >= least).distinct()


def _name_classes(names: DataFrame, key: str, name: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, words), (words, class, size) and (a, b, score), a < b: names, their classes of equal words, and classes that are similar."""
    ws = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")))
    words = names.select(F.col(key).alias("k"), F.nullif(F.array_join(ws, " "), F.lit("")).alias("words"))
    classes = words.where("words IS NOT NULL").groupBy("words").agg(F.min("k").alias("class"), F.count("*").alias("size"))
    return words, classes, name_similarity(classes, "class", "words", least)


def _members(words: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = both.join(classes.select(F.col("class").alias("other"), "size"), "other").groupBy("class").agg(F.sum("size").alias("near"))
    known = classes.join(near, "class", "left").select("words", "class", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return words.join(known, "words", "left").select("k", F.coalesce("class", "k").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "words")


def name_links(names: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """(k, class, links): for each name the smallest key of those with the same words, and how many other names are similar to it.

    Pairs are looked for between classes only, so copies cost a row each; a name without words is a class of its own and has no links.
    """
    return _members(*_name_classes(names, key, name, least)).drop("words")


def name_pairs(names: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """(kind, a, b, score, links): all pairs of similar names with their scores, by classes of equal words.

    A member is a name a of the class b, with its number of links; its score, that of two members, is 1, or null for a name without words. A
    link is two similar classes a < b, with their score and the number of pairs of names that it stands for. So two names are similar if they
    are members of one class or of two linked ones, and no pair of copies is a row.
    """
    words, classes, pairs = _name_classes(names, key, name, least)
    member = _members(words, classes, pairs).select(F.lit("member").alias("kind"), F.col("k").alias("a"), F.col("class").alias("b"), F.when(F.col("words").isNotNull(), 1.0).alias("score"), "links")
    size = lambda c: classes.select(F.col("class").alias(c), F.col("size").alias(f"_{c}"))
    link = pairs.join(size("a"), "a").join(size("b"), "b").select(F.lit("link"), "a", "b", "score", F.col("_a") * F.col("_b"))
    return member.union(link)
