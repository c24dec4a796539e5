"""Names in running text: the longest names first, then from left to right, no two of them overlapping; and texts with other names put in.

Names are a trie over words. A dictionary of at most SMALL names is broadcast and texts are read once; a larger one is joined on runs of words,
so only runs and places move. Either way the choice among overlapping places is the same fold over one text's places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.session import small_batches

#: Names that may be broadcast, and words of a name; longer names are not looked for.
SMALL, LONGEST = 100_000, 5
WORD = r"[^\W_]+"
#: Mentions that a task holds before it hands them on.
HELD = 1000
SPAN = "start int, stop int, name string"


def name_key(name: Column) -> Column:
    """A name's words in lower case, parted by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), 0), " ")


def choose(places: list[tuple[int, int]]) -> list[int]:
    """Of places (first word, number of words), those that stay: longest first, then leftmost, none that overlaps one before. Gives their positions in order of place."""
    taken: set[int] = set()
    out = []
    for i in sorted(range(len(places)), key=lambda i: (-places[i][1], places[i][0])):
        own = range(places[i][0], places[i][0] + places[i][1])
        if taken.isdisjoint(own):
            taken.update(own)
            out.append(i)
    return sorted(out, key=lambda i: places[i][0])


def annotate(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, small: int = SMALL) -> DataFrame:
    """(key, start, stop, name) for each mention: code points from 0, stop exclusive, the name as its key (words in lower case).

    Names of more than LONGEST words, without words, or null are not looked for; names with one key are one. Null and empty texts have no
    mentions; rows with one key are texts of their own. Words are runs of letters and digits, so a name is found whatever stands between its words.
    """
    small_batches(texts.sparkSession)
    keys = names.select(name_key(F.col(name)).alias("name")).where("name <> ''").where(F.size(F.split("name", " ")) <= LONGEST).distinct()
    known = keys.limit(small + 1).collect()
    kind = texts.schema[key].dataType.simpleString()
    if len(known) <= small:
        trie: dict = {}
        for r in known:
            node = trie
            for w in r.name.split(" "):
                node = node.setdefault(w, {})
            node[""] = r.name
        shared = texts.sparkSession.sparkContext.broadcast(trie)
        word = re.compile(WORD)

        def places(s: str) -> Iterator[tuple[int, int, int, int, str]]:
            found = [(m[0].lower(), m.start(), m.end()) for m in word.finditer(s)]
            for i in range(len(found)):
                node, k = shared.value, i
                while k < len(found) and (node := node.get(found[k][0])) is not None:
                    k += 1
                    if "" in node:
                        yield i, k - i, found[i][1], found[k - 1][2], node[""]

        def run(batches):
            for pdf in batches:
                rows = []
                for k, s in zip(pdf[key], pdf[text], strict=True):
                    all_of = list(places(s or ""))
                    rows += [(k, *all_of[i][2:]) for i in choose([p[:2] for p in all_of])]
                    if len(rows) >= HELD:
                        yield pd.DataFrame(rows, columns=[key, "start", "stop", "name"])
                        rows = []
                yield pd.DataFrame(rows, columns=[key, "start", "stop", "name"])

        return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, {SPAN}")

    # pieces alternate between words and what is between them, so places are sums of lengths before
    t = texts.select(F.col(key), F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0).alias("p"))
    at = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<s:int,w:string>>").alias("l")), lambda a, x: F.struct((a.n + F.char_length(x)).alias("n"), F.when(x.rlike(r"^[\p{L}\p{N}]"), F.array_append(a.l, F.struct(a.n.alias("s"), x.alias("w")))).otherwise(a.l).alias("l")))
    w = t.select(key, "_row", at.l.alias("w"))
    n = F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("n")
    runs = w.select(key, "_row", F.posexplode("w").alias("i", "x"), "w").select(key, "_row", "i", "x", "w", n).where(F.col("i") + F.col("n") <= F.size("w"))
    last = F.get("w", F.col("i") + F.col("n") - 1)
    runs = runs.select(key, "_row", "i", "n", F.col("x.s").alias("start"), (last.s + F.char_length(last.w)).alias("stop"), F.array_join(F.transform(F.slice("w", F.col("i") + 1, F.col("n")), lambda x: F.lower(x.w)), " ").alias("name"))
    found = runs.join(keys, "name").groupBy("_row").agg(F.first(key).alias(key), F.collect_list(F.struct("i", "n", "start", "stop", "name")).alias("all"))

    def pick(batches):
        for pdf in batches:
            rows = []
            for k, all_of in zip(pdf[key], pdf["all"], strict=True):
                rows += [(k, all_of[i]["start"], all_of[i]["stop"], all_of[i]["name"]) for i in choose([(p["i"], p["n"]) for p in all_of])]
            yield pd.DataFrame(rows, columns=[key, "start", "stop", "name"])

    return found.select(key, "all").mapInPandas(pick, f"`{key}` {kind}, {SPAN}")


def expand(texts: DataFrame, key: str, text: str, mentions: DataFrame, other: DataFrame, name: str, to: str) -> DataFrame:
    """(key, variant): each text with every mention that has another name replaced by it; a text without such mentions gives no row.

    other: (name, to). Of several other names the first in order counts; one that equals the mention's words replaces nothing.
    """
    first = other.select(name_key(F.col(name)).alias("name"), F.col(to).alias("_to")).where("_to IS NOT NULL").groupBy("name").agg(F.min("_to").alias("_to"))
    swaps = mentions.join(first, "name").where(name_key(F.col("_to")) != F.col("name")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "_to"))).alias("_s"))
    j = texts.select(key, text).join(swaps, key)
    step = F.aggregate(
        "_s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x.stop.alias("at"), F.concat(a.out, F.substr(F.col(text), a["at"] + 1, x.start - a["at"]), x["_to"]).alias("out")),
    )
    return j.select(key, step.alias("v"), text).select(key, F.concat("v.out", F.substr(F.col(text), F.col("v.at") + 1)).alias("variant"))
