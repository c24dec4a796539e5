"""Fuzzy line dedup on DataFrame functions: shared runs of words, edit similarity, one occurrence per connected group.

Lines are compared as words in lower case: letters, digits and all signs beyond ASCII; blanks and ASCII punctuation are dropped.
Lines with the same words are one node. Nodes are linked if their edit similarity over words is 0.8 or more.

SimHash blocks can't find such pairs: a fifth of the words changed turns 13 of 64 bits on average, and fourteen blocks of 4 or 5 bits
select nothing; at a distance of 3 bits only 17 % of the similar pairs of a test table were found. So lines are joined on what similar
ones must share. Lines of up to nine words are similar if one word was replaced or left out: lines that are equal but for the word at one
place are linked to the least of them, and a line that lacks the word to that one too, without any comparison and whatever their number. Others
share runs of three words, of which up to GRAMS are taken by a hash, all of them up to GRAMS + 2 words; of these, similar lines share two at
least, repeated runs counted. A longer pair at 0.8 with changes drawn at random shares none of 16 with a probability of 1 in 800, with changes
spread evenly 1 in 100. Parity sketches, which leave out no similar pair, and lengths are compared before texts move. A bucket first compares
its members with a few of them; pairs are formed only between lines that are in different groups after that, and only where the sketches allow it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, read

#: Runs by which a line is found. More of them find more of the pairs of longer lines.
GRAMS = 16
#: Lines of this many words have runs, as a line of ten may be similar to them; lines of up to DELETED words are similar within one edit.
SHORT, DELETED = 8, 9
#: Lines of a bucket that are compared as they are. A larger bucket is split by pairs of runs: similar lines of up to GRAMS + 2 words share two
#: runs at least, so one of them is no crowded bucket or the lines meet in that of the pair.
CROWD = 128
#: Lines of a bucket that one task compares with all others of it.
PART = 256
SIMILARITY = 0.8


def words(line: Column) -> Column:
    """Lower-case words: runs of a-z, digits and all signs beyond ASCII. Blanks, control signs and ASCII punctuation only separate."""
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9\\x{80}-\\x{10ffff}]+"), "")


#: A word's hash has 57 bits; the bit SHORT_BIT tells words of four signs at most.
SHORT_BIT = 1 << 60


def hashes(w: Column) -> Column:
    """A hash of each word, SHORT_BIT set for words of four signs at most."""
    return F.transform(w, lambda x: F.shiftrightunsigned(F.xxhash64(x), 7).bitwiseOR(F.when(F.octet_length(x) <= 4, F.lit(SHORT_BIT)).otherwise(F.lit(0).cast("long"))))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def keys(h: Column, n: Column) -> Column:
    """Hashes by which a line is found, from SHORT words: up to GRAMS runs of three words, those with few short words first, as these are the
    rarer ones; then in the order of the hash. Up to GRAMS + 2 words, a run that comes again is another run.

    A run is x + 2 y + 4 z of its words' hashes, which lie so that no sum runs over; its highest bits grow with its short words.
    """
    rest, zero = n - 2, F.lit(0).cast("long")
    two = F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(2), rest), lambda x, y: x + F.shiftleft(y, 1))
    # of a type without nulls, which Spark sorts as plain longs
    runs = F.sort_array(F.zip_with(two, F.slice(h, F.lit(3), rest), lambda x, z: F.coalesce(x + F.shiftleft(z, 2), zero)))
    again = lambda r: F.transform(r, lambda x, i: F.when((i > 0) & (F.get(r, i - 1) == x), F.xxhash64(x, i - F.array_position(r, x))).otherwise(x))
    kept = F.when(n > GRAMS + 2, F.slice(F.array_distinct(runs), 1, GRAMS)).otherwise(let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), r).otherwise(again(r))))
    return F.when(n < SHORT, F.array().cast("array<bigint>")).otherwise(kept)


def deletions(h: Column, n: Column) -> Column:
    """(r, place): up to DELETED words, from five, a hash of the line without the word at each place; below that a hash of the whole line, from four words, with the place -1."""
    # a hash of two arrays is that of their elements in a row
    without = F.transform(h, lambda x, i: F.struct(F.xxhash64(F.lit(7), F.slice(h, F.lit(1), i), F.slice(h, i + 2, n)).alias("r"), i.cast("int").alias("place")))
    whole = F.array(F.struct(F.xxhash64(F.lit(7), h).alias("r"), F.lit(-1).alias("place")))
    return F.when(n == 4, whole).when((n > 4) & (n < DELETED), F.concat(without, whole)).when(n == DELETED, without)


def parity(h: Column, shift: int = 5) -> Column:
    """64 bits: whether the words that fall on a bit are odd in number. An edit of one word changes two bits at most."""
    return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(63)).cast("int"))))


def allowed(n: Column) -> Column:
    """The edits that lines may differ by, the longer having n words."""
    return F.floor(n * (1 - SIMILARITY) + 1e-9).cast("int")


def possible(pa: Column, na: Column, pb: Column, nb: Column) -> Column:
    """Whether lines of these parities and lengths may be similar; true for all that are."""
    most = allowed(F.greatest(na, nb))
    return (F.abs(na - nb) <= most) & (F.bit_count(pa.bitwiseXOR(pb)) <= most * 2)


#: Signs of the basic plane that stand for words: 49,152 from U+1000, below the surrogates.
FIRST_SIGN, SIGNS = 0x1000, 0xC000
#: Parts of the wide parity sketch, which long lines need: words modulo WIDE fall on bits of their own.
WIDE = 4


def symbols(h: Column) -> Column:
    """A text of one sign for each word, given by its hash, so that edit distance on it counts words."""
    return F.decode(F.unhex(F.array_join(F.transform(h, lambda x: F.hex(F.pmod(x, F.lit(SIGNS)) + FIRST_SIGN)), "")), "UTF-16BE")


def wide_parity(h: Column, parts: int) -> list[Column]:
    """Parity sketches of words, given by their hashes and dealt to so many sketches by them."""
    # a lambda of two arguments would be given each element's place as the second one
    dealt = lambda k: lambda x: F.shiftrightunsigned(x, 40).bitwiseAND(F.lit(parts - 1)) == k
    return [parity(F.filter(h, dealt(k)), 48) for k in range(parts)]


def close(x: str, y: str, columns: list[str]) -> Column:
    """Whether the lines x and y of these wide parities may be similar; true for all that are.

    An edit of one word changes two bits at most. Words that come again in a line cancel out.
    """
    bits = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in columns]
    return sum(bits, F.lit(0)) <= allowed(F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))) * 2


def similar(x: Column, y: Column) -> Column:
    """Whether the edit similarity of two symbol texts, 1 - distance / longer length, is SIMILARITY or more."""
    most = allowed(F.greatest(F.char_length(x), F.char_length(y)))
    return F.when(F.abs(F.char_length(x) - F.char_length(y)) <= most, F.call_function("levenshtein", x, y, most) >= 0).otherwise(F.lit(False))


def removals(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dk, removed): for each document that loses lines, their positions from 0; dk is xxhash64(id, text).

    Of each group of linked lines the occurrence with the smallest id and position stays (rows without id come last). Lines
    without letters or digits are never removed, null and empty texts have no lines to lose. Rows of equal id and text are one
    document and lose the same lines. Other columns are not read; an empty table gives no rows. All lines of all texts take part.
    """
    scratch = Scratch(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("dk", F.xxhash64("id", "text"))
    w = slim.select("id", "dk", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "dk", "pos", words(F.col("line")).alias("w"))
    h = w.select("id", "dk", "pos", F.size("w").alias("n"), hashes(F.col("w")).alias("h"))
    h = h.select("id", "dk", "pos", F.xxhash64("h").alias("k1"), F.xxhash64(F.lit(1), "h").alias("k2"), "n", "h")
    # a filter before the table would be pushed below the projection and cut every line a second time
    lines = scratch.keep(h.select("id", "dk", "pos", "k1", "k2", "n", parity(F.col("h")).alias("p"), keys(F.col("h"), F.col("n")).alias("keys"), deletions(F.col("h"), F.col("n")).alias("short")))
    spot = F.struct(F.col("id").isNull().alias("no_id"), "id", "dk", "pos")
    found = scratch.keep(lines.where("n > 0").groupBy("k1", "k2").agg(F.min(spot).alias("spot"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("keys").alias("keys"), F.first("short").alias("short"), F.count("*").alias("times")))
    # runs are most of both tables, so they go as soon as they have been used
    kept = scratch.keep(lines.where("n > 0").select("id", "dk", "pos", "k1", "k2"))
    scratch.drop(lines)
    lines = kept

    edges = scratch.keep(_one_word(found))
    block, parts = _buckets(scratch, found.select("k1", "n", "p", F.explode("keys").alias("key")))
    near = possible(F.col("x.p"), F.col("x.n"), F.col("y.p"), F.col("y.n"))
    held = scratch.keep(block.alias("x").join(block.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.k1") != F.col("y.k1")) & near, "left_semi"))
    nodes = scratch.keep(found.drop("n", "p", "keys", "short"))
    scratch.drop(found, *parts)
    # what most others resemble leads its buckets, so a large group has one leader in nearly all of them
    own = scratch.keep(held.groupBy("k1").agg(F.sum("lines").alias("pop")))
    full = scratch.keep(_texts(slim, nodes.join(own.select("k1"), "k1", "left_semi").select("k1", "spot")))
    star = scratch.keep(_stars(held.join(own, "k1")))
    linked = scratch.keep(_confirmed(star, full).union(edges).distinct())
    groups = components(spark, linked, scratch)
    pairs = scratch.keep(_across(held.join(groups.select(F.col("node").alias("k1"), F.col("root").alias("label")), "k1", "left"), full, scratch))
    # only groups that meet are put together, by their roots
    of = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(spark, met, scratch)
    under = groups.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = under.union(tops.join(groups.select("node"), "node", "left_anti").select("node", "root"))
    scratch.drop(edges, held, own, full, star, linked, pairs)

    group = nodes.join(roots, nodes["k1"] == roots["node"], "left").where("times > 1 OR root IS NOT NULL").select("k1", "k2", "spot", F.coalesce("root", "k1").alias("root"))
    dirty = scratch.keep(group.select("k1", "k2", F.min("spot").over(Window.partitionBy("root")).alias("stay")))
    gone = lines.join(dirty, ["k1", "k2"]).where(~(F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("dk") == F.col("stay.dk")) & (F.col("pos") == F.col("stay.pos"))))
    out = scratch.keep(gone.groupBy("id", "dk").agg(F.collect_set("pos").alias("removed")))
    scratch.drop(kept, nodes, dirty)
    return out


def _one_word(found: DataFrame) -> DataFrame:
    """(a, b): lines of four to nine words that are one word apart, as stars: each to the least of those that are equal but for the word at a place, and the line without that word to the same."""
    e = found.select("k1", F.explode("short").alias("s")).select("k1", "s.r", "s.place")
    whole = F.min(F.when(F.col("place") < 0, F.col("k1"))).over(Window.partitionBy("r"))
    e = e.withColumn("m", F.min("k1").over(Window.partitionBy("r", "place"))).withColumn("whole", whole).where("place >= 0")
    # the least of a place stands for it at the line that lacks the word
    other = F.when(F.col("k1") == F.col("m"), F.col("whole")).otherwise(F.col("k1"))
    return e.select("m", other.alias("k1")).where("k1 <> m").select(F.least("m", "k1").alias("a"), F.greatest("m", "k1").alias("b")).distinct()


def _buckets(scratch: Scratch, block: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(k1, n, p, key, lines) with every bucket of several lines, crowded ones split by the other crowded runs of their lines; and the tables that it reads."""
    marked = scratch.keep(block.withColumn("lines", F.count("*").over(Window.partitionBy("key"))).where("lines > 1").select("k1", "n", "p", "key", "lines"))
    many = marked.where(F.col("lines") > CROWD).groupBy("k1").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.sort_array(F.collect_set("key")).alias("ks"))  # GRAMS at most
    pairs = F.flatten(F.transform("ks", lambda x, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda y: F.xxhash64(x, y))))
    split = scratch.keep(_merged(scratch, many.select("k1", "n", "p", F.explode(pairs).alias("key"))))
    return marked.where(F.col("lines") <= CROWD).union(split), (marked, split)


def _merged(scratch: Scratch, split: DataFrame) -> DataFrame:
    """(k1, n, p, key, lines): buckets of several lines, those of which most lines have one larger bucket as their largest put into that with all their lines.

    A passage that many lines share, or a group of near copies, gives a bucket for each pair of its runs, with nearly the same lines: as one bucket
    its pairs meet once. All lines that had a bucket in common have one still.
    """
    b = scratch.keep(split.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1").withColumn("top", F.max(F.struct("size", "key")).over(Window.partitionBy("k1"))["key"]))
    votes = b.groupBy("key", "top").agg(F.count("*").alias("votes"), F.first("size").alias("size")).groupBy("key").agg(F.max(F.struct("votes", "top")).alias("v"), F.first("size").alias("size"))
    into = scratch.keep(votes.where(F.col("v.votes") * 3 >= F.col("size") * 2).select("key", F.col("v.top").alias("top")))
    # only into buckets that stay themselves
    into = into.where("key <> top").join(into.where("key = top").select("top"), "top", "left_semi").withColumnRenamed("top", "target")
    m = b.join(into, "key", "left").groupBy("k1", F.coalesce("target", "key").alias("key")).agg(F.first("n").alias("n"), F.first("p").alias("p"), (F.count("*") * CROWD).alias("lines"))
    return m.select("k1", "n", "p", "key", "lines")


def _stars(held: DataFrame) -> DataFrame:
    """(a, b): the members of each bucket with the two of them with which all others are compared at first: the most popular one, and one drawn by a hash that is the same in every bucket."""
    bucket, drawn = Window.partitionBy("key"), F.xxhash64("k1")
    first = F.max(F.struct("pop", "k1", "n", "p")).over(bucket)
    second = F.min(F.struct(drawn.alias("h"), "k1", "n", "p")).over(bucket)
    of = lambda c: F.struct(F.col(f"{c}.k1").alias("b"), F.col(f"{c}.n").alias("nb"), F.col(f"{c}.p").alias("pb"))
    led = held.select("k1", "n", "p", first.alias("m"), second.alias("d")).select("k1", "n", "p", F.explode(F.array_distinct(F.array(of("m"), of("d")))).alias("x")).select("k1", "n", "p", "x.*")
    near = possible(F.col("p"), F.col("n"), F.col("pb"), F.col("nb"))
    return led.where("b <> k1").where(near).select(F.least("b", "k1").alias("a"), F.greatest("b", "k1").alias("b")).distinct()


def _across(named: DataFrame, sketches: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): lines of one bucket and different labels whose sketches and lengths allow that they are similar, or, where `sketches` has their texts (sym), that are similar. Only lines of one length level or two neighbouring ones meet.

    Lines that share a passage but nothing else are many pairs and hardly any link. So first those go that no other line of the bucket may be
    similar to, and then texts are compared where lines meet, each pair once; a bucket is dealt to a task for each PART of its lines. No pair is kept but a link.
    """
    keep = scratch.keep if scratch else lambda d: d
    bucket = Window.partitionBy("key")
    n = named.select("key", "k1", "n", "p", F.coalesce("label", "k1").alias("label"))
    n = n.withColumn("low", F.min("label").over(bucket)).withColumn("high", F.max("label").over(bucket)).where("low < high").drop("high").join(sketches.drop("sym"), "k1")
    # lengths of similar lines are at most 1 : 1.25
    n = keep(n.withColumn("level", F.floor(F.log("n") / math.log(1.26)).cast("int")))
    levels = F.explode(F.array(F.col("level") - 1, "level", F.col("level") + 1))
    wide = [c for c in sketches.columns if c not in ("k1", "sym")]
    side = lambda s: (F.col(f"{s}.p"), F.col(f"{s}.n"))
    apart = (F.col("x.label") != F.col("y.label")) & possible(*side("x"), *side("y")) & close("x", "y", wide)
    x, y = n.select("key", "n", "p", "label", *wide, levels.alias("level")).alias("x"), n.alias("y")
    may = keep(y.join(x, (F.col("x.key") == F.col("y.key")) & (F.col("x.level") == F.col("y.level")) & apart, "left_semi"))
    # lines that meet in several buckets are compared in the first of them, so each line has its buckets before this one
    may = may.withColumn("before", F.filter(F.collect_set("key").over(Window.partitionBy("k1")), lambda k: k < F.col("key")))
    apart = apart & ((F.col("y.label") == F.col("y.low")) | (F.col("x.k1") < F.col("y.k1"))) & ~F.arrays_overlap("x.before", "y.before")
    if "sym" in sketches.columns:
        may = may.join(sketches.select("k1", "sym"), "k1")
        apart = apart & similar(F.col("x.sym"), F.col("y.sym"))
    may = keep(may.withColumn("parts", F.ceil(F.count("*").over(bucket) / PART).cast("int")))
    x = may.where("label <> low").withColumn("part", F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")).select("*", levels.alias("at"))
    y = may.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # few bytes and much work, so not as few tasks as the bytes would have
    tasks = int(may.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = x.repartition(tasks, "key", "at", "part").alias("x"), y.repartition(tasks, "key", "level", "part").alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.level")) & (F.col("x.part") == F.col("y.part")) & apart)
    return met.select(F.least("x.k1", "y.k1").alias("a"), F.greatest("x.k1", "y.k1").alias("b")).distinct()


def _texts(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k1, sym, q0, ...) of nodes, from their first occurrences: one join with the documents."""
    wanted = nodes.select("k1", "spot.id", "spot.dk", "spot.pos").groupBy("id", "dk").agg(F.collect_list(F.struct("pos", "k1")).alias("at"))
    on = slim["id"].eqNullSafe(wanted["id"]) & (slim["dk"] == wanted["dk"])
    # only the wanted lines are rows, none with all lines of its text
    line = lambda ls: F.transform("at", lambda a: F.struct(a["k1"].alias("k1"), F.get(ls, a["pos"]).alias("line")))
    found = slim.join(wanted, on).select(F.explode(let(F.split("text", "\n"), line)).alias("s"))
    found = found.select("s.k1", F.transform(words(F.col("s.line")), lambda x: F.xxhash64(x)).alias("h"))
    wide = [q.alias(f"q{k}") for k, q in enumerate(wide_parity(F.col("h"), WIDE))]
    return found.select("k1", symbols(F.col("h")).alias("sym"), *wide).dropDuplicates(["k1"])


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    x, y = full.select(F.col("k1").alias("a"), F.col("sym").alias("x")), full.select(F.col("k1").alias("b"), F.col("sym").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(similar(F.col("x"), F.col("y"))).select("a", "b")


def clean(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the removed lines cut out of their texts, plus _n_lines and _n_removed; all other columns and rows as before.

    A text that loses all its lines is '', a null text stays null.
    """
    gone = removals(spark, docs, id_col, text_col).select(F.col("id").alias("_ld_id"), F.col("dk").alias("_ld_dk"), F.col("removed").alias("_ld_gone"))
    d = docs.withColumn("_ld_key", F.xxhash64(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    parts = F.split(text_col, "\n")
    text = F.when(F.col("_ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_ld_gone", i)), "\n"))
    joined = d.join(gone, F.col(id_col).eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_dk")), "left")
    kept = [text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*kept, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("_n_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("_n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clean(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")
