"""Chat formatting on DataFrame functions: conversations that were logged again while they grew are collapsed to the longest.

Each turn has a hash of its position, role and text; the rolling hash of a prefix is the exclusive or of its turns' hashes, twice
64 bits. A conversation whose whole hash is the hash of a proper prefix of another is dropped by an anti-join, equal ones are
kept once, and what stays is rendered. Positions and rolling hashes are found cell by cell of CELL turns, so that a
conversation of any length is spread over tasks until its text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read

CELL = 1024


def _value(c: str) -> list[Column]:
    return [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]


def _turns(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, and c1, c2: what the turn says, as two hashes."""
    t = convs.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where(F.col("conv").isNotNull())
    said = [*_value("role"), *_value("text")]
    return t.withColumn("turn", F.coalesce("turn", F.lit((1 << 62)))).withColumn("c1", F.xxhash64(*said)).withColumn("c2", F.xxhash64(F.lit(1), *said))


def _running(df: DataFrame, scratch: Scratch, cell: Column, order: list[str], aggs: dict[str, tuple]) -> DataFrame:
    """`df` with running aggregates per conversation in the given order: those of earlier cells, joined with those within the cell.

    aggs: name -> (function, column, how two results are put together).
    """
    df = scratch.keep(df.withColumn("cell", cell))
    sums = df.groupBy("conv", "cell").agg(*[f(c).alias(f"in_{k}") for k, (f, c, _) in aggs.items()])
    before = W.partitionBy("conv").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    again = {k: F.sum if f is F.count else f for k, (f, _, _) in aggs.items()}
    sums = sums.select("conv", "cell", *[F.coalesce(f(f"in_{k}").over(before), F.lit(0)).alias(f"pre_{k}") for k, f in again.items()])
    within = W.partitionBy("conv", "cell").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.select("*", *[f(c).over(within).alias(f"own_{k}") for k, (f, c, _) in aggs.items()]).join(sums, ["conv", "cell"])
    return df.withColumns({k: put(F.col(f"pre_{k}"), F.col(f"own_{k}")) for k, (_, _, put) in aggs.items()}).drop("cell", *[f"{p}_{k}" for k in aggs for p in ("pre", "own")])


def maximal(spark: SparkSession, convs: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, c1, c2, pos, n) of the conversations that stay: no longer one begins with them, and of equal ones the smallest id.

    Turns are in order of their number (none: last), equal numbers in order of a hash of what they say; a row given twice counts
    once. Only order and content compare, not the numbers. Null roles and texts are values of their own. Rows without conversation
    id belong to none and are left out. An empty table gives no rows; other columns are not read.
    """
    turns = _turns(convs, conv_col, turn_col, role_col, text_col).select("conv", "turn", "c1", "c2").distinct()
    turns = _running(turns, scratch, F.floor(F.col("turn") / CELL), ["turn", "c1", "c2"], {"rank": (F.count, F.lit(1), lambda a, b: a + b)})
    turns = turns.select("conv", "turn", "c1", "c2", (F.col("rank") - 1).alias("pos"))
    marked = turns.withColumn("h1", F.xxhash64("pos", "c1", "c2")).withColumn("h2", F.xxhash64(F.lit(1), "pos", "c1", "c2"))
    xor = lambda a, b: a.bitwiseXOR(b)
    rolled = _running(marked, scratch, F.floor(F.col("pos") / CELL), ["pos"], {"r1": (F.bit_xor, F.col("h1"), xor), "r2": (F.bit_xor, F.col("h2"), xor)})
    rolled = scratch.keep(rolled.select("conv", "turn", "c1", "c2", "pos", "r1", "r2"))
    lengths = scratch.keep(rolled.groupBy("conv").agg((F.max("pos") + 1).alias("n")))
    sized = rolled.join(lengths, "conv")
    proper = sized.where(F.col("pos") + 1 < F.col("n")).select((F.col("pos") + 1).alias("n"), "r1", "r2").distinct()
    whole = sized.where(F.col("pos") + 1 == F.col("n")).groupBy("n", "r1", "r2").agg(F.min("conv").alias("conv"))
    kept = scratch.keep(whole.join(proper, ["n", "r1", "r2"], "left_anti").select("conv", "n"))
    return rolled.select("conv", "turn", "c1", "c2", "pos").join(kept, "conv")


def render(spark: SparkSession, convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, text): the conversations that stay, each turn as <|im_start|>role, newline, text, <|im_end|>, newline.

    Turns are put together cell by cell of CELL turns and then the cells, so that a task holds texts no longer than the rows that come
    out. Null roles and texts are rendered as ''.
    """
    scratch = Scratch(spark)
    stay = maximal(spark, convs, scratch, conv_col, turn_col, role_col, text_col)
    said = _turns(convs, conv_col, turn_col, role_col, text_col).dropDuplicates(["conv", "turn", "c1", "c2"])
    piece = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    full = said.join(stay, ["conv", "turn", "c1", "c2"]).select("conv", F.floor(F.col("pos") / CELL).alias("cell"), "n", F.col("pos").alias("at"), piece.alias("piece"))
    cells = _joined(full.withColumn("n_turns", F.col("n")), ["conv", "cell"])
    return _joined(cells.withColumnsRenamed({"cell": "at", "text": "piece"}), ["conv"])


def _joined(df: DataFrame, by: list[str]) -> DataFrame:
    """Per key: n_turns, and the pieces one after another in the order of `at`."""
    groups = df.groupBy(*by).agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
    return groups.select(*by, "n_turns", F.array_join(F.col("ps.piece"), "").alias("text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, read(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")
