"""Best-fit-decreasing packing of indivisible groups of rows into shards of near equal bytes."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read

N_SHARDS = 40
OVERHEAD = 16
#: Rows of one shard, and groups of one size, are numbered in this many cells at least, one more for each CELL_ROWS rows of a shard.
CELLS, CELL_ROWS = 64, 200_000


class Bins:
    """Open bins by remaining capacity in a treap: insert, remove and tightest fit take logarithmic time."""

    def __init__(self):
        self.root, self.rand = None, random.Random(7)

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.rand.random(), None, None]), high)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that is at least `need`."""
        low, high = self._split(self.root, (need, -1))
        if high is None:
            self.root = low
            return None
        at = high
        while at[2] is not None:
            at = at[2]
        _, rest = self._split(high, (at[0][0], at[0][1] + 1))
        self.root = self._merge(low, rest)
        return at[0]

    def _split(self, t, key):
        """Keys below `key`, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, count) of the descending `sizes`, the runs (bin, how many) that take its items one after another.

    Items of one size are alike, and the tightest bin stays the tightest until it can't hold another, so it takes as many as fit
    at once. An item over `capacity` gets a bin of its own. None if more than `most` bins open.
    """
    bins, opened, out = Bins(), 0, []
    for size, count in sizes:
        runs = []
        while count:
            found = bins.take(size)
            if found is None:
                if opened == most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, b = found
            n = min(count, room // size)
            count -= n
            runs.append((b, n))
            bins.insert((room - n * size, b))
        out.append(runs)
    return out


def pack_evenly(sizes: list[tuple[int, int]], n: int, precision: float = 2e-5) -> list[list[tuple[int, int]]]:
    """The runs (bin from 0 to n - 1, how many) of each (size, count) of the descending `sizes`, by best fit at the least capacity that needs n bins at most."""
    rest, left, own, tail = sum(s * c for s, c in sizes), n, [], list(sizes)
    while tail and left > 1 and tail[0][0] * left > rest:  # larger than the mean of what remains: a bin of its own
        size, count = tail[0]
        own.append((size, n - left))
        rest, left = rest - size, left - 1
        tail = ([(size, count - 1)] if count > 1 else []) + tail[1:]
    low = max(-(-rest // left), tail[0][0] if tail else 0)
    high, best = low, best_fit(tail, low, left)
    while best is None:
        high += max(1, high // 50)
        best = best_fit(tail, high, left)
    while high - low > max(1, int(low * precision)):
        mid = (low + high) // 2
        found = best_fit(tail, mid, left)
        low, high, best = (low, mid, found) if found is not None else (mid, high, best)
    of: dict[int, list[tuple[int, int]]] = {}
    for size, b in own:
        of.setdefault(size, []).append((b, 1))
    for (size, _), runs in zip(tail, best, strict=True):
        of.setdefault(size, []).extend((b + len(own), c) for b, c in runs)
    return [of[size] for size, _ in sizes]


def assign(spark: SparkSession, docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard, slot.

    Equal texts stay in one shard, as a group. Null texts form one group of size 16 a row (text_crc32 null), empty
    texts another (text_crc32 0). Null ids and repeated rows get slots of their own; ties among them are free.
    An empty table gives no rows. Other columns are not read. A group above the mean shard gets a shard alone.
    Every group is packed by best fit. The driver packs distinct sizes with their counts; as k distinct sizes add up to k * k / 2
    bytes or more, they are fewer than the square root of twice the corpus (14 million at 100 TB). Texts are read once; a narrow
    table of ids, sizes and hashes is all that moves.
    """
    scratch = Scratch(spark)
    t = F.col(text_col)
    slim = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(t, "UTF-8")).alias("crc"),
            F.when(t.isNull(), F.lit(0)).otherwise(F.xxhash64(t, F.octet_length(t))).alias("g1"),
        ).withColumn("c1", F.coalesce("crc", F.lit(-1)))
    )
    key = ["g1", "c1", "size"]
    groups = scratch.keep(slim.groupBy(*key).agg(F.sum("size").alias("bytes")))
    counts = groups.groupBy("bytes").count().toArrow()
    sizes = sorted(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True), reverse=True)
    runs = pack_evenly(sizes, n_shards) if sizes else []
    rows = []
    for (size, _), rs in zip(sizes, runs, strict=True):
        at = 0
        for b, n in rs:
            rows.append((size, at, at + n, b))
            at += n
    plan = spark.createDataFrame(pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("bytes", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("shard", pa.int32())))}))
    plan = scratch.keep(plan.groupBy("bytes").agg(F.collect_list(F.struct("begin", "end", "shard")).alias("runs")))  # n_shards runs of a size at most
    ranked = _ranked(groups, ["bytes"], F.pmod(F.xxhash64(*key), F.lit(CELLS)).cast("int"), key, "at")
    mine = F.filter("runs", lambda r: (r["begin"] <= F.col("at")) & (F.col("at") < r["end"]))
    placed = scratch.keep(ranked.join(plan, "bytes").select(*key, F.get(mine, F.lit(0))["shard"].alias("shard")))
    rows = slim.join(placed, key).select("id", "size", "crc", "g1", "shard")
    cells = max(CELLS, -(-slim.count() // (CELL_ROWS * n_shards)))
    out = _ranked(scratch.keep(rows), ["shard"], F.pmod(F.xxhash64("id", "g1"), F.lit(cells)).cast("int"), ["id", "crc", "size"], "slot")
    return out.select("id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


def _ranked(df: DataFrame, by: list[str], cell: Column, order: list[str], out: str) -> DataFrame:
    """`df` with `out`, gapless numbers from 0 among the rows of equal `by`, without one task for each: a row's rank in its cell, after the sizes of the earlier cells."""
    df = df.withColumn("_cell", cell)
    counts = df.groupBy(*by, "_cell").count()
    before = counts.select(*by, "_cell", (F.sum("count").over(W.partitionBy(*by).orderBy("_cell")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(W.partitionBy(*by, "_cell").orderBy(*order))
    return df.withColumn("_rank", rank).join(before, [*by, "_cell"]).withColumn(out, F.col("_before") + F.col("_rank") - 1).drop("_cell", "_rank", "_before")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` (unique ids) as Parquet under path/shard=N, rows ordered by slot."""
    where = assign(spark, docs, n_shards, id_col, text_col).select(F.col("id").alias(id_col), "shard", "slot")
    docs.drop("shard", "slot").join(where, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assign(spark, read(spark, sf_dir, "documents"))
    return a.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
