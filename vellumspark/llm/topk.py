"""Exact top-k by inner product: score everything, refine score histograms to each kth value, filter, break ties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, prepare, read

SCALE = 1024
K = 10
BINS = 1024
#: Queries that are answered together. Their matrix is broadcast, so this bounds what the driver and a task hold.
QUERY_BLOCK = 2048
LOW = -(1 << 63)
EXACT = float(1 << 53)


def pack(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Blocks of scaled vectors of one width: dim, ids (int64), m (float64, rows of dim; whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            out = {"dim": [], "ids": [], "m": [], "top": []}
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                m = np.floor(SCALE * flat[(offsets[at][:, None] + np.arange(dim)[None, :]).ravel()]).reshape(len(at), dim)
                out["dim"].append(int(dim))
                out["ids"].append(ids[at].astype("<i8").tobytes())
                out["m"].append(m.astype("<f8").tobytes())
                out["top"].append(float(np.abs(m).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(out["dim"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["m"], pa.binary()), pa.array(out["top"], pa.float64())], names=["dim", "ids", "m", "top"])

    return sound(vectors, id_col, vec_col).mapInArrow(run, "dim int, ids binary, m binary, top double")


def finite(rows: DataFrame) -> DataFrame:
    """The rows whose vector `v` (doubles) is there and holds neither null nor non-finite components."""
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~bad)


def sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector of finite components."""
    return finite(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull()))


class Queries:
    """A block of queries of any widths, with the score interval that still may hold each one's kth value."""

    def __init__(self, rows: list[tuple[int, list[float]]], top: float, k: int):
        self.k, self.of = k, {}
        self.ids = np.array([r[0] for r in rows], np.int64)
        vs = [np.floor(SCALE * np.array(r[1], np.float64)) for r in rows]
        for dim in {len(v) for v in vs}:
            at = np.array([i for i, v in enumerate(vs) if len(v) == dim])
            self.of[dim] = (at, np.stack([vs[i] for i in at]).reshape(len(at), dim))
        bound = [min(-LOW - 1, int(sum(abs(int(x)) for x in v)) * int(top)) for v in vs]
        self.lo = np.array([max(LOW, -b) for b in bound], np.int64)
        self.hi = np.array(bound, np.int64)
        self.width = np.array([(2 * b + BINS) // BINS for b in bound], object).astype(np.uint64)
        self.need = np.full(len(rows), k, np.int64)

    def scores(self, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query positions, scores as int64, whether it counts) for the queries as wide as `m`; beyond the range of a long, a score is its nearest end."""
        at, q = self.of[m.shape[1]]
        if np.abs(m).max(initial=0) * np.abs(q).max(initial=0) * max(1, m.shape[1]) < EXACT:
            s = (m @ q.T).astype(np.int64)
        else:
            wide = [[int(x) for x in r] for r in m] if m.size else []
            s = np.array([[min(-LOW - 1, max(LOW, sum(x * int(y) for x, y in zip(r, v, strict=True)))) for v in q] for r in wide], np.int64).reshape(len(m), len(at))
        return at, s, ids[:, None] != self.ids[at][None, :]


def _blocks(batches, q: Queries):
    for batch in batches:
        for dim, ids, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if dim in q.of:
                i = np.frombuffer(ids, "<i8")
                yield i, *q.scores(i, np.frombuffer(m, "<f8").reshape(len(i), dim))


def _histogram(shared):
    """Per block and query, the bins of the `need` best scores in the query's interval: no other score of the block can be the kth of all."""

    def run(batches):
        q = shared.value
        for _, at, s, ok in _blocks(batches, q):
            lo, hi, width = q.lo[at], q.hi[at], q.width[at]
            # distances from lo as unsigned numbers: exact over the whole range of a long
            off = (s.view(np.uint64) - lo.view(np.uint64)[None, :]) // width[None, :]
            off = np.where(ok & (s >= lo[None, :]) & (s <= hi[None, :]), off, np.uint64(BINS)).astype(np.int64)
            off[off == BINS] = -1
            k = min(int(q.need[at].max(initial=1)), len(off))
            best = -np.sort(-np.partition(off, len(off) - k, axis=0)[len(off) - k :], axis=0)
            keep = (best >= 0) & (np.arange(k)[:, None] < q.need[at][None, :])
            key, n = np.unique((at[None, :] * BINS + best)[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // BINS, pa.int32()), pa.array(key % BINS, pa.int32()), pa.array(n, pa.int64())], names=["q", "bin", "n"])

    return run


def _best(shared):
    """What beats the kth score, and of the rows that equal it as many of the smallest ids as are wanted."""

    def run(batches):
        q = shared.value
        for ids, at, s, ok in _blocks(batches, q):
            order = np.argsort(ids, kind="stable")
            ids, s, ok = ids[order], s[order], ok[order]
            tie = ok & (s == q.lo[at][None, :])
            take = ok & (s > q.lo[at][None, :]) | tie & (np.cumsum(tie, axis=0) <= q.need[at][None, :])
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[at[j]], pa.int64()), pa.array(ids[i], pa.int64()), pa.array(s[i, j], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all of `vectors` but its own id.

    Null vectors or ids, and vectors with null or non-finite components, take no part; vectors of another width than the query's
    aren't its candidates; ties go to the smaller id. Repeated query rows count once, repeated candidates each time. A score beyond
    a long counts as the nearest long. Fewer than k candidates are all given; empty tables give no rows. Other columns are not read.
    Queries go in blocks of QUERY_BLOCK: a block is broadcast, and each pass over the vectors returns bins or rows that grow with
    queries and vector blocks, not with their product.
    """
    prepare(spark)
    scratch = Scratch(spark)
    packed = scratch.keep(pack(vectors, id_col, vec_col))
    top = packed.agg(F.max("top")).first()[0] or 0.0
    out, block = f"{scratch.base}/out", []
    spark.createDataFrame([], "query_id long, vec_id long, score long").write.parquet(out)

    def answer(rows):
        q = _thresholds(spark, packed, Queries(rows, top, k))
        packed.mapInArrow(_best(spark.sparkContext.broadcast(q)), "query_id long, vec_id long, score long").write.mode("append").parquet(out)

    for r in sound(queries, id_col, vec_col).distinct().orderBy("id").toLocalIterator():
        block.append((r.id, r.v))
        if len(block) == QUERY_BLOCK:
            answer(block)
            block = []
    if block:
        answer(block)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema("query_id long, vec_id long, score long").parquet(out).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _thresholds(spark: SparkSession, packed: DataFrame, q: Queries) -> Queries:
    """Narrow every interval until it is one score: then lo is the kth score, and need the number of ties wanted."""
    while True:
        h = packed.mapInArrow(_histogram(spark.sparkContext.broadcast(q)), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        need = F.element_at(F.lit([int(x) for x in q.need]), F.col("q") + 1)
        above = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
        cut = h.withColumn("above", above).where(F.col("above") - F.col("n") < need).groupBy("q").agg(F.min_by(F.struct("bin", (F.col("above") - F.col("n")).alias("more"), "above"), "bin").alias("c"))
        wide = q.width.copy()
        done = {r.q: r.c for r in cut.collect()}
        for i in range(len(q.ids)):
            c = done.get(i)
            if c is None or c.above < q.need[i]:  # fewer candidates than wanted: all of them
                q.lo[i], q.width[i] = LOW, 1
                q.need[i] = max(q.need[i], 1)
                wide[i] = 1
                continue
            q.lo[i] = int(q.lo[i]) + c.bin * int(wide[i])
            q.hi[i] = min(int(q.hi[i]), int(q.lo[i]) + int(wide[i]) - 1)
            q.need[i] -= c.more
            q.width[i] = -(-int(wide[i]) // BINS)
        if (wide == 1).all():
            return q


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return search(spark, v, v.where(F.col("vec_id") % 100 == 0))
