"""Embedding whitening on MLlib block matrices: scatter of the centred rows, local eigenvectors, projection of all rows.

Vectors become whole numbers first, so counts, sums and deviations are exact. The fit list holds each distinct vector once. Its rows, centred,
are an indexed matrix dealt into distributed blocks; the transpose times the matrix is the scatter, whose d x d eigenproblem is solved
on the driver; a second block product with the whitening matrix projects every row, repeated ones too.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .topk import finite

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Doubles of one block (2 MB), so a block's rows follow from the width. A driver-side matrix has the squared width: up to 4096 it is 128 MB.
BLOCK = 1 << 18
#: Row blocks that one task of the scatter product holds, twice; the number of its tasks follows from the rows.
TASK_BLOCKS = 8
#: Scaled components beyond this count as it.
FARTHEST = float(1 << 40)
#: A component whose eigenvalue is below this share of the trace is no direction of the data.
LEAST = 1e-12
LONG = (1 << 63) - 1


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the rows whose vector has entries, all finite, as whole numbers floor(64 c) + 1000000; of several widths only the most frequent (the smaller of equals)."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = finite(v).where(F.size("v") > 0)
    far = F.lit(FARTHEST)
    v = v.select("id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, far), -far)).cast("long") + SHIFT).alias("x"))
    widths = v.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(2).collect()
    return v.where(F.size("x") == widths[0].d) if len(widths) > 1 else v


def indexed(spark: SparkSession, scratch: Scratch, df: DataFrame) -> tuple[DataFrame, int]:
    """`df` with `at`, a number from 0 without gaps, and the number of its rows. The driver sees one count for each written partition."""
    table = scratch.keep(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = sorted((r.p, r.n) for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    first, total = [], 0
    for p, n in counts:
        first.append((p, total))
        total += n
    starts = spark.createDataFrame(first, "_p long, _first long")
    out = table.join(F.broadcast(starts), part == F.col("_p")).withColumn("at", F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_m", "_p", "_first"), total


class Fit:
    """The fit list's size and, for each dimension, its sum and ends; exact."""

    def __init__(self, fit: DataFrame, n: int):
        at = fit.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        self.n, self.d = n, len(at)
        at.sort()
        self.sums = [r.s for r in at]
        ends = [max(abs(n * r.lo - r.s), abs(n * r.hi - r.s)) for r in at]
        self.fits = sum(e * e for e in ends) <= LONG and max([n * max(abs(r.lo), abs(r.hi)) for r in at], default=0) <= LONG

    def apart(self) -> Column:
        """n * x - sum by dimension: longs where all of them, and the sum of their squares, fit one; else decimals."""
        kind = "long" if self.fits else "decimal(38,0)"
        s = F.array(*[F.lit(str(v)).cast(kind) for v in self.sums])
        return F.transform("x", lambda v, i: v.cast(kind) * F.lit(self.n).cast(kind) - F.get(s, i))

    def centred(self) -> Column:
        return array_to_vector(F.transform(self.apart(), lambda v: v.cast("double") / float(self.n)))

    def deviation(self) -> Column:
        """The exact sum of squares of `apart`; null where it is beyond a long."""
        if self.fits:
            return F.aggregate(self.apart(), F.lit(0).cast("long"), lambda a, v: a + v * v)
        wide = F.aggregate(self.apart(), F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v)).cast("decimal(38,0)"))
        return wide.try_cast("long")


def _blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """(at, v) as a distributed matrix of row blocks."""
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, d).toBlockMatrix(max(1, BLOCK // d), d)


def _times(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """a * b; the middle dimension is dealt to so many tasks that each has few of its blocks."""
    splits = max(1, ceil(a.numCols() / a.colsPerBlock / TASK_BLOCKS))
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def _gram(a: BlockMatrix) -> np.ndarray:
    return _times(a.transpose(), a).toLocalMatrix().toArray()


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error), one row for each vector that takes part.

    whitened and explained are arrays by falling eigenvalue; there are as many as directions in which the fit list varies (eigenvalue above
    1e-12 of the trace), `components` at most. Rows whose vector is null, empty or holds null or non-finite entries are left out, and those of
    another width than most; a null id is kept. Repeated rows weigh once in the fit and come out each time. Scaled entries beyond 2^40 count
    as that; a deviation beyond a long is null. Without rows, or if all vectors are equal, the result is empty. Other columns are not read.
    The driver holds d x d matrices and one count for each partition; all else stays distributed.
    """
    scratch = Scratch(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    rows, total = indexed(spark, scratch, whole(vectors, id_col, vec_col))
    fit, n = indexed(spark, scratch, rows.select("x").distinct())
    if n < 2:
        return empty
    f = Fit(fit, n)
    m = _blocks(fit.select("at", f.centred().alias("v")), n, f.d)
    cov = _gram(m) / n
    e, vectors_of = np.linalg.eigh((cov + cov.T) / 2)
    order = [i for i in np.argsort(-e) if e[i] > LEAST * np.trace(cov)][:components]
    if not order:
        return empty
    k, share = len(order), [float(x) for x in e[order] / np.trace(cov)]
    w = vectors_of[:, order] / np.sqrt(e[order])
    matrix = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(f.d, k, w.ravel("F")))], 1), f.d, k)
    # the columns are sums of centred ones, so they are centred
    error = float(np.abs(_gram(_times(m, matrix)) / n - np.eye(k)).max())
    projected = _times(_blocks(rows.select("at", f.centred().alias("v")), total, f.d), matrix).toIndexedRowMatrix()
    got = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("at", "w").select("at", vector_to_array("w").alias("whitened"))
    out = rows.select("at", "id", f.deviation().alias("deviation")).join(got, "at")
    return out.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, share)).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whiten(spark, read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    by = got.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return by.select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
