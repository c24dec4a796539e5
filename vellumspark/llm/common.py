"""Scratch tables, table access and connected components for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 2000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of whole texts must fit beside the JVM heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where all share a disk, one is made where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Tables that cut lineage. They live in the shared folder, so they outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.n, self.live = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` as a written table. Its shuffle files go as soon as it is written, since nothing runs the plan again."""
        self.n += 1
        at = f"{self.base}/{self.n}"
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._vellum_at = at
        self.live[at] = True
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        self._delete([t._vellum_at for t in tables])

    def drop_all(self, but: tuple[DataFrame, ...] = ()) -> None:
        """Delete all tables but those that the result still reads."""
        stay = {t._vellum_at for t in but}
        self._delete([at for at in self.live if at not in stay])

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for at in paths:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
            self.live.pop(at, None)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b longs): root is the smallest node that it reaches.

    Alternates large-star and small-star steps, each one shuffle by node with partial minima, until no
    edge changes; the number of steps is logarithmic in a component's diameter. Self-links and null ends are ignored.
    """
    def norm(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node has one smaller neighbour, which has none."""
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()

    cur = scratch.keep(norm(edges.select("a", "b")))
    for _ in range(rounds):
        if settled(cur):
            break
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        nxt = scratch.keep(norm(small))
        scratch.drop(cur)
        cur = nxt
    else:
        raise RuntimeError("connected components did not settle")
    # settled: each a has one b
    out = scratch.keep(cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    scratch.drop(cur)
    return out
