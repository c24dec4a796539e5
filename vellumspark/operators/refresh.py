"""A derived table that is kept up to date: only what changed at its sources is worked out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of the table; a part is read and written as a whole.
PARTS = 64


class Derived:
    """One row or several for each source, in `parts` by a hash of the source's key, every part in the folder of the version that wrote it last.

    A version is a folder with the parts that it wrote and, written last, a list of which version holds each part: readers take the
    newest list, so they see a refresh as a whole or not at all. `build` makes the derived rows of sources; the table has its columns, the
    key and `source_hash`. Sources with a null key are left out; of several rows of a key the one with the least hash counts.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, content: list[str], build: Callable[[DataFrame], DataFrame], parts: int = PARTS):
        self.spark, self.base, self.key, self.content, self.build, self.parts = spark, base, key, content, build, parts

    def hashed(self, sources: DataFrame) -> DataFrame:
        """Sources with _hash over what matters and _part. A source of another key that looks the same has the same hash."""
        h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in self.content]), {"ignoreNullFields": "false"}), 256)
        s = sources.where(F.col(self.key).isNotNull()).withColumn("_hash", h).withColumn("_part", self.part())
        first = s.groupBy(self.key).agg(F.min("_hash").alias("_hash"))
        return s.join(first, [self.key, "_hash"], "left_semi").dropDuplicates([self.key])

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def versions(self) -> dict[int, int]:
        """The version that holds each part; empty before the first refresh."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.base}/lists")
        files = at.getFileSystem(conf)
        if not files.exists(at):
            return {}
        done = [int(n) for n in (x.getPath().getName() for x in files.listStatus(at)) if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.base}/lists/{n}/_SUCCESS"))]
        return {r.part: r.version for r in self.spark.read.parquet(f"{self.base}/lists/{max(done)}").collect()} if done else {}

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its parts; None where there is nothing yet."""
        held = {p: v for p, v in self.versions().items() if parts is None or p in parts}
        return self.spark.read.option("basePath", self.base).parquet(*[f"{self.base}/version={v}/_part={p}" for p, v in sorted(held.items())]).drop("version", "_part") if held else None

    def state(self, sources: DataFrame) -> DataFrame:
        """(key, state, part): fresh, changed, new or missing for each source of now and of then. Of the table only keys and hashes are read."""
        now = self.hashed(sources).select(self.key, "_hash", "_part")
        was = self.read()
        then = was.select(self.key, "source_hash").distinct() if was is not None else now.select(self.key, F.col("_hash").alias("source_hash")).limit(0)
        j = now.join(then, self.key, "full_outer")
        state = F.when(F.col("_hash").isNull(), "missing").when(F.col("source_hash").isNull(), "new").when(F.col("_hash") == F.col("source_hash"), "fresh").otherwise("changed")
        return j.select(self.key, state.alias("state"), F.coalesce("_part", self.part()).alias("part"))

    def refresh(self, sources: DataFrame) -> dict[str, int]:
        """Bring the table up to date; gives the number of sources by state, and of parts that were written.

        Only changed and new sources are built; a part that has such or missing ones is read, and written anew with what is fresh. Where all is
        fresh nothing is written. A refresh that fails leaves its folder, which no list names, and the table as it was.
        """
        held = self.versions()
        version = max(held.values(), default=0) + 1
        states = f"{self.base}/states/{version}"
        self.state(sources).write.mode("overwrite").parquet(states)
        state = self.spark.read.parquet(states)
        counts = {r.state: r.n for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
        stale = sorted(r.part for r in state.where("state <> 'fresh'").select("part").distinct().collect())
        if not stale:
            return counts | {"parts": 0}
        build = self.hashed(sources).join(state.where("state IN ('changed', 'new')").select(self.key), self.key, "left_semi")
        hashes = build.select(self.key, F.col("_hash").alias("source_hash"))
        rows = self.build(build.drop("_hash", "_part")).join(hashes, self.key)
        old = self.read(stale)
        if old is not None:
            rows = rows.unionByName(old.join(state.where("state = 'fresh'").select(self.key), self.key, "left_semi"))
        rows.withColumn("_part", self.part()).write.mode("overwrite").partitionBy("_part").parquet(f"{self.base}/version={version}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(f"{self.base}/version={version}")
        written = {int(n.partition("=")[2]) for n in (x.getPath().getName() for x in there.getFileSystem(conf).listStatus(there)) if n.startswith("_part=")}
        now = {p: v for p, v in held.items() if p not in stale} | {p: version for p in stale if p in written}
        self.spark.createDataFrame(sorted(now.items()), "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/lists/{version}")
        return counts | {"parts": len(stale)}
