"""Structured Streaming jobs over an event folder: windows with late data, first sightings, and state per key.

Each job runs through what is there (availableNow) and keeps its progress and state in a checkpoint, so a later run goes on from it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def place(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names; only in local mode, where all share a disk, a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table of a data folder as a stream: its files, whether it is one file or a folder of them."""
    schema, p = spark.read.parquet(path).schema, spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run(spark: SparkSession, df: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows that a stream gives until it has read all: in complete mode those of the last batch, in update mode each key's latest.

    Each batch has a folder of its own, which it writes anew, so a batch that runs again after a failure leaves its rows once.
    """
    out, check = place(spark, name), place(spark, f"{name}-state")
    schema = StructType([*df.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/_batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={0 if mode == 'complete' else n}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(out)
    if mode == "update":
        others = [c for c in df.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("r")).select(*keys, "r.*")
    return rows.select(*df.columns)


def daily_counts(events: DataFrame) -> DataFrame:
    """Events and their values by day and kind; rows up to two days late still count, and state older than that is let go."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def first_sightings(events: DataFrame, keys: list[str], wait: str = "2 days") -> DataFrame:
    """Each combination of keys once a day. State of a day is let go when rows of it can't come any more, `wait` after the latest row."""
    day = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", wait).withColumn("w", F.window("ts", "1 day"))
    return day.select(*keys, "w").dropDuplicates([*keys, "w"]).select(*keys, F.to_date("w.start").alias("day"))


REMINDER = "user_id long, alerts long, last_value double"


def _remind(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count rises over the value before, in the order of time; the last value is what is remembered between batches."""
    last, alerts = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for v in rows["value"]:
        if pd.isna(v):
            continue
        if last is not None and v > 1.5 * last > 0:
            alerts += 1
        last = float(v)
    state.update((last, alerts))
    yield pd.DataFrame({"user_id": [key[0]], "alerts": [alerts], "last_value": [last]})


def rises(events: DataFrame) -> DataFrame:
    """Per user, how often a value was more than half above the one before, and the last value."""
    e = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.groupBy("user_id").applyInPandasWithState(_remind, REMINDER, "last double, alerts long", "update", GroupStateTimeout.NoTimeout)
