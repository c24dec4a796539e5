"""Watching: changes of a page or value against what was seen last, new items of a feed, late matches, and a mailbox read with a watermark."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from .jobs import place

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "watched string, at timestamp, seq long, before string, after string"


class Watch(StatefulProcessor):
    """The last content of a watched thing. The first sight is a baseline, equal content is no change, null content (blocked, failed) is skipped."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # a task sees a thing's rows of one batch in pieces; only their order in time matters, so they are sorted together
        new = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, seq, content in zip(new["at"], new["seq"], new["content"], strict=True):
            if content is None:
                continue
            if last is not None and content != last:
                out.append((key[0], at, seq, last, content))
            last = content
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["watched", "at", "seq", "before", "after"])

    def close(self) -> None:
        pass


class Feed(StatefulProcessor):
    """The items of a feed that were seen, each for a time. The first batch of a feed is a baseline: remembered, not told."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "since long")
        self.seen = handle.getMapState("seen", "item string", "n long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        baseline, first, came = not self.known.exists(), None, {}
        if baseline:
            self.known.update((int(timerValues.getCurrentProcessingTimeInMs()),))
        # state is asked for once an item, not once a row
        for part in rows:
            least = part["batch"].min()
            first = least if first is None else min(first, least)
            for item, n in part[part["item"].fillna("") != ""].groupby("item")["batch"].min().items():
                came[item] = min(n, came.get(item, n))
        out = []
        for item, n in came.items():
            if not self.seen.containsKey((item,)):
                self.seen.updateValue((item,), (1,))
                if not baseline or n > first:
                    out.append((key[0], item))
        yield pd.DataFrame(out, columns=["feed", "item"])

    def close(self) -> None:
        pass


@contextmanager
def stateful(spark: SparkSession):
    """Settings under which these streams start: a provider with values, maps and expiry, and no batches without data, which state that expires would ask for without end."""
    want = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def page_changes(seen: DataFrame, keep: str = "90 days") -> DataFrame:
    """(watched, at, seq, before, after): each change of what a watched thing shows. seen: a stream of (watched, at, seq, content).

    Rows of later batches are taken as later; within a batch they go by (at, seq). A thing that isn't seen for `keep` is forgotten, its next sight is a
    baseline again.
    """
    return seen.select("watched", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "content").groupBy("watched").transformWithStateInPandas(Watch(_ms(keep)), CHANGE, "append", "processingTime")


def new_items(items: DataFrame, keep: str = "400 days") -> DataFrame:
    """(feed, item): items that a feed did not have before; its first batch is the baseline. items: a stream of (feed, item); null and empty items are none.

    A stream may have a column batch, the number of the source's batch, where Spark takes several of those at once.
    """
    batch = F.col("batch").cast("long") if "batch" in items.columns else F.lit(0).cast("long").alias("batch")
    return items.select("feed", "item", batch).groupBy("feed").transformWithStateInPandas(Feed(_ms(keep)), "feed string, item string", "append", "processingTime")


def _ms(days: str) -> int:
    n, unit = days.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def late_matches(wanted: DataFrame, found: DataFrame, days: int = 45, late: str = "0 days") -> DataFrame:
    """(key, at, found_at): each wanted row with what was found for its key within `days` after it; found_at is null once nothing can come any more.

    Both are streams with (key, at). Unmatched rows wait in state until the watermark, the earlier one of both sides, passes the end of their time;
    matched ones come out at once. State older than that is let go.
    """
    w = wanted.select(F.col("key"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    f = found.select(F.col("key").alias("fkey"), F.col("at").cast("timestamp").alias("found_at")).withWatermark("found_at", late)
    within = (F.col("found_at") >= F.col("at")) & (F.col("found_at") <= F.col("at") + F.expr(f"INTERVAL {int(days)} DAYS"))
    return w.join(f, (F.col("key") == F.col("fkey")) & within, "leftOuter").select("key", "at", "found_at")


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class MailboxReader(DataSourceStreamReader):
    """Rows of a table in the order of a whole-number id, in batches of `step` ids, of which Spark takes `at_once` together, dealt into `tasks` ranges.

    A column of the schema that the option `batch` names is no column of the table: it is filled with the number of the batch, from 0.

    The offset is the first id not yet read. Spark asks for it again only after a batch is filed, and says so by commit(), which moves the watermark, a
    small file; a new run goes on from there, and a batch that failed is read again with the offsets it had.
    """

    def __init__(self, options: dict, names: list[str]):
        self.path, self.id, self.names, self.mark = options["path"], options.get("id", "event_id"), names, options.get("watermark")
        self.step, self.tasks, self.at_once, self.batch = int(options.get("step", 4000)), int(options.get("tasks", 4)), int(options.get("at_once", 1)), options.get("batch")
        # a batch of rows at a time, so the ids are never all held
        ends = [e for b in self._table().to_batches(columns=[self.id]) if (e := pc.min_max(b.column(0)).as_py())["min"] is not None]
        self.first, last = min((e["min"] for e in ends), default=0), max((e["max"] for e in ends), default=None)
        self.end = self.first if last is None else last + 1
        self.reached = self._watermark() or self.first

    def _table(self):
        return ds.dataset(self.path.removeprefix("file://"), format="parquet")

    def _watermark(self) -> int | None:
        if not self.mark:
            return None
        files, path = fs.FileSystem.from_uri(self.mark)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())["next"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        self.reached = min(self.end, self.reached + self.step * self.at_once)
        return {"next": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["next"], end["next"]
        self.reached = max(b, self.reached)
        cuts = [a + (b - a) * k // self.tasks for k in range(self.tasks + 1)]
        return [_Range(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if x < y]

    def read(self, partition: _Range) -> Iterator:
        names, within = [n for n in self.names if n != self.batch], (ds.field(self.id) >= partition.first) & (ds.field(self.id) < partition.end)
        if len(names) == len(self.names):
            yield from self._table().to_batches(columns=names, filter=within)
            return
        number = {self.batch: pc.divide(pc.subtract(ds.field(self.id).cast("int64"), self.first), self.step)}
        yield from self._table().to_batches(columns={n: number.get(n, ds.field(n)) for n in self.names}, filter=within)

    def commit(self, end: dict) -> None:
        if self.mark:
            files, path = fs.FileSystem.from_uri(self.mark)
            with files.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            files.move(f"{path}.new", path)


class Mailbox(DataSource):
    """A table as a mailbox: spark.readStream.format("mailbox").schema(...).option("path", ...).option("id", ...).option("step", ...)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return MailboxReader(self.options, schema.names)


def drain(spark: SparkSession, df: DataFrame, name: str, batch_col: str | None = None) -> DataFrame:
    """The rows that a stream gives until its source has no more, batch after batch; with `batch_col`, the batch that gave each row. A batch that runs again leaves its rows once."""
    out, check = place(spark, name), place(spark, f"{name}-state")
    schema = StructType([*df.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/_batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={n}")

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.schema(schema).parquet(out)
    return rows.select(*df.columns, F.col("_batch").alias(batch_col)) if batch_col else rows.select(*df.columns)


def mailbox(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """A table as a stream of its rows in batches by id."""
    spark.dataSource.register(Mailbox)
    r = spark.readStream.format("mailbox").schema(schema).option("path", path)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


# processors and sources run in processes of their own, which need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
