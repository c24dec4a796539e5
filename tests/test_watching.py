"""Watched things over several batches, expiry, feeds, late matches when their time is over, and a mailbox whose batch fails."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from vellumspark.streaming import jobs, watching


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


class Source:
    """Batches written one after another into a folder that a stream reads; the stream's rows so far."""

    def __init__(self, spark, at, schema):
        self.spark, self.at, self.schema, self.n = spark, at, schema, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.at)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.at)


def start(df, tmp_path, name="q"):
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(processingTime="0 seconds").outputMode("append").start()


def test_changes_over_batches(spark, tmp_path):
    src = Source(spark, str(tmp_path / "in"), "watched string, at timestamp, seq long, content string")
    batches = [
        [("a", day(0), 1, "x"), ("b", day(0), 2, "x"), ("b", day(1), 3, "y"), ("c", day(0), 9, None)],
        [("a", day(2), 4, "x"), ("b", day(3), 5, None), ("c", day(2), 6, "z")],
        [("a", day(4), 7, "w"), ("b", day(4), 8, "y"), ("a", day(4), 10, "x"), ("c", day(5), 11, "")],
    ]
    src.put(batches[0])
    with watching.stateful(spark):
        q = start(watching.page_changes(src.stream()), tmp_path, "changes")
    try:
        for b in batches[1:]:
            q.processAllAvailable()
            src.put(b)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.watched, r.seq, r.before, r.after) for r in spark.table("changes").collect()}
    assert got == {("b", 3, "x", "y"), ("a", 7, "x", "w"), ("a", 10, "w", "x"), ("c", 11, "z", "")}


def test_what_is_not_seen_for_long_is_forgotten(spark, tmp_path):
    src = Source(spark, str(tmp_path / "in"), "watched string, at timestamp, seq long, content string")
    src.put([("a", day(0), 1, "x")])
    with watching.stateful(spark):
        q = start(watching.page_changes(src.stream(), "2 seconds"), tmp_path, "forgotten")
    try:
        q.processAllAvailable()
        time.sleep(2.5)
        src.put([("a", day(1), 2, "y")])
        q.processAllAvailable()
        src.put([("a", day(2), 3, "z")])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.seq, r.before) for r in spark.table("forgotten").collect()}
    assert (2, "x") not in got and got <= {(3, "y")}


def test_a_feeds_first_batch_is_its_baseline(spark, tmp_path):
    src = Source(spark, str(tmp_path / "in"), "feed string, item string")
    src.put([("f", "1"), ("f", "2"), ("f", None)])
    with watching.stateful(spark):
        q = start(watching.new_items(src.stream()), tmp_path, "items")
    try:
        q.processAllAvailable()
        src.put([("f", "2"), ("f", "3"), ("f", "3"), ("g", "1"), ("f", "")])
        q.processAllAvailable()
        src.put([("f", "3"), ("g", "2"), ("g", "1")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("items").collect()) == [("f", "3"), ("g", "2")]


def test_unmatched_rows_come_once_their_time_is_over(spark, tmp_path):
    wanted, found = Source(spark, str(tmp_path / "w"), "key string, at timestamp"), Source(spark, str(tmp_path / "f"), "key string, at timestamp")
    wanted.put([("a", day(0)), ("b", day(0)), ("c", day(10)), (None, day(0))])
    found.put([("a", day(45)), ("x", day(0))])
    q = start(watching.late_matches(wanted.stream(), found.stream()), tmp_path, "late")
    rows = lambda: {(r.key, None if r.found_at is None else (r.found_at - day(0)).days) for r in spark.table("late").collect()}
    try:
        q.processAllAvailable()
        assert rows() == {("a", 45)}
        wanted.put([("z", day(45))])
        found.put([("b", day(45)), ("x", day(44))])
        q.processAllAvailable()
        assert rows() == {("a", 45), ("b", 45)}
        wanted.put([("z", day(50))])
        found.put([("c", day(56)), ("x", day(50))])
        q.processAllAvailable()
        assert (None, None) in rows() and ("c", None) not in rows()
        wanted.put([("z", day(60))])
        found.put([("x", day(60))])
        q.processAllAvailable()
        assert {r for r in rows() if r[0] != "z"} == {("a", 45), ("b", 45), (None, None), ("c", None)}
    finally:
        q.stop()


def test_a_failed_batch_is_read_again_once(spark, tmp_path):
    spark.range(0, 1000).select(F.col("id").alias("event_id"), (F.col("id") * 2).alias("v")).repartition(3).write.parquet(str(tmp_path / "t"))
    mark, out, check = f"file://{tmp_path}/mark", str(tmp_path / "out"), str(tmp_path / "c")
    failed = []

    def put(batch, n):
        if n == 2 and not failed:
            failed.append(n)
            raise RuntimeError("filing failed")
        batch.write.mode("overwrite").parquet(f"{out}/_batch={n}")

    def go():
        m = watching.mailbox(spark, str(tmp_path / "t"), "event_id long, v long", step=150, watermark=mark)
        q = m.writeStream.foreachBatch(put).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="filing failed"):
        go()
    assert spark.read.parquet(out).count() == 300
    go()
    rows = [tuple(r) for r in spark.read.parquet(out).select("event_id", "v").collect()]
    assert len(rows) == 1000 and set(rows) == {(i, 2 * i) for i in range(1000)}


def test_batches_of_a_mailbox_with_gaps(spark, tmp_path):
    spark.createDataFrame([(5,), (7,), (300,), (301,)], "event_id long").write.parquet(str(tmp_path / "t"))
    got = watching.drain(spark, watching.mailbox(spark, str(tmp_path / "t"), "event_id long", step=100), "gaps", "batch").collect()
    assert {(r.event_id, r.batch) for r in got} == {(5, 0), (7, 0), (300, 2), (301, 2)}
    assert jobs.place(spark, "x")


def test_batches_taken_together_are_told_apart(spark, tmp_path):
    spark.createDataFrame([(5, "a"), (7, "b"), (104, "a"), (105, "a"), (106, "c"), (300, "d"), (301, "c"), (999, "e")], "event_id long, item string").write.parquet(str(tmp_path / "t"))
    whole = dict(path=str(tmp_path / "t"), schema="event_id long, item string, batch long", step=100, batch="batch")
    got = watching.drain(spark, watching.mailbox(spark, at_once=4, **whole), "told", "n").collect()
    assert {(r.event_id, r.batch) for r in got} == {(5, 0), (7, 0), (104, 0), (105, 1), (106, 1), (300, 2), (301, 2), (999, 9)}
    assert {(r.event_id, r.n) for r in got} == {(5, 0), (7, 0), (104, 0), (105, 0), (106, 0), (300, 0), (301, 0), (999, 2)}
    for n in (1, 4, 50):
        with watching.stateful(spark):
            items = watching.mailbox(spark, at_once=n, **whole).select(F.lit("f").alias("feed"), "item", "batch")
            assert sorted(r.item for r in watching.drain(spark, watching.new_items(items), "told").collect()) == ["c", "d", "e"]
