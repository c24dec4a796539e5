"""Queries: watched values, feeds, late matches and a mailbox, as streams over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.session import table
from vellumspark.streaming import jobs, watching


def watched_events(spark, sf):
    """Each change of the kind of event that a user shows."""
    e = jobs.source(spark, f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("watched"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    with watching.stateful(spark):
        got = jobs.run(spark, watching.page_changes(e), "watch")
    return got.select("watched", F.col("seq").alias("event_id"), "before", "after")


WATCHED_EVENTS = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS watched, event_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IS NOT NULL)
SELECT watched, event_id, before, after FROM e WHERE before <> after
"""


def _mail(spark, sf, **options):
    return watching.mailbox(spark, f"{sf}/events.parquet", "event_id long, user_id long, event_type string, batch long", id="event_id", batch="batch", at_once=AT_ONCE, **options)


#: Ids of a mailbox's batch, and batches that Spark takes together: each of its own costs seconds whatever it holds.
STEP, AT_ONCE = 2500, 200


def feed_items(spark, sf):
    """Users that a kind of event did not have in its first batch, read as a mailbox in batches of ids."""
    e = _mail(spark, sf, step=STEP).select(F.col("event_type").alias("feed"), F.col("user_id").cast("string").alias("item"), "batch")
    with watching.stateful(spark):
        return watching.drain(spark, watching.new_items(e), "feed")


FEED_ITEMS = f"""
WITH e AS (SELECT event_type AS feed, CAST(user_id AS VARCHAR) AS item, (event_id - (SELECT min(event_id) FROM events)) // {STEP} AS b FROM events),
f AS (SELECT feed, item, min(b) AS b FROM e GROUP BY feed, item)
SELECT feed, item FROM f WHERE b > (SELECT min(b) FROM e WHERE e.feed = f.feed)
"""


def mailbox_batches(spark, sf):
    """Every event once, with the batch that read it."""
    return watching.drain(spark, _mail(spark, sf, step=STEP), "mail").select("event_id", "user_id", "batch")


MAILBOX_BATCHES = f"SELECT event_id, user_id, (event_id - (SELECT min(event_id) FROM events)) // {STEP} AS batch FROM events"


def late_shipments(spark, sf):
    """Each order with its shipments of the 45 days after it, and orders without any once none can come."""
    o = jobs.source(spark, f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"))
    s = jobs.source(spark, f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("at"))
    got = jobs.run(spark, watching.late_matches(o, s), "late")
    return got.groupBy("key").agg(F.count("found_at").alias("found"), F.min(F.to_date("found_at")).alias("first_found"))


LATE_SHIPMENTS = """
WITH mark AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS t0),
j AS (SELECT o_orderkey AS key, o_orderdate AS t1, l_shipdate AS found_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 45 DAY)
SELECT key, count(found_at) AS found, CAST(min(found_at) AS DATE) AS first_found FROM j WHERE found_at IS NOT NULL OR t1 + INTERVAL 45 DAY < (SELECT t0 FROM mark) GROUP BY key
"""

QUERIES = {"watched_events": (watched_events, WATCHED_EVENTS), "feed_items": (feed_items, FEED_ITEMS), "mailbox_batches": (mailbox_batches, MAILBOX_BATCHES), "late_shipments": (late_shipments, LATE_SHIPMENTS)}
