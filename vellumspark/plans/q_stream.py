"""Queries: streams run through a table's files to their end."""

from __future__ import annotations

from vellumspark.streaming import jobs


def daily(spark, sf):
    return jobs.run(spark, jobs.daily_counts(jobs.source(spark, f"{sf}/events.parquet")), "daily", "complete")


DAILY = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY ALL"


def dedupe(spark, sf):
    return jobs.run(spark, jobs.first_sightings(jobs.source(spark, f"{sf}/events.parquet"), ["user_id", "event_type"]), "dedupe")


DEDUPE = "SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day FROM events"


def reminders(spark, sf):
    return jobs.run(spark, jobs.rises(jobs.source(spark, f"{sf}/events.parquet")), "rises", "update", ("user_id",))


REMINDERS = """SELECT user_id, count(*) FILTER (value > 1.5 * p AND 1.5 * p > 0) AS alerts, arg_max(value, (ts, event_id)) AS last_value FROM (
SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL) GROUP BY user_id"""

QUERIES = {"stream_windows": (daily, DAILY), "stream_dedupe": (dedupe, DEDUPE), "stream_reminders": (reminders, REMINDERS)}
