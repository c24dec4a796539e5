"""Working-day calendar as a small table, and legal deadlines as joins with it.

The table has one row per day and a running number of working days, so that the n-th working day after a date is an
equality join instead of a loop. Its size is days times regions, a few thousand rows, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed national holidays as (month, day), and those that move to Monday when they fall on a Sunday.
FIXED = ((1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25))
SUNDAY_MOVES = ((1, 1), (1, 6), (12, 6), (12, 8), (12, 25))
#: Further holidays of a region as (month, day), or days from Easter Sunday.
REGIONS: dict[str, tuple[tuple[tuple[int, int], ...], tuple[int, ...]]] = {
    "ES": ((), (-2,)),
    "ES-MD": (((5, 2),), (-3, -2)),
    "ES-CT": (((6, 24), (9, 11), (12, 26)), (-2, 1)),
    "ES-VC": (((3, 19), (6, 24), (10, 9)), (-2, 1)),
}


def easter(year: Column) -> Column:
    """Easter Sunday of a year by the anonymous Gregorian rule, in whole numbers."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    p = h + m - 7 * n + 114
    return F.make_date(year, div(p, 31), p % 31 + 1)


def holidays(spark: SparkSession, first: int, last: int, region: str = "ES") -> DataFrame:
    """(day): the holidays of the years first to last."""
    days, feast = REGIONS[region]
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    moves = SUNDAY_MOVES if region != "ES-CT" else ()
    dates = []
    for m, d in (*FIXED, *days):
        day = F.make_date("y", F.lit(m), F.lit(d))
        dates.append(F.when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day) if (m, d) in moves else day)
    dates += [F.date_add(easter(F.col("y")), n) for n in feast]
    return years.select(F.explode(F.array(*dates)).alias("day")).distinct()


def calendar(spark: SparkSession, first: int, last: int, region: str = "ES") -> DataFrame:
    """(day, working, seq, next_working, previous_working): seq counts working days up to and including the day."""
    days = spark.sql(f"SELECT explode(sequence(make_date({first}, 1, 1), make_date({last}, 12, 31))) AS day")
    off = holidays(spark, first, last, region).withColumn("off", F.lit(True))
    days = days.join(F.broadcast(off), "day", "left").withColumn("working", (F.weekday("day") < 5) & F.col("off").isNull())
    order = W.orderBy("day")
    mine = F.when(F.col("working"), F.col("day"))
    return days.select(
        "day",
        "working",
        F.sum(F.col("working").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("seq"),
        F.min(mine).over(order.rowsBetween(0, W.unboundedFollowing)).alias("next_working"),
        F.max(mine).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("previous_working"),
    )


def add_working_days(df: DataFrame, cal: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """The n-th working day after `day` (before it, for a negative n)."""
    at = F.broadcast(cal.select(F.col("day").alias(day), F.col("seq").alias("_seq"), F.col("working").alias("_on")))
    to = F.broadcast(cal.where("working").select(F.col("seq").alias("_want"), F.col("day").alias(out)))
    want = F.col("_seq") + n + (F.when(~F.col("_on"), 1).otherwise(0) if n < 0 else F.lit(0))
    return df.join(at, day, "left").withColumn("_want", want).join(to, "_want", "left").drop("_want", "_seq", "_on")


def roll(df: DataFrame, cal: DataFrame, day: str, out: str) -> DataFrame:
    """`day`, or the first working day after it."""
    return df.join(F.broadcast(cal.select(F.col("day").alias(day), F.col("next_working").alias(out))), day, "left")


def admin_deadline(df: DataFrame, cal: DataFrame, day: str, n: int, unit: str, working: bool, out: str) -> DataFrame:
    """The end of a public-law period: counted from the day after, and moved on to a working day."""
    if unit == "day" and working:
        return add_working_days(df, cal, day, n, out)
    last = F.date_add(day, n) if unit == "day" else F.add_months(day, n * (12 if unit == "year" else 1))
    return roll(df.withColumn("_last", last), cal, "_last", out).drop("_last")
