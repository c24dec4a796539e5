"""Relational operators on document-like tables: buckets, histories, matches, merges, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def severity(kind: Column, left: Column) -> Column:
    """high when due, or within three days for kinds that lapse; medium within a week; else low."""
    lapses = kind.isin("appeal", "fine_discount", "cancel_by")
    return F.when((left <= 0) | (lapses & (left <= 3)), "high").when(left <= 7, "medium").otherwise("low")


def bucket(left: Column) -> Column:
    return F.when(left < 0, "overdue").when(left <= 7, "week").when(left <= 30, "month").otherwise("later")


def price_history(df: DataFrame, series: str, order: list[str], amount: str) -> DataFrame:
    """Adds previous (the last amount before that isn't null), change and pct (one decimal) within each series."""
    w = W.partitionBy(series).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    a, before = F.col(amount).cast("decimal(18,2)"), F.last(F.col(amount).cast("decimal(18,2)"), ignorenulls=True).over(w)
    df = df.withColumn("previous", before)
    change = F.when(F.col("previous") > 0, a - F.col("previous"))
    return df.withColumn("change", change).withColumn("pct", F.round((F.col("change").cast("double") / F.col("previous").cast("double")) * 100, 1))


def price_rises(df: DataFrame, series: str, order: list[str], amount: str, least_pct: float) -> DataFrame:
    """The newest row of each series whose amount is `least_pct` or more above the one before."""
    h = price_history(df, series, order, amount)
    newest = F.row_number().over(W.partitionBy(series).orderBy(*[F.desc(c) for c in order]))
    return h.withColumn("_n", newest).where((F.col("_n") == 1) & (F.col("pct") >= least_pct)).drop("_n")


def fold_copies(df: DataFrame, same: list[str], best: list[Column]) -> DataFrame:
    """Adds kept: whether a row is the best of those that agree in `same`, and copies: how many there are."""
    w = W.partitionBy(*same)
    return df.withColumn("kept", F.row_number().over(w.orderBy(*best)) == 1).withColumn("copies", F.count("*").over(w))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Rows of both sides with equal keys and dates at most `days` apart.

    The dates are cut into cells as wide as the band; a left row meets three cells, so the join is on equality and its cost follows
    the matches, not the size of a key's history.
    """
    width = days + 1
    cell = lambda c: F.floor(F.unix_date(F.to_date(c)) / width)
    lhs = left.withColumn("_cell", F.explode(F.array(cell(left_day) - 1, cell(left_day), cell(left_day) + 1)))
    rhs = right.withColumn("_cell", cell(right_day))
    near = F.abs(F.datediff(F.col(left_day), F.col(right_day))) <= days
    return lhs.join(rhs, [*keys, "_cell"]).where(near).drop("_cell")


def merge_snapshots(old: DataFrame, new: DataFrame, keys: list[str], value: str, locked: str) -> DataFrame:
    """(keys, value, action): a three-way merge of drafts into what is stored.

    Rows on both sides are kept if equal, updated if not, and kept as they are where the user has edited them; new rows are inserted; stored ones
    that no draft names are deleted unless edited.
    """
    o = old.select(*keys, F.col(value).alias("_old"), F.col(locked).alias("_locked"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    j = o.join(n, keys, "full_outer")
    action = (
        F.when(F.col("_in_old").isNull(), "inserted")
        .when(F.col("_locked"), "kept_user_edits")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    out = F.when(action.isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old"))
    return j.select(*keys, out.alias(value), action.alias("action"))


def line_diff(old: DataFrame, new: DataFrame, key: str, line: str) -> DataFrame:
    """(key, side, line): lines whose normal form the other side of the same key lacks."""
    form = F.trim(F.regexp_replace(F.lower(F.col(line)), r"\s+", " "))
    o, n = (d.select(key, line, form.alias("_f")).where("_f <> ''") for d in (old, new))
    gone = o.join(n, [key, "_f"], "left_anti").select(key, F.lit("removed").alias("side"), line)
    more = n.join(o, [key, "_f"], "left_anti").select(key, F.lit("added").alias("side"), line)
    return gone.union(more).distinct()


def running_cut(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group while the sizes of those before add up to less than a budget."""
    before = F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < budget).drop("_b")


def islands(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers within each group: first, last, size."""
    r = F.col(number) - F.row_number().over(W.partitionBy(*group).orderBy(number))
    return df.select(*group, number).distinct().withColumn("_r", r).groupBy(*group, "_r").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).drop("_r")


def sessions(df: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Adds session: how many gaps of more than `gap_seconds` lie before a row within its user's rows."""
    w = W.partitionBy(user).orderBy(ts)
    far = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    return df.withColumn("_new", F.coalesce(far, F.lit(False)).cast("long")).withColumn("session", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_new")


def repeated_lines(df: DataFrame, group: str, page: str, line: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """(group, form, pages): lines, digits masked, that stand on more than `share` of a group's pages, if it has `least` pages."""
    form = F.trim(F.regexp_replace(F.lower(F.col(line)), r"\d+", "#"))
    lines = df.select(group, page, form.alias("form")).where((F.col("form") != "") & (F.char_length("form") <= 160)).distinct()
    total = df.select(group, page).distinct().groupBy(group).agg(F.count("*").alias("_all"))
    n = lines.groupBy(group, "form").agg(F.count("*").alias("pages"))
    return n.join(total, group).where((F.col("_all") >= least) & (F.col("pages") > F.col("_all") * share)).drop("_all")
