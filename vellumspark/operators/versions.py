"""Versions of texts and tables: differences line by line and word by word, changes applied to a snapshot, recurring dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.session import small_batches

from .editscript import CHANGES, changes

#: Changes that a task holds before it hands them on.
HELD = 1000


def compare(before: DataFrame, after: DataFrame, key: str, text: str, words: bool = False) -> DataFrame:
    """(key, kind, before_at, before, after_at, after): what changed between two texts of a key: replace, delete or insert of whole lines or words.

    White space within a line and empty lines do not count; digits, signs, case and repeated lines do. A key that one side lacks, or whose
    text is null there, is compared with nothing. The script is the least one (editscript.changes). Each pair of texts is one row of a join and is aligned in an Arrow batch, so a group holds
    one pair whatever the tables' size.
    """
    small_batches(before.sparkSession)
    kind = before.schema[key].dataType
    pairs = before.select(key, F.col(text).alias("_a")).join(after.select(key, F.col(text).alias("_b")), key, "full_outer")

    def units(t: str | None) -> list[str]:
        if not t:
            return []
        return t.split() if words else [x for x in (" ".join(line.split()) for line in t.split("\n")) if x]

    columns = [key, "kind", "before_at", "before", "after_at", "after"]

    def run(batches):
        for pdf in batches:
            out = []
            for k, a, b in zip(pdf[key], pdf["_a"], pdf["_b"], strict=True):
                out += [(k, *change) for change in changes(units(a), units(b))]
                # a batch holds thousands of texts; what was found goes out before it amounts to much
                if len(out) >= HELD:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return pairs.mapInPandas(run, f"`{key}` {kind.simpleString()}, {CHANGES}")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, at: str, op: str, writable: list[str]) -> DataFrame:
    """The snapshot after a log of changes, with the columns of `base`.

    Of the changes of a key the last one before its latest delete or create does not matter; updates after that are laid over each other in
    order of `at`, a null leaving what was there, and only the columns in `writable` are taken. An update or delete of a key that does not
    exist does nothing; a create of one that does is an update.
    """
    last = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = changes.withColumn("_gone", F.max(F.when(F.col(op) == "delete", F.col(at))).over(last))
    c = c.withColumn("_fresh", F.min(F.when((F.col(op) == "create") & (F.col("_gone").isNull() | (F.col(at) > F.col("_gone"))), F.col(at))).over(last))
    use = c.where((F.col(op) != "delete") & (F.col("_gone").isNull() | (F.col("_fresh").isNotNull() & (F.col(at) >= F.col("_fresh")))))
    laid = use.groupBy(key).agg(*[F.max_by(w, F.when(F.col(w).isNotNull(), F.col(at))).alias(f"_{w}") for w in writable], F.max("_fresh").isNotNull().alias("_made"))
    gone = c.where("_gone IS NOT NULL").select(key).distinct().withColumn("_dead", F.lit(True))
    j = base.withColumn("_is", F.lit(True)).join(gone, key, "left").join(laid, key, "full_outer")
    j = j.where((F.col("_is") & F.col("_dead").isNull()) | F.coalesce("_made", F.lit(False)))
    old = F.col("_is").isNotNull() & F.col("_dead").isNull()
    cols = [F.col(x) if x == key else F.coalesce(f"_{x}", F.when(old, F.col(x))).alias(x) if x in writable else F.when(old, F.col(x)).alias(x) for x in base.columns]
    return j.select(*cols)


def next_occurrence(day: Column, months: Column, today: Column) -> Column:
    """The first date after `today` of one that recurs every so many months, counted from the first, so that month ends do not drift; itself if it is still to come."""
    passed = F.greatest(F.floor(F.months_between(today, day) / months).cast("int"), F.lit(0))
    steps = F.transform(F.sequence(passed, passed + 2), lambda k: F.add_months(day, k * months))
    return F.when(day > today, day).otherwise(F.array_min(F.filter(steps, lambda d: d > today)))


def signature(cols: list[Column]) -> Column:
    """A fingerprint of a row over the columns that matter; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
