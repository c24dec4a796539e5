"""Session construction and table access shared by the library, bench and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "vellumspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates and adaptive execution; `conf` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python steps get so many rows at a time: a batch of whole texts must fit beside those of the executor's other tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
