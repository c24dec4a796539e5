"""What lies within a few links of given nodes, and rules by the longest pattern that fits a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.streaming.jobs import place


def around(spark: SparkSession, starts: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """(start, node, depth): the nodes within `hops` links of each start, with the fewest links needed; a start reaches itself at 0.

    starts: (start); links: (a, b), taken both ways; nulls link nothing. Each hop joins the newest nodes only, and drops those that their start has
    seen, so a node is expanded once for each start. Frontiers are written, so that a lost executor costs one hop's tasks. A hub's links are
    many rows of one key in the join's larger side, which adaptive execution splits.
    """
    base = place(spark, "around")
    ways = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    ways.write.parquet(f"{base}/links")
    ways = spark.read.schema(ways.schema).parquet(f"{base}/links")
    new = starts.select("start", F.col("start").alias("node")).where("start IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    new.write.parquet(f"{base}/seen/hop=0")
    schema = new.schema
    for k in range(1, hops + 1):
        last, seen = (spark.read.schema(schema).parquet(*p) for p in ([f"{base}/seen/hop={k - 1}"], [f"{base}/seen/hop={i}" for i in range(k)]))
        # links are read as they are, once each way; only what a frontier reaches is made distinct, not all links
        step = last.join(ways, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).union(last.join(ways, F.col("node") == F.col("b")).select("start", F.col("a").alias("node"))).distinct()
        step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(k)).write.parquet(f"{base}/seen/hop={k}")
    return spark.read.schema(schema).parquet(*[f"{base}/seen/hop={i}" for i in range(hops + 1)])


def prefixes(path: Column) -> Column:
    """All beginnings of a path, from its first sign to the whole; '/' for an empty one."""
    p = F.when(path.isNull() | (path == ""), "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.transform(F.sequence(F.lit(1), F.char_length(p)), lambda n: F.substr(p, F.lit(1), n))


def as_regex(pattern: Column) -> Column:
    """A pattern with * for any signs and $ for the path's end, as an anchored expression."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.substr(pattern, F.lit(1), F.char_length(pattern) - 1)).otherwise(pattern)
    quoted = F.array_join(F.transform(F.split(body, r"\*"), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), ".*")
    return F.concat(F.lit("^"), quoted, F.when(ends, "$").otherwise(""))


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """`paths` with `ok`: whether the longest rule of its host that fits its path allows it; of equally long ones an allowing rule counts, without a rule it is allowed.

    paths: (host, path, ...); rules: (host, pattern, allow). A plain pattern fits a path that begins with it, so paths are exploded into their
    beginnings and joined on equality; a pattern with * or $ is joined by the plain beginning before the first of them and tried as an
    expression then. /robots.txt is always allowed. Rows are kept one for one; an empty pattern is no rule.
    """
    r = rules.where("pattern IS NOT NULL AND pattern <> ''").select("host", "pattern", "allow").distinct()
    head = F.regexp_extract("pattern", r"^([^*$]*)", 1)
    r = r.withColumn("_head", F.when(head == "", "/").otherwise(head)).withColumn("_rx", F.when(F.col("pattern").rlike(r"[*$]"), as_regex(F.col("pattern"))))
    p = paths.withColumns({"_h": F.col("host"), "_p": F.element_at(prefixes(F.col("path")), -1)})
    q = p.select("_h", "_p").distinct().select("_h", "_p", F.explode(prefixes(F.col("_p"))).alias("_head"))
    fit = q.join(r, (F.col("_h") == F.col("host")) & (q["_head"] == r["_head"])).where(F.col("_rx").isNull() | F.regexp_like(F.col("_p"), F.col("_rx")))
    best = fit.groupBy("_h", "_p").agg(F.max(F.struct(F.char_length("pattern").alias("n"), "allow")).alias("_r"))
    always = F.split_part(F.col("_p"), F.lit("?"), F.lit(1)) == "/robots.txt"
    return p.join(best, ["_h", "_p"], "left").select(*[p[c] for c in paths.columns], F.when(always, True).otherwise(F.coalesce("_r.allow", F.lit(True))).alias("ok"))
