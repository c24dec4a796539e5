"""Queries: lists, buckets, histories, matches, merges, sessions. Orders stand in for dated documents; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import money
from vellumspark.operators import relate
from vellumspark.session import table

TODAY = "1996-06-15"
KIND = ["payment", "appeal", "renewal", "cancel_by", "fine_discount"]


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.element_at(F.array(*map(F.lit, KIND)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"))


ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, ['payment','appeal','renewal','cancel_by','fine_discount'][o_orderkey % 5 + 1] AS kind FROM orders)"
LEFT_SQL = f"date_diff('day', DATE '{TODAY}', day)"


def left():
    """Days from the clock to a row's day."""
    return F.datediff("day", F.lit(TODAY).cast("date"))


def docs_filter(spark, sf):
    o = _orders(spark, sf).where((F.year("day") == 1995) & F.col("o_orderstatus").isin("F", "P") & F.col("o_orderpriority").ilike("%urgent%"))
    return o.orderBy(F.desc("day"), F.desc("o_orderkey")).offset(5).limit(50).select("o_orderkey", "day", "amount")


DOCS_FILTER = f"SELECT o_orderkey, day, amount FROM {ORDERS} WHERE year(day) = 1995 AND o_orderstatus IN ('F', 'P') AND o_orderpriority ILIKE '%urgent%' ORDER BY day DESC, o_orderkey DESC LIMIT 50 OFFSET 5"


def docs_missing(spark, sf):
    asked = spark.range(1, 400).select((F.col("id") * 59).alias("o_orderkey"))
    return asked.join(table(spark, sf, "orders"), "o_orderkey", "left_anti")


DOCS_MISSING = "SELECT a AS o_orderkey FROM (SELECT unnest(range(1, 400)) * 59 AS a) WHERE a NOT IN (SELECT o_orderkey FROM orders)"


def deadline_buckets(spark, sf):
    o = _orders(spark, sf).where(F.col("o_orderstatus") == "O")
    return o.groupBy(relate.bucket(left()).alias("bucket")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.sum("amount").cast("decimal(18,2)").alias("amount"))


BUCKETS = f"""SELECT CASE WHEN {LEFT_SQL} < 0 THEN 'overdue' WHEN {LEFT_SQL} <= 7 THEN 'week' WHEN {LEFT_SQL} <= 30 THEN 'month' ELSE 'later' END AS bucket,
count(*) AS n, min(day) AS first_day, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM {ORDERS} WHERE o_orderstatus = 'O' GROUP BY 1"""


def severities(spark, sf):
    o = _orders(spark, sf).where(F.abs(left()) <= 40)
    return o.select("o_orderkey", "kind", left().cast("long").alias("days_left"), relate.severity(F.col("kind"), left()).alias("severity"))


SEVERITY = f"""SELECT o_orderkey, kind, {LEFT_SQL} AS days_left, CASE WHEN {LEFT_SQL} <= 0 OR (kind IN ('appeal', 'fine_discount', 'cancel_by') AND {LEFT_SQL} <= 3) THEN 'high' WHEN {LEFT_SQL} <= 7 THEN 'medium' ELSE 'low' END AS severity
FROM {ORDERS} WHERE abs({LEFT_SQL}) <= 40"""


def agenda(spark, sf):
    o = _orders(spark, sf).where(left().between(0, 20) & (F.col("o_orderstatus") == "O"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    title = F.concat_ws(" · ", F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), "c_name", F.nullif("c_mktsegment", F.lit("")))
    return o.join(c, "o_custkey", "left").select("o_orderkey", "day", title.alias("title"))


AGENDA = f"""SELECT o_orderkey, day, concat_ws(' · ', CASE kind WHEN 'payment' THEN 'Payment' WHEN 'appeal' THEN 'Appeal' WHEN 'renewal' THEN 'Renewal' WHEN 'cancel_by' THEN 'Cancel By' ELSE 'Fine Discount' END, c_name, nullif(c_mktsegment, '')) AS title
FROM {ORDERS} LEFT JOIN customer ON c_custkey = o_custkey WHERE {LEFT_SQL} BETWEEN 0 AND 20 AND o_orderstatus = 'O'"""


def next_deadline(spark, sf):
    o = _orders(spark, sf).where(left() >= 0)
    n = o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "day", "kind"), F.struct("day", "o_orderkey")).alias("n"), F.count("*").alias("open"))
    return n.select("o_custkey", "n.o_orderkey", "n.day", "n.kind", "open")


NEXT = f"""SELECT o_custkey, o_orderkey, day, kind, open FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS open FROM {ORDERS} WHERE {LEFT_SQL} >= 0) WHERE r = 1"""


def counts(spark, sf):
    o = table(spark, sf, "orders").agg(F.count("*").alias("docs"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    e = table(spark, sf, "events").agg(F.count("*").alias("events"), F.count_if(F.col("value") < 0).alias("negative"), F.count_distinct("user_id").alias("users"))
    return o.crossJoin(F.broadcast(e))  # one row by one row


COUNTS = "SELECT * FROM (SELECT count(*) AS docs, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 200000) AS large FROM orders), (SELECT count(*) AS events, count(*) FILTER (value < 0) AS negative, count(DISTINCT user_id) AS users FROM events)"


def _gaps(o):
    return o.withColumn("amount", F.when(F.col("o_orderkey") % 4 != 0, F.col("amount")))


def price_history(spark, sf):
    h = relate.price_history(_gaps(_orders(spark, sf)), "o_custkey", ["day", "o_orderkey"], "amount")
    return h.select("o_orderkey", "o_custkey", "previous", "change", "pct")


HIST = f"""SELECT o_orderkey, o_custkey, day, amount, previous, CASE WHEN previous > 0 THEN amount - previous END AS change,
round(CAST(CASE WHEN previous > 0 THEN amount - previous END AS DOUBLE) / CAST(previous AS DOUBLE) * 100, 1) AS pct FROM (
SELECT *, last_value(amount IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 4 <> 0 THEN amount END AS amount) FROM {ORDERS}))"""
PRICE_HISTORY = f"SELECT o_orderkey, o_custkey, previous, CAST(change AS DECIMAL(19,2)) AS change, pct FROM ({HIST})"


def price_alert(spark, sf):
    return relate.price_rises(_gaps(_orders(spark, sf)), "o_custkey", ["day", "o_orderkey"], "amount", 25.0).select("o_custkey", "o_orderkey", "pct")


ALERT = f"SELECT o_custkey, o_orderkey, pct FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS r FROM ({HIST})) WHERE r = 1 AND pct >= 25"


def series_summary(spark, sf):
    o = _orders(spark, sf)
    key = F.struct("day", "o_orderkey")
    return o.groupBy("o_custkey", "kind").agg(F.min_by("amount", key).alias("first_amount"), F.max_by("amount", key).alias("latest_amount"), F.count("*").alias("n"), F.max("day").alias("latest"))


SUMMARY = f"SELECT o_custkey, kind, arg_min(amount, (day, o_orderkey)) AS first_amount, arg_max(amount, (day, o_orderkey)) AS latest_amount, count(*) AS n, max(day) AS latest FROM {ORDERS} GROUP BY o_custkey, kind"


def fold_copies(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("day"), F.round("l_quantity", 0).cast("long").alias("q"), "l_returnflag")
    f = relate.fold_copies(li, ["l_suppkey", "day", "q"], [F.desc(F.col("l_returnflag") == "R"), F.col("l_orderkey"), F.col("l_linenumber")])
    return f.where("copies > 1").select("l_orderkey", "l_linenumber", "kept", "copies")


FOLD = """SELECT l_orderkey, l_linenumber, r = 1 AS kept, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, day, q) AS copies,
row_number() OVER (PARTITION BY l_suppkey, day, q ORDER BY (l_returnflag = 'R') DESC, l_orderkey, l_linenumber) AS r
FROM (SELECT *, CAST(l_shipdate AS DATE) AS day, CAST(round(l_quantity, 0) AS BIGINT) AS q FROM lineitem)) WHERE copies > 1"""


def band_match(spark, sf):
    o = _orders(spark, sf).select("o_orderkey", "o_custkey", "day", "amount")
    m = relate.band_join(o, o.select(F.col("o_orderkey").alias("other"), "o_custkey", F.col("day").alias("other_day"), F.col("amount").alias("other_amount")), ["o_custkey"], "day", "other_day", 10)
    m = m.where("o_orderkey < other")
    score = F.round(1 - F.abs(F.datediff("day", "other_day")) / 20.0, 4).cast("double")
    return m.select("o_custkey", "o_orderkey", "other", score.alias("score"))


BAND = f"SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other, CAST(round(1 - abs(date_diff('day', a.day, b.day)) / 20.0, 4) AS DOUBLE) AS score FROM {ORDERS} a JOIN {ORDERS} b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.day, b.day)) <= 10"


def single_link(spark, sf):
    m = band_match(spark, sf).where("score >= 0.8")
    n = F.count("*").over(W.partitionBy("o_orderkey"))
    return m.withColumn("n", n).where("n = 1").select("o_orderkey", "other", "score")


SINGLE = f"SELECT o_orderkey, other, score FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM ({BAND}) WHERE score >= 0.8) WHERE n = 1"


def merge(spark, sf):
    o = _orders(spark, sf)
    old = o.where("o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0").select("o_orderkey", "day", (F.col("o_orderkey") % 7 == 1).alias("edited"))
    new = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, F.date_add("day", 3)).otherwise(F.col("day")).alias("day"))
    return relate.merge_snapshots(old, new, ["o_orderkey"], "day", "edited")


MERGE = f"""WITH o AS (SELECT o_orderkey, day, o_orderkey % 7 = 1 AS edited FROM {ORDERS} WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN day + 3 ELSE day END AS day FROM {ORDERS} WHERE o_orderkey % 5 <> 0),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.day AS od, n.day AS nd, edited, o.o_orderkey IS NULL AS fresh, n.o_orderkey IS NULL AS gone FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey),
a AS (SELECT *, CASE WHEN fresh THEN 'inserted' WHEN edited THEN 'kept_user_edits' WHEN gone THEN 'deleted' WHEN od IS NOT DISTINCT FROM nd THEN 'unchanged' ELSE 'updated' END AS action FROM j)
SELECT o_orderkey, CAST(CASE WHEN action IN ('inserted', 'updated') THEN nd ELSE od END AS DATE) AS day, action FROM a"""


def line_diff(spark, sf):
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 2).alias("k"), "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return relate.line_diff(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "k", "line")


LINES = r"""WITH d AS (SELECT doc_id // 2 AS k, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS f FROM d)
SELECT DISTINCT k, 'removed' AS side, line FROM f a WHERE doc_id % 2 = 0 AND f <> '' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id % 2 = 1 AND b.k = a.k AND b.f = a.f)
UNION ALL SELECT DISTINCT k, 'added', line FROM f a WHERE doc_id % 2 = 1 AND f <> '' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id % 2 = 0 AND b.k = a.k AND b.f = a.f)"""


def page_cut(spark, sf):
    c = table(spark, sf, "conversations")
    return relate.running_cut(c, "conv_id", ["turn"], F.char_length("text"), 1500).select("conv_id", "turn")


CUT = "SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 1500"


def islands(spark, sf):
    return relate.islands(table(spark, sf, "events"), ["event_type"], "user_id").select("event_type", F.col("first").alias("first_id"), F.col("last").alias("last_id"), F.col("size").alias("n"))


ISLANDS = "SELECT event_type, min(user_id) AS first_id, max(user_id) AS last_id, count(*) AS n FROM (SELECT *, user_id - row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM (SELECT DISTINCT event_type, user_id FROM events)) GROUP BY event_type, r"


def sessions(spark, sf):
    s = relate.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 21600000000 THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT user_id, session, min(ts) AS begin, max(ts) AS end, count(*) AS n FROM s GROUP BY user_id, session"""


def visible(spark, sf):
    c = table(spark, sf, "conversations").withColumn("room", F.col("turn") % 3 == 0)
    seen = c.where(F.col("room") | (F.col("role") == "user") | F.array_contains(F.array(F.lit(1), F.lit(5)), (F.col("conv_id") % 6).cast("int")))
    return seen.where("turn > 1").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("r <= 2").select("conv_id", "turn", "role")


VISIBLE = "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE (turn % 3 = 0 OR role = 'user' OR conv_id % 6 IN (1, 5)) AND turn > 1) WHERE r <= 2"


def quiet(spark, sf):
    e = table(spark, sf, "events").withColumn("h", F.hour("ts"))
    return e.groupBy(((F.col("h") >= 23) | (F.col("h") < 7)).alias("quiet"), "event_type").agg(F.count("*").alias("n"))


QUIET = "SELECT hour(ts) >= 23 OR hour(ts) < 7 AS quiet, event_type, count(*) AS n FROM events GROUP BY ALL"


def wide(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id")).fillna(0)


WIDE = "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id"


def json_props(spark, sf):
    keys = F.explode_outer(F.json_object_keys("props"))
    return table(spark, sf, "events").select(keys.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


JSON = "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key"


def shares(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("w"), "l_partkey", "l_suppkey")
    li = li.withColumn("total", (F.col("l_orderkey") * 37 % 10007).cast("long"))
    return money.split_shares(li, ["l_orderkey"], "total", "w", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "share")


SHARES = """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS w, l_orderkey * 37 % 10007 AS t FROM lineitem),
b AS (SELECT *, CAST(sum(w) OVER (PARTITION BY l_orderkey) AS BIGINT) AS s FROM a), c AS (SELECT *, (t * w) // s AS f, (t * w) % s AS r FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC, l_linenumber, l_partkey, l_suppkey) AS k, t - sum(f) OVER (PARTITION BY l_orderkey) AS left_over FROM c)
SELECT l_orderkey, l_linenumber, CAST(f + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS share FROM d"""


def cents(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", money.to_cents("l_extendedprice").alias("c"))
    return li.groupBy("l_returnflag").agg(F.sum("c").alias("cents"), F.max(money.format_money(money.from_cents("c"), "EUR")).alias("top_text"), F.max("c").alias("top"))


CENTS = """SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS cents, max(regexp_replace(translate(format('{:,.2f}', c / 100.0), '.,', ',.'), '$', ' €')) AS top_text, max(c) AS top
FROM (SELECT l_returnflag, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * 100, 0) AS BIGINT) AS c FROM lineitem) GROUP BY l_returnflag"""

QUERIES = {
    "docs_filter": (docs_filter, DOCS_FILTER), "docs_missing": (docs_missing, DOCS_MISSING), "deadline_buckets": (deadline_buckets, BUCKETS), "severity": (severities, SEVERITY), "agenda": (agenda, AGENDA), "next_deadline": (next_deadline, NEXT),
    "conditional_counts": (counts, COUNTS), "price_history": (price_history, PRICE_HISTORY), "price_alert": (price_alert, ALERT), "series_summary": (series_summary, SUMMARY), "fold_copies": (fold_copies, FOLD), "band_match": (band_match, BAND),
    "single_strong_link": (single_link, SINGLE), "merge_deadlines": (merge, MERGE), "diff_lines": (line_diff, LINES), "page_budget": (page_cut, CUT), "page_ranges": (islands, ISLANDS), "sessions_gap": (sessions, SESSIONS), "visible_messages": (visible, VISIBLE),
    "quiet_hours": (quiet, QUIET), "merge_wide": (wide, WIDE), "json_props": (json_props, JSON), "split_shares": (shares, SHARES), "money_cents": (cents, CENTS),
}
