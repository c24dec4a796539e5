"""Queries: subtitles, calendar and CSV texts, sortable ids, versions, addresses, scripts, dates in words, counts of copies, pages of rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import formats, text
from vellumspark.session import table

from .q_extract import _values


def _cues(spark, sf):
    t = F.col("turn").cast("long")
    gap = F.when(t % 3 == 2, 3000).otherwise(0)
    return table(spark, sf, "conversations").select("conv_id", (t * 8000).alias("s"), (t * 8000 + 7990 - gap).alias("e"), "text")


SAID = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
CUES = f"(SELECT conv_id, CAST(turn AS BIGINT) * 8000 AS s, CAST(turn AS BIGINT) * 8000 + 7990 - CASE WHEN turn % 3 = 2 THEN 3000 ELSE 0 END AS e, {SAID} AS t FROM conversations WHERE {SAID} <> '')"
CLOCK = "printf('%02d:%02d:%02d{1}%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


def srt(spark, sf):
    return formats.to_subtitles(_cues(spark, sf), "conv_id", "s", "e", "text").select("conv_id", F.sha2("content", 256).alias("sha"))


SRT = f"""SELECT conv_id, sha256(string_agg(n || chr(10) || {CLOCK.format('s', ',')} || ' --> ' || {CLOCK.format('e', ',')} || chr(10) || t || chr(10), chr(10) ORDER BY n)) AS sha
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, t) AS n FROM {CUES}) GROUP BY conv_id"""


def vtt(spark, sf):
    return formats.to_subtitles(_cues(spark, sf), "conv_id", "s", "e", "text", vtt=True).select("conv_id", F.sha2("content", 256).alias("sha"))


VTT = f"""SELECT conv_id, sha256('WEBVTT' || chr(10) || chr(10) || string_agg({CLOCK.format('s', '.')} || ' --> ' || {CLOCK.format('e', '.')} || chr(10) || t || chr(10), chr(10) ORDER BY s, e, t)) AS sha FROM {CUES} GROUP BY conv_id"""


def parsed(spark, sf):
    both = formats.to_subtitles(_cues(spark, sf), "conv_id", "s", "e", "text", vtt=True)
    c = both.select("conv_id", F.explode(formats.parse_subtitles("content")).alias("c"))
    return c.select("conv_id", "c.start_ms", "c.end_ms", F.sha2(F.regexp_replace("c.text", r"\s+", " "), 256).alias("sha"))


PARSED = f"SELECT conv_id, s AS start_ms, e AS end_ms, sha256(trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS sha FROM {CUES}"


def speech(spark, sf):
    c = formats.to_subtitles(_cues(spark, sf), "conv_id", "s", "e", "text")
    return c.select("conv_id", F.sha2(formats.cues_text(formats.parse_subtitles("content")), 256).alias("sha"))


SPEECH = f"""WITH c AS (SELECT conv_id, s, e, trim(regexp_replace(t, '<[^>]*>', '', 'g')) AS t FROM {CUES}), p AS (SELECT *, lag(t) OVER w AS pt, lag(e) OVER w AS pe FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY s))
SELECT conv_id, sha256(string_agg(CASE WHEN pe IS NULL THEN '' WHEN s - pe > 2000 OR regexp_matches(pt, '[.!?…]$') THEN chr(10) ELSE ' ' END || t, '' ORDER BY s)) AS sha FROM p GROUP BY conv_id"""


def ics(spark, sf):
    o = table(spark, sf, "orders")
    e = formats.ics_event(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), F.to_date("o_orderdate"), F.concat(F.col("o_orderpriority"), F.lit("; due, "), F.col("o_orderstatus"), F.lit("\nsee \\ list")))
    return o.select("o_orderkey", F.sha2(e, 256).alias("sha"))


ICS = r"""SELECT o_orderkey, sha256('BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:order-' || o_orderkey || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d') || chr(13) || chr(10) ||
'SUMMARY:' || replace(replace(replace(replace(o_orderpriority || '; due, ' || o_orderstatus || chr(10) || 'see \ list', '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n') || chr(13) || chr(10) || 'END:VEVENT') AS sha FROM orders"""


def csv(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(formats.csv_line([F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")]), 256).alias("sha"))


def _cell(c: str) -> str:
    v = f"(CASE WHEN regexp_matches({c}, '^[=+@\\t\\r]') THEN '''' || {c} ELSE {c} END)"
    return f"CASE WHEN regexp_matches({v}, '[;\"\\r\\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"


CSV = f"SELECT doc_id, sha256(concat_ws(';', CAST(doc_id AS VARCHAR), {', '.join(_cell(f'''coalesce({c}, '')''') for c in ('lang', 'source', 'text'))})) AS sha FROM documents"


def ids(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    e = e.withColumn("u", formats.ulid(F.col("ms"), F.col("event_id")))
    return e.select("event_id", formats.id_time(F.concat(F.lit("ev_"), F.col("u"))).alias("ms"), F.char_length("u").alias("size"))


IDS = "SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(26 AS INT) AS size FROM events"

VERSIONS = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.9.0", "1.10.0", "2.0.0-1", "2.0.0"]


def versions(spark, sf):
    v = spark.createDataFrame([(x,) for x in sorted(VERSIONS)], "version string")
    return v.select("version", F.rank().over(W.orderBy(formats.version_key("version"))).cast("long").alias("place"))


VERSIONS_SQL = _values("version place", [(v, i + 1) for i, v in enumerate(VERSIONS)], "VARCHAR BIGINT")

ADDRESSES = [("10.1.2.3", "private"), ("172.31.0.1", "private"), ("172.32.0.1", "public"), ("192.168.4.4", "private"), ("127.0.0.1", "loopback"), ("169.254.169.254", "link_local"), ("100.64.0.9", "shared"), ("224.0.0.1", "multicast"), ("255.255.255.255", "reserved"), ("0.0.0.0", "unspecified"), ("8.8.8.8", "public"), ("300.1.1.1", None), ("host", None)]


def addresses(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in ADDRESSES], "address string").select("address", formats.address_class("address").alias("kind"))


ADDRESSES_SQL = _values("address kind", ADDRESSES, "VARCHAR VARCHAR")

WRITINGS = [("hello мир", "latin"), ("привет", "cyrillic"), ("λόγος", "greek"), ("漢字かな", "ja"), ("漢字", "cjk"), ("한국어", "ko"), ("שלום", "hebrew"), ("12 34", ""), ("", "")]


def scripts(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in WRITINGS], "text string").select("text", formats.script("text").alias("script"))


SCRIPTS_SQL = _values("text script", WRITINGS, "VARCHAR VARCHAR")


def marks(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = F.format_number("l_extendedprice", 2)
    raw = F.when(F.col("l_linestatus") == "O", F.translate(raw, ".,", ",.")).otherwise(raw)
    return li.select("l_linestatus", raw.alias("raw")).groupBy("l_linestatus").agg(formats.decimal_mark("raw").alias("mark"))


MARKS = "SELECT l_linestatus, CASE WHEN l_linestatus = 'O' THEN ',' ELSE '.' END AS mark FROM lineitem GROUP BY 1"


def years(spark, sf):
    d, today = F.to_date("o_orderdate"), F.lit("1996-03-10").cast("date")
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", *[formats.resolve_year(F.dayofmonth(d), F.month(d), today, p).alias(p) for p in ("future", "past", "next", "nearest")])


_COST = {"future": "CASE WHEN x >= -10 THEN x ELSE 10000 - x END", "past": "CASE WHEN x <= 45 THEN -x ELSE 10000 + x END", "next": "CASE WHEN x >= 0 THEN x ELSE 10000 - x END", "nearest": "abs(x)"}
YEARS = (
    "WITH c AS (SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', y, month(o_orderdate), day(o_orderdate)) AS DATE) AS d FROM orders, (VALUES (1995), (1996), (1997)) AS t(y)), k AS (SELECT *, date_diff('day', DATE '1996-03-10', d) AS x FROM c WHERE d IS NOT NULL) SELECT o_orderkey, "
    + ", ".join(f"arg_min(d, ({c}, d)) AS {p}" for p, c in _COST.items()) + " FROM k GROUP BY o_orderkey"
)

SPOKEN = [
    ("2026-12-24", "2026-12-24"), ("el 5/11/2026", "2026-11-05"), ("en 3 días", "2026-10-04"), ("dentro de dos semanas", "2026-10-15"), ("in one month", "2026-11-01"), ("pasado mañana", "2026-10-03"), ("mañana por la mañana", "2026-10-02"), ("hoy", "2026-10-01"),
    ("el viernes", "2026-10-02"), ("next thursday", "2026-10-08"), ("el día 15", "2026-10-15"), ("fin de mes", "2026-10-31"), ("por la mañana", None), ("algún día", None),
]


def spoken(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in SPOKEN], "said string").select("said", formats.spoken_date("said", F.lit("2026-10-01").cast("date")).alias("day"))


SPOKEN_SQL = _values("said day", SPOKEN, "VARCHAR DATE")

QUANTITIES = [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("12,5", 12.5), ("3.75", 3.75), ("7", 7.0), ("1 000", 1000.0), ("x", None)]


def quantities(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in QUANTITIES], "raw string").select("raw", formats.quantity("raw").alias("amount"))


QUANTITIES_SQL = _values("raw amount", QUANTITIES, "VARCHAR DOUBLE")

FISCAL = [("Renta 2024", "2025-06-01", 2024), ("Ejercicio: 2023 y ejercicio 2024", "2025-06-01", 2025), ("sin año", "2022-01-31", 2022), ("Tax year 2021, tax year 2021", None, 2021), ("nada", None, None)]


def fiscal(spark, sf):
    d = spark.createDataFrame([(a, b) for a, b, _ in FISCAL], "text string, day string")
    return d.select("text", formats.fiscal_year(F.col("text"), F.to_date("day")).alias("year"))


FISCAL_SQL = _values("text year", [(a, y) for a, _, y in FISCAL], "VARCHAR INT")


def copies(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return d.groupBy("sha").agg(F.count("*").alias("users"), F.min("doc_id").alias("first"))


COPIES = "SELECT sha256(coalesce(text, '')) AS sha, count(*) AS users, min(doc_id) AS first FROM documents GROUP BY 1"


def source_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


SOURCE_COUNTS = "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL"


def bit_distance(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") * 2654435761).alias("h"))
    return e.select("event_id", F.bit_count(F.col("h").bitwiseXOR(F.lit(123456789))).cast("long").alias("distance"))


BIT_DISTANCE = "SELECT event_id, CAST(bit_count(xor(CAST(user_id AS BIGINT) * 2654435761, CAST(123456789 AS BIGINT))) AS BIGINT) AS distance FROM events"


def listing(spark, sf):
    """The third page of 50 open orders of a window of days, by day and then by number."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01'")
    return o.orderBy("o_orderdate", "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderpriority")


LISTING = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100"

LINKS = [
    ("https://www.Shop.example/a/?utm_source=x&id=7#top", "https://shop.example/a?id=7"), ("http://etsy.com/item?ref=home&q=2", "https://etsy.com/item?q=2"), ("http://forum.example/t?ref=9", "https://forum.example/t?ref=9"),
    ("https://x.example/p?b=2&a=1&trkCampaign=z&_gl=1&mc_any=4", "https://x.example/p?a=1&b=2"), ("https://x.example/?spm=1", "https://x.example"), ("https://x.example/p?preference=1", "https://x.example/p?preference=1"),
]


def link_keys(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in LINKS], "url string").select("url", text.url_key("url").alias("key"))


LINKS_SQL = _values("url key", LINKS, "VARCHAR VARCHAR")

QUERIES = {
    "link_keys": (link_keys, LINKS_SQL),
    "to_srt": (srt, SRT), "to_vtt": (vtt, VTT), "parse_subtitles": (parsed, PARSED), "cues_to_text": (speech, SPEECH), "build_ics": (ics, ICS), "to_csv": (csv, CSV), "id_time": (ids, IDS), "version_order": (versions, VERSIONS_SQL), "address_class": (addresses, ADDRESSES_SQL),
    "script_of": (scripts, SCRIPTS_SQL), "decimal_mark": (marks, MARKS), "resolve_year": (years, YEARS), "spoken_date": (spoken, SPOKEN_SQL), "parse_qty": (quantities, QUANTITIES_SQL), "fiscal_year": (fiscal, FISCAL_SQL), "sha_users": (copies, COPIES), "count_documents": (source_counts, SOURCE_COUNTS),
    "bit_distance": (bit_distance, BIT_DISTANCE), "deadline_page": (listing, LISTING),
}

#: Rows of our own with the values they must give; the tests run them, the registry has queries over given tables.
CASES = {k: QUERIES.pop(k) for k in ("link_keys", "version_order", "address_class", "script_of", "spoken_date", "parse_qty", "fiscal_year")}
