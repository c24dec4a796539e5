"""Queries: working-day calendar, legal deadlines, identifier checks, amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import calendar, checks, money, text
from vellumspark.session import table

YEARS = (1991, 2001)


def _days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def _calendar(spark, region="ES-VC"):
    return calendar.calendar(spark, *YEARS, region)


_EASTER = """SELECT y, make_date(y, p // 31, p % 31 + 1) AS easter FROM (SELECT y, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS p FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS m FROM (
SELECT *, (19 * a + b - d - (8 * b + 13) // 25 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b, (y // 100) // 4 AS d, (y // 100) % 4 AS e, (y % 100) // 4 AS i, (y % 100) % 4 AS k FROM (SELECT CAST(unnest(range({a}, {b})) AS BIGINT) AS y)))))"""


def _cal_sql(region="ES-VC"):
    days, feast = calendar.REGIONS[region]
    fixed = [*calendar.FIXED, *days]
    moves = calendar.SUNDAY_MOVES if region != "ES-CT" else ()
    rows = ", ".join(f"({m}, {d}, {str((m, d) in moves).lower()})" for m, d in fixed)
    off = " UNION ".join(f"SELECT easter + {n} FROM e" for n in feast)
    return f"""e AS ({_EASTER.format(a=YEARS[0], b=YEARS[1] + 1)}), f(m, d, mv) AS (VALUES {rows}),
off AS (SELECT CAST(CASE WHEN mv AND isodow(x) = 7 THEN x + 1 ELSE x END AS DATE) AS day FROM (SELECT make_date(y, m, d) AS x, mv FROM e, f) UNION {off}),
days AS (SELECT CAST(unnest(generate_series(DATE '{YEARS[0]}-01-01', DATE '{YEARS[1]}-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
cal AS (SELECT day, working, CAST(sum(CAST(working AS INT)) OVER (ORDER BY day) AS INT) AS seq, min(CASE WHEN working THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_working,
 max(CASE WHEN working THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous_working FROM (SELECT day, isodow(day) < 6 AND day NOT IN (SELECT day FROM off) AS working FROM days))"""


def easter(spark, sf):
    return spark.range(1900, 2100).select(F.col("id").alias("y"), calendar.easter(F.col("id").cast("int")).alias("easter"))


EASTER = _EASTER.format(a=1900, b=2100)


def cal(spark, sf):
    return _calendar(spark)


CAL = f"WITH {_cal_sql()} SELECT * FROM cal"


def biz_days(spark, sf):
    c = _calendar(spark)
    d = calendar.add_working_days(_days(spark, sf), c, "day", 10, "plus_ten")
    d = calendar.add_working_days(d, c, "day", -3, "minus_three")
    return calendar.roll(d, c, "day", "rolled").select("o_orderkey", "plus_ten", "minus_three", "rolled")


BIZ = f"""WITH {_cal_sql()}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, p.day AS plus_ten, m.day AS minus_three, c.next_working AS rolled FROM o JOIN cal c ON c.day = o.day
LEFT JOIN cal p ON p.working AND p.seq = c.seq + 10 LEFT JOIN cal m ON m.working AND m.seq = c.seq - 3 + CASE WHEN c.working THEN 0 ELSE 1 END"""


def biz_between(spark, sf):
    c = _calendar(spark).select("day", "seq")
    d = _days(spark, sf).withColumn("other", F.date_add("day", (F.col("o_orderkey") % 60).cast("int")))
    d = d.join(F.broadcast(c.select("day", F.col("seq").alias("a"))), "day").join(F.broadcast(c.select(F.col("day").alias("other"), F.col("seq").alias("b"))), "other")
    return d.select("o_orderkey", (F.col("b") - F.col("a")).alias("working_days"), F.datediff("other", "day").alias("days"))


BETWEEN = f"""WITH {_cal_sql()}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS other FROM orders)
SELECT o_orderkey, b.seq - a.seq AS working_days, CAST(date_diff('day', o.day, other) AS INT) AS days FROM o JOIN cal a ON a.day = o.day JOIN cal b ON b.day = other"""


def admin(spark, sf):
    c = _calendar(spark)
    d = calendar.admin_deadline(_days(spark, sf), c, "day", 10, "day", True, "ten_working")
    d = calendar.admin_deadline(d, c, "day", 20, "day", False, "discount")
    d = calendar.admin_deadline(d, c, "day", 1, "month", False, "month")
    return d.select("o_orderkey", "ten_working", "discount", "month", (F.col("discount") != F.date_add("day", 20)).alias("moved"))


ADMIN = f"""WITH {_cal_sql()}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, w.day AS ten_working, t.next_working AS discount, n.next_working AS month, t.next_working <> o.day + 20 AS moved FROM o JOIN cal c ON c.day = o.day LEFT JOIN cal w ON w.working AND w.seq = c.seq + 10
LEFT JOIN cal t ON t.day = o.day + 20 LEFT JOIN cal n ON n.day = CAST(o.day + INTERVAL 1 MONTH AS DATE)"""


def terms(spark, sf):
    return _days(spark, sf).select("o_orderkey", F.add_months("day", 36).alias("warranty_end"), F.add_months("day", -1).alias("cancel_by"), F.next_day("day", "FRI").alias("next_friday"), F.last_day("day").alias("month_end"), F.concat_ws(" ", F.dayofmonth("day"), F.element_at(F.split(F.lit("ene feb mar abr may jun jul ago sep oct nov dic"), " "), F.month("day")), F.year("day")).alias("human"))


TERMS = """SELECT o_orderkey, CAST(day + INTERVAL 36 MONTH AS DATE) AS warranty_end, CAST(day - INTERVAL 1 MONTH AS DATE) AS cancel_by, CAST(day + CAST((4 - isodow(day) + 7) % 7 + 1 AS INT) AS DATE) AS next_friday, last_day(day) AS month_end,
concat_ws(' ', day(day), string_split('ene feb mar abr may jun jul ago sep oct nov dic', ' ')[month(day)], year(day)) AS human FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"""

#: Invented numbers, right and wrong ones of each kind, with what each check says.
IDS = [
    ("4539578763621486", "luhn", True), ("4539578763621487", "luhn", False), ("79927398713", "luhn", True), ("ES91 2100 0418 4502 0005 1332", "iban", True), ("ES92 2100 0418 4502 0005 1332", "iban", False), ("DE89370400440532013000", "iban", True), ("GB82WEST12345698765432", "iban", True), ("GB82WEST1234569876543", "iban", False),
    ("12345678Z", "nif", True), ("12345678A", "nif", False), ("X1234567L", "nif", True), ("X1234567M", "nif", False), ("A58818501", "nif", True), ("A58818502", "nif", False), ("A5881850A", "nif", False), ("P2807900B", "nif", True), ("P28079002", "nif", False), ("K1234567L", "nif", True), ("M1234567A", "nif", False), ("4006381333931", "ean", True), ("4006381333932", "ean", False), ("73513537", "ean", True), ("0306406152", "isbn", True), ("0306406153", "isbn", False), ("080442957X", "isbn", True), ("9780306406157", "isbn", True), ("9780306406158", "isbn", False),
]


def ids(spark, sf):
    d = spark.createDataFrame([(a, b) for a, b, _ in IDS], "value string, kind string")
    ok = F.when(F.col("kind") == "luhn", checks.luhn("value")).when(F.col("kind") == "iban", checks.iban("value")).when(F.col("kind") == "nif", checks.nif("value")).when(F.col("kind") == "ean", checks.ean("value")).otherwise(checks.isbn("value"))
    return d.select("value", "kind", ok.alias("ok"))


IDS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in IDS) + ") AS t(value, kind, ok)"

AMOUNTS = [("1.234,56 €", "1234.56"), ("1,234.56", "1234.56"), ("1.234", "1234"), ("12,5", "12.5"), ("-45,90", "-45.90"), ("1 234 567,00", "1234567"), ("0,99", "0.99"), ("abc", None), ("1.234.567", "1234567"), ("3.5", "3.5")]


def amounts(spark, sf):
    d = spark.createDataFrame([(a,) for a, _ in AMOUNTS], "raw string")
    return d.select("raw", money.parse_amount("raw").alias("amount"))


AMOUNTS_SQL = "SELECT raw, CAST(amount AS DECIMAL(18,4)) AS amount FROM (VALUES " + ", ".join(f"('{a}', {b or 'NULL'})" for a, b in AMOUNTS) + ") AS t(raw, amount)"

CONTACTS = [("Ana <Ana.Lopez+news@GMail.com>", "600 123 456", "analopez@gmail.com", "+34600123456"), ("x.y@googlemail.com", "0044 20 7946 0958", "xy@gmail.com", "+442079460958"), ("Bob@Example.ORG", "+1 (555) 010-9999", "bob@example.org", "+15550109999"), ("nobody", "12", None, None)]


def contacts(spark, sf):
    d = spark.createDataFrame([(a, b) for a, b, _, _ in CONTACTS], "mail string, phone string")
    return d.select("mail", text.email("mail").alias("email"), text.phone("phone").alias("number"))


CONTACTS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {repr(c) if c else 'NULL'}, {repr(p) if p else 'NULL'})" for a, _, c, p in CONTACTS) + ") AS t(mail, email, number)"


def companies(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.element_at(F.array(*map(F.lit, [" S.L.", ", S.A.", " GmbH", ""])), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("name"))
    return c.select("c_custkey", text.company_key("name").alias("key"))


COMPANIES = f"""SELECT c_custkey, regexp_replace(trim(regexp_replace(translate(lower(c_name || [' S.L.', ', S.A.', ' GmbH', ''][c_custkey % 4 + 1]), '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' (s ?a ?u?|s ?l ?u?|ltd|inc|llc|gmbh|sas|sarl)$', '') AS key FROM customer"""

QUERIES = {
    "easter": (easter, EASTER), "calendar": (cal, CAL), "biz_days": (biz_days, BIZ), "biz_days_between": (biz_between, BETWEEN), "admin_deadline": (admin, ADMIN), "contract_terms": (terms, TERMS), "id_checks": (ids, IDS_SQL), "parse_amount": (amounts, AMOUNTS_SQL),
    "contacts": (contacts, CONTACTS_SQL), "company_keys": (companies, COMPANIES),
}

#: Rows of our own with the values they must give; the tests run them, the registry has queries over given tables.
CASES = {k: QUERIES.pop(k) for k in ("easter", "calendar", "id_checks", "parse_amount", "contacts")}
