"""Queries: edit scripts, names in texts, aligned clauses, reach over links, path rules, settled balances, clusters, refreshed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions.text import tokens
from vellumspark.operators import annotate, editscript, pairing, reach, settle
from vellumspark.operators.refresh import Derived
from vellumspark.session import table
from vellumspark.streaming.jobs import place


def _related(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d, editscript.relatives(d, "doc_id", "text")


def edit_script(spark, sf):
    """Every change, word by word, from the document that shares a document's longest line to that document."""
    d, pairs = _related(spark, sf)
    got = editscript.edit_script(d, pairs, "doc_id", "text")
    return got.select("doc_id", "of", "kind", "before_at", "before_line", F.array_join("before", " ").alias("was"), "after_at", "after_line", F.array_join("after", " ").alias("now"))


def _phrases(spark, sf):
    """The first 2, 3 and 5 words of every benchmark item as names, with the item."""
    w = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0).alias("w"))
    return w.select("item_id", F.explode(F.array(*[F.array_join(F.slice("w", 1, n), " ") for n in (2, 3, 5)])).alias("name"))


def name_mentions(spark, sf):
    """Where the names stand in all documents."""
    got = annotate.annotate(table(spark, sf, "documents").where("doc_id IS NOT NULL"), "doc_id", "text", _phrases(spark, sf), "name")
    return got.select("doc_id", "start", "stop", "name")


#: Words with places, runs of up to five of them that are names, and the fold that keeps the longest, then leftmost.
_MENTIONS = r"""
names AS (SELECT DISTINCT lower(array_to_string(w[1:n], ' ')) AS name FROM (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM benchmark), (VALUES (2), (3), (5)) AS k(n)),
pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')) AS x, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')))) AS i FROM documents),
placed AS (SELECT doc_id, x, i, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS BIGINT) AS s FROM pieces),
words AS (SELECT doc_id, lower(x) AS x, s, s + length(x) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM placed WHERE regexp_matches(x, '^[\p{L}\p{N}]')),
runs AS (
  SELECT doc_id, i, s, n, string_agg(x, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS five, 
    array_to_string(list(x) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)[1:n], ' ') AS name,
    list(e) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)[n] AS e
  FROM words, (VALUES (1), (2), (3), (4), (5)) AS k(n)),
hits AS (SELECT doc_id, i, n, s, e, name FROM runs JOIN names USING (name) WHERE e IS NOT NULL),
kept AS (
  SELECT doc_id, unnest(list_reduce(list([{'i': i, 'n': n, 's': s, 'e': e, 'name': name}] ORDER BY n DESC, i),
    lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.i < x[1].i + x[1].n AND x[1].i < y.i + y.n)) = 0 THEN list_concat(a, x) ELSE a END)) AS m
  FROM hits GROUP BY doc_id),
mentions AS (SELECT doc_id, m.s AS start, m.e AS stop, m.name AS name FROM kept)
"""

NAME_MENTIONS = f"WITH {_MENTIONS} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, name FROM mentions"


def name_variants(spark, sf):
    """Every document that names an item, with the names of the next item put in."""
    names, d = _phrases(spark, sf), table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    head = table(spark, sf, "benchmark").select((F.col("item_id") - 1).alias("item_id"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ").alias("other"))
    found = annotate.annotate(d, "doc_id", "text", names, "name")
    got = annotate.expand(d, "doc_id", "text", found, names.join(head, "item_id"), "name", "other")
    return got.select("doc_id", F.sha2("variant", 256).alias("variant_sha256"), F.char_length("variant").cast("long").alias("n_chars"))


NAME_VARIANTS = f"""
WITH {_MENTIONS}, head AS (SELECT item_id - 1 AS item_id, array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:2], ' ') AS other FROM benchmark),
other AS (
  SELECT name, min(other) AS other FROM (SELECT item_id, lower(array_to_string(w[1:n], ' ')) AS name FROM (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark), (VALUES (2), (3), (5)) AS k(n)) JOIN head USING (item_id) GROUP BY name),
swaps AS (SELECT doc_id, start, stop, other, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS back FROM mentions JOIN other USING (name) WHERE lower(array_to_string(regexp_extract_all(other, '[\\p{{L}}\\p{{N}}]+'), ' ')) <> name),
made AS (SELECT doc_id, string_agg(substring(text, CAST(back + 1 AS BIGINT), CAST(start - back AS BIGINT)) || other, '' ORDER BY start) || substring(any_value(text), CAST(max(stop) + 1 AS BIGINT)) AS v FROM swaps JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, sha256(v) AS variant_sha256, CAST(length(v) AS BIGINT) AS n_chars FROM made
"""


def clause_changes(spark, sf):
    """How the lines of a document and of the one that shares its longest line correspond; lines that begin with the same three words are paired by them where both sides have them once."""
    d, pairs = _related(spark, sf)
    ends = pairs.select(F.col("doc_id").alias("g"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("of").alias("id")), F.struct(F.lit(1).alias("side"), F.col("doc_id").alias("id")))).alias("e")).select("g", "e.side", "e.id")
    lines = ends.join(d.select(F.col("doc_id").alias("id"), "text"), "id").select("g", "side", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
    units = lines.select("g", "side", "i", F.when(F.size(w) >= 3, F.array_join(F.slice(w, 1, 3), " ")).alias("key"), "text", F.array_distinct(w).alias("words")).where(F.size("words") > 0)
    got = pairing.align(spark, units)
    return got.select(F.col("g").alias("doc_id"), "change", F.col("a").alias("before_line"), F.col("b").alias("after_line"), F.round("score", 6).alias("score"))


CLAUSE_CHANGES = r"""
WITH folded AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, (SELECT x FROM (SELECT unnest(l) AS x) ORDER BY length(x) DESC, x DESC LIMIT 1) AS line FROM folded),
pairs AS (SELECT DISTINCT doc_id AS g, min(doc_id) OVER (PARTITION BY line) AS o FROM h WHERE line <> ''),
ends AS (SELECT g, 0 AS side, o AS id FROM pairs WHERE g <> o UNION ALL SELECT g, 1, g FROM pairs WHERE g <> o),
lines AS (SELECT g, side, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM ends JOIN documents ON id = doc_id),
units AS (SELECT g, side, i, text, w[1:3] AS three, len(w) AS n, list_distinct(w) AS words FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM lines) WHERE len(w) > 0),
once AS (SELECT g, side, array_to_string(three, ' ') AS key, min(i) AS i FROM units WHERE n >= 3 GROUP BY ALL HAVING count(*) = 1),
bykey AS (SELECT x.g, x.i AS a, y.i AS b FROM once x JOIN once y ON x.g = y.g AND x.key = y.key AND x.side = 0 AND y.side = 1),
rest AS (SELECT * FROM units u WHERE NOT EXISTS (SELECT 1 FROM bykey k WHERE k.g = u.g AND CASE WHEN u.side = 0 THEN k.a ELSE k.b END = u.i)),
edges AS (SELECT x.g, x.i AS a, y.i AS b, len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) AS s FROM rest x JOIN rest y ON x.g = y.g AND x.side = 0 AND y.side = 1),
taken AS (
  SELECT g, unnest(list_reduce(list([{'a': a, 'b': b, 's': s}] ORDER BY s DESC, a, b), lambda k, x: CASE WHEN len(list_filter(k, lambda y: y.a = x[1].a OR y.b = x[1].b)) = 0 THEN list_concat(k, x) ELSE k END)) AS m
  FROM edges WHERE s >= 0.6 GROUP BY g),
pair AS (SELECT g, a, b, CAST(NULL AS DOUBLE) AS s FROM bykey UNION ALL SELECT g, m.a, m.b, m.s FROM taken),
old AS (SELECT g, i AS a, text AS x FROM units WHERE side = 0), new AS (SELECT g, i AS b, text AS y FROM units WHERE side = 1)
SELECT coalesce(l.g, new.g) AS doc_id, CASE WHEN l.a IS NULL THEN 'added' WHEN new.b IS NULL THEN 'removed' WHEN l.x = new.y THEN 'same' ELSE 'modified' END AS change,
  CAST(l.a AS INTEGER) AS before_line, CAST(new.b AS INTEGER) AS after_line, round(l.s, 6) AS score
FROM (SELECT old.g, old.a, old.x, pair.b, pair.s FROM old LEFT JOIN pair ON old.g = pair.g AND old.a = pair.a) l FULL JOIN new ON l.g = new.g AND l.b = new.b
"""


def linked_customers(spark, sf):
    """What is two links or less from every five-hundredth customer, customers and parts being linked by orders."""
    li, o = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    links = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    starts = table(spark, sf, "customer").where("c_custkey % 500 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    return reach.around(spark, starts, links, 2)


LINKED_CUSTOMERS = """
WITH RECURSIVE l AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey % 500 = 0 UNION SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a WHERE r.depth < 2)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY start, node
"""


def url_rules(spark, sf):
    """Whether rules that each host gives, cut from its own addresses, allow every page."""
    u = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1).alias("path"))
    h = u.groupBy("host").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    rule = lambda pattern, allow: F.struct(pattern.alias("pattern"), F.lit(allow).alias("allow"))
    rules = h.select("host", F.explode(F.array(
        rule(F.regexp_extract("least", "^(/[^/?]*/)", 1), False), rule(F.substring("most", 1, 5), True), rule(F.col("most"), False), rule(F.lit("/*?utm_"), False), rule(F.lit("/*.html$"), True), rule(F.concat(F.lit("/*/"), F.right("least", F.lit(1)), F.lit("$")), True),
    )).alias("r")).select("host", "r.*")
    return reach.allowed(u, rules).select("page_id", "ok")


URL_RULES = r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages),
h AS (SELECT host, min(path) AS least, max(path) AS most FROM u GROUP BY host),
rules AS (
  SELECT host, regexp_extract(least, '^(/[^/?]*/)', 1) AS pattern, false AS allow FROM h UNION SELECT host, most[1:5], true FROM h UNION SELECT host, most, false FROM h UNION SELECT host, '/*?utm_', false FROM h
  UNION SELECT host, '/*.html$', true FROM h UNION SELECT host, '/*/' || right(least, 1) || '$', true FROM h),
fit AS (
  SELECT page_id, pattern, allow FROM u JOIN rules r ON u.host = r.host AND pattern <> '' AND regexp_matches(CASE WHEN path = '' THEN '/' ELSE path END,
    '^' || replace(regexp_replace(CASE WHEN pattern LIKE '%$' THEN pattern[:-2] ELSE pattern END, '([.?+()\[\]{}|\\^$])', '\\\1', 'g'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END)),
best AS (SELECT page_id, allow FROM fit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC) = 1)
SELECT u.page_id, path LIKE '/robots.txt%' OR coalesce(allow, true) AS ok FROM u LEFT JOIN best USING (page_id)
"""


def settlements(spark, sf):
    """The fewest transfers that even out how many orders each nation's market segments have by status."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = o.groupBy("n_name", F.concat_ws("/", "c_mktsegment", "o_orderstatus").alias("party")).agg(F.count("*").alias("n"))
    whole = n.groupBy("n_name").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return settle.settle(n.join(whole, "n_name").withColumn("v", F.col("n") * F.col("k") - F.col("total")), "n_name", "party", "v")


def line_clusters(spark, sf):
    """The lines of each document and benchmark item clustered in order, a cluster growing by each member's words."""
    words = F.transform(F.split("text", "\n"), lambda x: F.array_distinct(tokens(x)))
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), words.alias("units"))
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), words.alias("units"))
    return settle.cluster_requirements(d.union(b), "id", "units")


def refreshed_counts(spark, sf):
    """Line and letter counts of the documents, first of a version in which every seventh was otherwise and every eleventh lacked, then refreshed: only their parts are read and written again."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    before = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit("\nan old line"))).otherwise(F.col("text")))
    gone = d.where("doc_id % 13 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    t = Derived(spark, place(spark, "derived"), "doc_id", ["text"], lambda s: s.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.char_length("text").alias("n_chars")))
    t.refresh(before.union(gone))
    t.refresh(d)
    return t.read().select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_chars").cast("long").alias("n_chars"))


REFRESHED_COUNTS = "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(length(text) AS BIGINT) AS n_chars FROM documents"

QUERIES = {
    "edit_script": (edit_script, None), "name_mentions": (name_mentions, NAME_MENTIONS), "name_variants": (name_variants, NAME_VARIANTS), "clause_changes": (clause_changes, CLAUSE_CHANGES), "linked_customers": (linked_customers, LINKED_CUSTOMERS),
    "url_rules": (url_rules, URL_RULES), "settlements": (settlements, None), "line_clusters": (line_clusters, None), "refreshed_counts": (refreshed_counts, REFRESHED_COUNTS),
}
