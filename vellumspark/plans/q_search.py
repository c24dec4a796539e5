"""Queries: text functions, search, ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.functions import checks, formats, money, text
from vellumspark.operators import relate, search
from vellumspark.session import table

A, P = text.ACCENTED, text.PLAIN
TOK = f"regexp_extract_all(translate(lower(text), '{A}', '{P}'), '[a-z0-9]+')"
TERMS = ["license", "version", "public"]


def bm25(spark, sf):
    return search.bm25(table(spark, sf, "documents"), TERMS, 20).select(F.col("id").alias("doc_id"), "score")


BM25 = f"""
WITH t AS (SELECT doc_id, {TOK} AS tok FROM documents), q(term) AS (VALUES {', '.join(f"('{x}')" for x in TERMS)}),
w AS (SELECT count(*) AS n, avg(len(tok)) AS l FROM t),
p AS (SELECT doc_id, len(tok) AS len, term, len(list_filter(tok, lambda x: x = term)) AS tf FROM t, q),
h AS (SELECT * FROM p WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(greatest(0.1, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l))), 6) AS score
FROM h JOIN d USING (term), w GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
"""


def ladder(spark, sf):
    return search.ladder(table(spark, sf, "documents"), ["licen", "general"]).select(F.col("id").alias("doc_id"), "rung")


LADDER = f"""
WITH t AS (SELECT doc_id, {TOK} AS tok FROM documents),
m AS (SELECT doc_id, CASE WHEN list_contains(tok, 'licen') AND list_contains(tok, 'general') THEN 1
  WHEN len(list_filter(tok, lambda x: starts_with(x, 'licen'))) > 0 AND len(list_filter(tok, lambda x: starts_with(x, 'general'))) > 0 THEN 2
  WHEN list_contains(tok, 'licen') OR list_contains(tok, 'general') THEN 3 END AS rung FROM t)
SELECT doc_id, rung FROM m WHERE rung = (SELECT min(rung) FROM m)
"""


def rrf(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 0")
    a = d.select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    b = d.select("doc_id", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")).alias("rank"))
    return search.reciprocal_ranks(a.union(b), "doc_id", "rank")


RRF = """
WITH d AS (SELECT * FROM documents WHERE n_chars > 0), r AS (
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM d
UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM d)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY doc_id
"""


def minmax(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", "n_chars")
    s = d.groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("s"))
    return search.fuse_scaled(s, "lang", "source", "s")


MINMAX = """
WITH s AS (SELECT lang, source, CAST(sum(n_chars) AS DOUBLE) AS s FROM documents GROUP BY lang, source),
e AS (SELECT lang, min(s) AS lo, max(s) AS hi FROM s GROUP BY lang)
SELECT source, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END / (SELECT count(*) FROM e)), 9) AS score FROM s JOIN e USING (lang) GROUP BY source
"""


def cosine_top(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.cosine_top(v, F.array(*[F.lit(((i * 7) % 11 - 5) / 5.0) for i in range(64)]), 25)


COSINE = """
WITH q AS (SELECT list_transform(range(64), lambda i: ((i * 7) % 11 - 5) / 5.0::DOUBLE) AS q),
s AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q)
SELECT id, score FROM s WHERE score >= 0 ORDER BY score DESC, id LIMIT 25
"""


def unit_norm(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", money.unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(money.dot(F.col("u"), F.col("u")), 6).alias("norm"))


UNIT = """
WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM u)
SELECT vec_id, round(e[1] / n, 6) AS first, round(list_inner_product(e, e) / (n * n), 6) AS norm FROM n
"""


def fold_tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", text.tokens("text").alias("tok"))
    return t.select("doc_id", F.size("tok").cast("long").alias("n_tokens"), F.size(F.array_distinct("tok")).cast("long").alias("n_distinct"), F.get("tok", F.lit(0)).alias("first"), F.sha2(F.array_join("tok", " "), 256).alias("sha"))


FOLD = f"SELECT doc_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct, tok[1] AS first, sha256(array_to_string(tok, ' ')) AS sha FROM (SELECT doc_id, {TOK} AS tok FROM documents)"


def useful(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.sum(text.useful_chars("text")).alias("useful"), F.sum(F.char_length("text")).alias("chars"))


USEFUL = r"SELECT lang, CAST(sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS BIGINT) AS useful, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang"


def stems(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(text.tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.groupBy(text.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms")).where("forms > 1")


STEMS = f"""
WITH w AS (SELECT unnest({TOK}) AS w FROM documents), s AS (SELECT CASE WHEN length(w) > 5 AND w LIKE '%es' THEN w[1:length(w) - 2] WHEN length(w) > 4 AND w LIKE '%s' THEN w[1:length(w) - 1] ELSE w END AS stem, w FROM w)
SELECT stem, count(*) AS n, count(DISTINCT w) AS forms FROM s GROUP BY stem HAVING count(DISTINCT w) > 1
"""


def cleaned(spark, sf):
    c = text.clean("text")
    return table(spark, sf, "documents").select("doc_id", F.char_length(c).cast("long").alias("n"), F.sha2(c, 256).alias("sha"), text.slug("text").alias("slug"), text.clamp("text", 60).alias("short"))


def _clean_sql(c: str) -> str:
    steps = [(r"\r\n?", "chr(10)"), ("[​‌‍⁠﻿­]", "''"), ("[ \\t\\f\\v ]+", "' '"), (r"(\p{L})-\n(\p{Ll})", r"'\1\2'"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")]
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return f"trim({c})"


CLEANED = f"""
WITH c AS (SELECT doc_id, {_clean_sql('text')} AS c, trim(regexp_replace(translate(lower(text), '{A}', '{P}'), '[^a-z0-9]+', '-', 'g'), '-') AS s, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, length(c) AS n, sha256(c) AS sha, CASE WHEN length(s) <= 80 THEN s ELSE trim(regexp_replace(s[1:81], '-[^-]*$', ''), '-') END AS slug,
CASE WHEN length(x) <= 60 THEN x ELSE rtrim(regexp_replace(x[1:60], ' [^ ]*$', '')) || '…' END AS short FROM c
"""


def languages(spark, sf):
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    got = text.languages(d, "doc_id", "text", formats.script)
    return got.join(d.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.nullif("code", F.lit("")).alias("guess"), "hits", "confidence")


_VOTES = ", ".join(f"len(list_filter(tok, lambda x: list_contains([{', '.join(repr(w) for w in text.STOP_WORDS[k].split())}], x))) AS {k}" for k in text.STOP_WORDS)
_FIRST = " ".join(f"WHEN {k} = hits THEN '{k}'" for k in text.STOP_WORDS)
LANGUAGES = f"""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '\\p{{L}}+') AS tok FROM documents),
h AS (SELECT doc_id, lang, len(tok) AS n, {_VOTES} FROM t), b AS (SELECT *, greatest({', '.join(text.STOP_WORDS)}) AS hits, {' + '.join(text.STOP_WORDS)} AS every FROM h)
SELECT doc_id, lang, CASE WHEN n >= 3 AND hits > 0 THEN CASE {_FIRST} END END AS guess, CAST(hits AS BIGINT) AS hits,
  CASE WHEN n >= 3 AND hits > 0 THEN round(CAST(hits AS DOUBLE) / every * least(1.0, CAST(hits AS DOUBLE) / greatest(3.0, n * CAST(0.25 AS DOUBLE))), 2) ELSE 0.0 END AS confidence FROM b
"""


def language_share(spark, sf):
    g = languages(spark, sf).where("guess IS NOT NULL").join(table(spark, sf, "documents").select("doc_id", text.useful_chars("text").alias("w")), "doc_id")
    s = g.groupBy("guess").agg(F.sum("w").alias("w"))
    whole = s.agg(F.sum("w").alias("t"))
    return s.crossJoin(F.broadcast(whole)).select("guess", F.round(F.col("w") / F.col("t"), 6).alias("share"))


SHARE = rf"""
WITH g AS ({LANGUAGES}), s AS (SELECT guess, sum(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'))) AS w FROM g JOIN documents d ON g.doc_id = d.doc_id WHERE guess IS NOT NULL GROUP BY guess)
SELECT guess, round(CAST(w AS DOUBLE) / (SELECT sum(w) FROM s), 6) AS share FROM s
"""


def url_keys(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.url_key("url").alias("key"), text.host("url").alias("host"), text.domain("url").alias("domain"))


URLS = r"""
WITH a AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages),
c AS (SELECT *, 'https://' || regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(regexp_replace(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', ''), '\?.*$', ''), '/+$', '') AS w,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, 'TRACKING') AND NOT (regexp_matches(p, '(?i)^ref(=|$)') AND regexp_matches(host, 'REF_HOST')))), '&') AS q FROM a)
SELECT page_id, CASE WHEN q = '' THEN w ELSE w || '?' || q END AS key, host,
 CASE WHEN regexp_matches(host, '\.(co|com|org|net|gob|gov|ac|edu)\.[a-z]{2}$') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM c
""".replace("TRACKING", text.TRACKING).replace("REF_HOST", text.REF_HOST)


def url_dedupe(spark, sf):
    k = url_keys(spark, sf)
    return k.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


URL_DEDUPE = f"SELECT key, min(page_id) AS page_id, count(*) AS n FROM ({URLS}) GROUP BY key"


def exact_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


EXACT = "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"


def headers(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return relate.repeated_lines(d, "source", "doc_id", "line", 0.05)


HEADERS = r"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT DISTINCT source, doc_id, trim(regexp_replace(lower(line), '\d+', '#', 'g')) AS form FROM l),
t AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY source)
SELECT source, form, count(*) AS pages FROM f JOIN t USING (source) WHERE form <> '' AND length(form) <= 160 AND n >= 3 GROUP BY source, form, n HAVING count(*) > n * 0.05
"""


def html_titles(spark, sf):
    p = table(spark, sf, "pages")
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html[^>]* lang="([a-z]+)"', 1).alias("lang"), F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


TITLES = """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1) AS lang,
len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_links, array_to_string(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), ' ') AS links FROM pages
"""


def pii(spark, sf):
    d = table(spark, sf, "documents")
    mails = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0))
    cards = F.filter(F.regexp_extract_all("text", F.lit(r"\b[0-9]{13,19}\b"), F.lit(0)), checks.luhn)
    out = d.select("doc_id", F.array_join(mails, " ").alias("mails"), F.array_join(cards, " ").alias("cards"))
    return out.where("mails <> '' OR cards <> ''")


PII = r"""
WITH m AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), ' ') AS mails, array_to_string(list_filter(regexp_extract_all(text, '\b[0-9]{13,19}\b'),
 lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i:i] AS INT) WHEN CAST(x[i:i] AS INT) > 4 THEN 2 * CAST(x[i:i] AS INT) - 9 ELSE 2 * CAST(x[i:i] AS INT) END)) % 10 = 0), ' ') AS cards FROM documents)
SELECT * FROM m WHERE mails <> '' OR cards <> ''
"""


def quality_gate(spark, sf):
    d = table(spark, sf, "documents")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) <= 3))
    state = F.when(n < 40, "too_short").when((n < 400) & (short > F.size(lines) * 0.85), "navigation").otherwise("usable")
    return d.select(state.alias("state"), "lang").groupBy("state", "lang").agg(F.count("*").alias("n"))


QUALITY = r"""
WITH a AS (SELECT lang, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
b AS (SELECT lang, len(w) AS n, len(l) AS lines, len(list_filter(l, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) <= 3)) AS short FROM a)
SELECT CASE WHEN n < 40 THEN 'too_short' WHEN n < 400 AND short > lines * 0.85 THEN 'navigation' ELSE 'usable' END AS state, lang, count(*) AS n FROM b GROUP BY ALL
"""


def edit_scores(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_replace(text.fold("text"), "[^ -~]", "?").alias("a"))
    shifted = b.select((F.col("item_id") + 1).alias("item_id"), F.col("a").alias("b"))
    return b.join(shifted, "item_id").select("item_id", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(F.levenshtein("a", "b") / F.greatest(F.char_length("a"), F.char_length("b")), 6).alias("rate"))


EDITS = f"""
WITH b AS (SELECT item_id, regexp_replace(translate(lower(text), '{A}', '{P}'), '[^ -~]', '?', 'g') AS a FROM benchmark)
SELECT c.item_id, levenshtein(c.a, b.a) AS distance, round(CAST(levenshtein(c.a, b.a) AS DOUBLE) / greatest(length(c.a), length(b.a)), 6) AS rate FROM b JOIN b c ON c.item_id = b.item_id + 1
"""

QUERIES = {
    "flagship_search": (bm25, BM25), "search_bm25": (bm25, BM25), "search_ladder": (ladder, LADDER), "rrf_fusion": (rrf, RRF), "minmax_fusion": (minmax, MINMAX), "cosine_topk": (cosine_top, COSINE),
    "unit_norm": (unit_norm, UNIT), "fold_tokens": (fold_tokens, FOLD), "useful_chars": (useful, USEFUL), "stem_groups": (stems, STEMS), "clean_text": (cleaned, CLEANED), "lang_detect": (languages, LANGUAGES), "lang_share": (language_share, SHARE),
    "url_key": (url_keys, URLS), "url_dedupe": (url_dedupe, URL_DEDUPE), "exact_dedupe": (exact_dedupe, EXACT), "line_headers": (headers, HEADERS), "html_title": (html_titles, TITLES), "pii_scan": (pii, PII), "quality_gate": (quality_gate, QUALITY),
    "edit_distance": (edit_scores, EDITS),
}
