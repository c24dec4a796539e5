"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chats, decontamination, hardneg, html, linedup, neardup, quality, sharding, tokencounts, topk, toxicity, whitening


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_near_dedup": neardup.op2_near_dedup,
        "op3_top_k": topk.op3_top_k,
        "op4_quality": quality.op4_quality,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_line_dedup": linedup.op6_line_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_html": html.op8_html,
        "op9_chat_format": chats.op9_chat_format,
        "op10_token_counts": tokencounts.op10_token_counts,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_hard_negatives": hardneg.op12_hard_negatives,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3, "op5_decontamination": OP5, "op9_chat_format": OP9, "op12_hard_negatives": OP12}


#: Words, windows and hits by arrays; windows are compared as text with a separator that no word holds.
OP5 = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), ks AS (SELECT DISTINCT k FROM sized
), spots AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM fold, ks WHERE len(w) >= k)
), hits AS (SELECT s.doc_id, s.k, s.i, v.item_id FROM spots s JOIN win v ON s.k = v.k AND s.g = v.g
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.y = c.y AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP9 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY turn) AS l,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM t GROUP BY conv_id
), u AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n, l, any_value(text) AS text FROM c GROUP BY l
), p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM u))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, text FROM u WHERE l NOT IN (SELECT l FROM p)
"""
