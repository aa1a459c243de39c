"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from plyset.llm import queries as q

QUERIES = {
    "op1_quality_rules": q.op1,
    "op2_decontaminate": q.op2,
    "op3_minhash_near_dedup": q.op3,
    "op4_secret_scan": q.op4,
    "op5_warc_dictionary": q.op5,
    "op6_language_id": q.op6,
    "op7_bloom_lm": q.op7,
    "op8_line_chunk_dedup": q.op8,
    "op9_int8_embedding_dedup": q.op9,
    "op10_best_fit_packing": q.op10,
    "op11_html_extraction": q.op11,
    "op12_source_divergence": q.op12,
}

OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.doc_id AND reach.r < links.y)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.r AS component_id, sets.doc_id = c.r AS kept
FROM sets JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.vec_id AND reach.r < links.y)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.r AS component_id, v.vec_id = c.r AS kept
FROM v JOIN (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id) c USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) k USING (vec_id)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
w AS (SELECT lang, source, i, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source FROM d GROUP BY lang, source),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n) AS n FROM dense GROUP BY lang, source),
ltot AS (SELECT lang, sum(n) AS n FROM tot GROUP BY lang),
lterm AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
p AS (SELECT dense.lang, dense.source, dense.term, dense.n, 1 + (1000000000::HUGEINT * (dense.n + 5)) // (tot.n + 5 * dense.v) AS p FROM dense JOIN tot USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lterm.n + 5)) // (ltot.n + 5 * v.v) AS q FROM lterm JOIN ltot USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM terms) WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_warc_dictionary": OP5_SQL,
    "op9_int8_embedding_dedup": OP9_SQL,
    "op12_source_divergence": OP12_SQL,
}
