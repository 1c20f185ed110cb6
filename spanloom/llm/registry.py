"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, filteraudit, fingerprint, langid, linededup, lmscore, neardup, packing, pieces, substring, toxicity, vectorcodes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_nearest": ann.op9_nearest,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_lm_scores": lmscore.op13_lm_scores,
}

#: Words that a window of 35 covers go if its sequence of words starts at two places or more.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM p),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM g SEMI JOIN r USING (h)) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(gone, k)), lambda k: ws[k]), ' ') END) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""

#: Of equal payloads of 1000 bytes or more the page with the largest id holds the response.
WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

#: Every two different word sets that share a word of their prefixes are compared; classes are named by their first line.
LINES_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM t),
l AS (SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) AS ws, row_number() OVER (ORDER BY doc_id, i) AS seq FROM x),
c AS (SELECT ws, len(ws) AS n, min(seq) AS k, min(doc_id) AS first FROM l WHERE len(ws) > 0 GROUP BY ws),
u AS (SELECT k, n, unnest(ws) AS w FROM c),
o AS (SELECT k, n, w, row_number() OVER (PARTITION BY k ORDER BY df, w) AS pos FROM u JOIN (SELECT w, count(*) AS df FROM u GROUP BY w) USING (w)),
p AS (SELECT k, n, w FROM o WHERE pos <= n - (4 * n + 4) // 5 + 1),
j AS (SELECT DISTINCT x.k AS a, y.k AS b FROM p x JOIN p y ON x.w = y.w AND x.k < y.k AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
m AS (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.ws, y.ws)) AS common FROM j JOIN c x ON x.k = a JOIN c y ON y.k = b),
e AS (SELECT a, b FROM m WHERE 5 * common >= 4 * (n - common)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT k, k AS z FROM c UNION SELECT r.k, s.b FROM r JOIN s ON s.a = r.z),
g AS (SELECT r.k, min(c.first) AS class_id FROM r JOIN c ON c.k = r.z GROUP BY r.k),
q AS (SELECT a AS k, count(*) AS n_links, min(b) AS low FROM s GROUP BY a),
v AS (SELECT l.doc_id, l.line, l.seq > c.k OR coalesce(low < c.k, false) AS removed, coalesce(n_links, 0) AS n_links, class_id
  FROM l JOIN c USING (ws) JOIN g USING (k) LEFT JOIN q USING (k)),
b AS (SELECT doc_id, count(*) AS n_lines, count_if(removed) AS n_removed, string_agg(line, ',' ORDER BY line) FILTER (removed) AS removed_lines, sum(n_links) AS n_links, min(class_id) AS class_id FROM v GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed_lines, '') AS removed_lines,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(class_id, doc_id) AS class_id
FROM documents LEFT JOIN b USING (doc_id)
"""

#: Every two different texts that share a shingle are compared as multisets; classes are chains of links.
NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT coalesce(text, '') AS t, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
s AS (SELECT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i+4], ' '))) WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS g FROM w),
c AS (SELECT id, g, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS common FROM c x JOIN c y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE common / (x.n + y.n - common) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS m FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m)
SELECT doc_id, class_id FROM documents x JOIN d ON d.t = coalesce(x.text, '') JOIN (SELECT id, min(m) AS class_id FROM r GROUP BY id) USING (id)
"""

#: Documents by their failing filters, once for each order; a filter that fails at the first place removes.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
u AS (SELECT t, min(doc_id) AS first FROM t GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, concat(CASE WHEN len(ws) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails
  FROM t JOIN u USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, bad, fails, count(*) AS n FROM f GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS o FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT g.*, o, CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(range(1, length(fails) + 1), lambda i: strpos(o, fails[i]))) END AS hit FROM g CROSS JOIN o),
r AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS x, coalesce(sum(n) FILTER (hit > step), 0) AS kept, coalesce(sum(n) FILTER (hit = step), 0) AS removed,
  coalesce(sum(n) FILTER (contains(fails, o[step]) AND hit < step), 0) AS redundant, coalesce(sum(n) FILTER (fails = o[step]), 0) AS unique_fails,
  coalesce(sum(n) FILTER (hit = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit = step AND bad), 0) AS toxic_lost
  FROM s, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""



def _codes_sql(rounds: int) -> str:
    """Every part against all entries of its codebook, round after round."""
    near = "n{k} AS MATERIALIZED (SELECT r, part, v, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT r, p.part, p.v, c.e, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS d FROM p JOIN c{k} c USING (part)) GROUP BY ALL)"
    mean = """c{m} AS MATERIALIZED (SELECT part, e, coalesce(x.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, e, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM
 (SELECT part, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, e, v, unnest(range(1, len(v) + 1)) AS i FROM n{k}) GROUP BY ALL) GROUP BY ALL) x USING (part, e))"""
    steps = [s for k in range(rounds) for s in (near.format(k=k), mean.format(k=k, m=k + 1))] + [near.format(k=rounds)]
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM k, (SELECT unnest(range(8)) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM p WHERE r <= 16),
{", ".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY part, e, i)) FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM c{rounds})) AS codebooks_sha256
FROM k JOIN o USING (r)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": WARC_SQL,
    "op5_line_dedup": LINES_SQL,
    "op8_near_duplicates": NEAR_SQL,
    "op10_substring_dedup": SUBSTRING_SQL,
    "op11_filter_audit": AUDIT_SQL,
    "op12_vector_codes": _codes_sql(vectorcodes.ROUNDS),
}
