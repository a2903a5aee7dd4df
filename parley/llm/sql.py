"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontam(terms: int, slop: int) -> str:
    return rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[k:k + 12] AS x FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(x) AS n FROM win),
occ AS (SELECT doc_id, k, n, w[k:k + n - 1] AS x FROM d, lens, unnest(range(1, len(w) - n + 2)) t(k)),
hit AS (SELECT doc_id, k, n, item_id FROM occ JOIN win USING (x)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id),
tok AS (SELECT doc_id, p, w[p] AS t FROM d, unnest(range(1, len(w) + 1)) x(p)),
cnt AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
rare AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n, t) AS k, count(*) OVER (PARTITION BY item_id) AS m FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM b) JOIN cnt USING (t)),
led AS (SELECT item_id, doc_id, p FROM rare JOIN tok USING (t) WHERE k = 1 AND m >= {terms}),
met AS (SELECT l.item_id, l.doc_id, l.p FROM led l JOIN rare r ON r.item_id = l.item_id AND r.k BETWEEN 2 AND {terms} JOIN tok o ON o.doc_id = l.doc_id AND o.t = r.t AND abs(o.p - l.p) <= {slop} GROUP BY ALL HAVING count(DISTINCT r.k) = {terms} - 1),
nr AS (SELECT doc_id, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS near_items FROM met GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)"""


def url_filter(entries: tuple, days: int) -> str:
    rows = ", ".join(f"('{k}', '{p}', '{c}', '{a}', {d})" for k, p, c, a, d in entries)
    return rf"""WITH l(kind, pattern, category, act, day) AS (VALUES {rows}),
e AS (SELECT kind, pattern, category, day, bool_or(act = 'remove') AS gone FROM l GROUP BY ALL),
iv AS (SELECT * EXCLUDE (gone), lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day) AS until, gone FROM e),
p AS (SELECT page_id, page_id * 7 % {days} AS day, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '') AS host,
 array_to_string(list_filter(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> ''), '/') AS path FROM pages),
m AS (SELECT page_id, kind, pattern, category FROM p JOIN iv ON NOT gone AND iv.day <= p.day AND (until IS NULL OR p.day < until)
 AND ((kind = 'host' AND pattern = host) OR (kind = 'domain' AND contains(pattern, '.') AND (host = pattern OR ends_with(host, '.' || pattern))) OR (kind = 'prefix' AND starts_with(host || '/' || path || '/', pattern || '/')))),
g AS (SELECT page_id, count(*) AS n, string_agg(kind || ':' || pattern || ':' || category, ',' ORDER BY kind, pattern, category) AS s FROM (SELECT DISTINCT * FROM m) GROUP BY page_id)
SELECT p.page_id, host, strftime(DATE '2024-01-01' + p.day::INT, '%Y-%m-%d') AS fetched_on, coalesce(n, 0) AS n_matches, coalesce(s, '') AS matches, coalesce(n, 0) > 0 AS blocked FROM p LEFT JOIN g USING (page_id)"""


EMBEDDING = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda q: q::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id, vec_id AS x FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.x)
SELECT vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = vec_id), 0) AS n_links, min(x) AS component_id, min(x) = vec_id AS kept FROM r GROUP BY vec_id"""

MINHASH = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[k:k + 4] AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.x)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(x) AS component_id, min(x) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
