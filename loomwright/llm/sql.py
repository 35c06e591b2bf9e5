"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to,
       true AS valid
FROM f
"""

_PLAIN = r"""CASE WHEN strpos({0}, '://') > 0 THEN lower(regexp_extract({0}, '^(.*?)://', 1)) || '://' || translate(regexp_extract(substr({0}, strpos({0}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || CASE WHEN starts_with(regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^#]*)', 1) END"""

ORACLES["op9_urls"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {plain_url} AS node,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) AS links,
         regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS metas
  FROM pages
), tags AS (
  SELECT url, unnest(list_concat(list_transform(links, lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)),
                                 list_transform(metas, lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>;]*)', 1)))) AS t FROM p WHERE url IS NOT NULL
), raw AS (
  SELECT url, regexp_replace(t, '&(amp|#38|#x26);', '&', 'g') AS t, regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path FROM tags WHERE t <> ''
), whole AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*:)', 1) || t WHEN starts_with(t, '/') THEN origin || t
    WHEN starts_with(t, '?') THEN origin || path || t WHEN starts_with(t, '#') THEN url ELSE origin || '/' || regexp_replace(regexp_replace(path, '^/', ''), '[^/]*$', '') || t END AS w FROM raw
), parts2 AS (
  SELECT url, w, regexp_extract(w, '^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$', 1) AS o, regexp_extract(w, '^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$', 2) AS way, regexp_extract(w, '^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$', 3) AS more FROM whole
), dots AS (
  SELECT url, CASE WHEN regexp_matches(way, '(^|/)\.\.?(/|$)') THEN o || list_reduce(string_split(way, '/'), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END)
    || CASE WHEN regexp_matches(way, '/\.\.?$') THEN '/' ELSE '' END || more ELSE w END AS t FROM parts2
), edge AS (
  SELECT DISTINCT a, b FROM (SELECT {plain_url} AS a, {plain_t} AS b FROM dots) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b
), both_ways AS (
  SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (
  SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a
), parts AS (
  SELECT u, substr(u, strpos(u, '://') + 3) AS rest FROM (SELECT DISTINCT y AS u FROM reach)
), judged AS (
  SELECT u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), own AS (
  SELECT u, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block' END AS v FROM judged
), spread AS (
  SELECT r.x AS u FROM reach r JOIN own o ON r.y = o.u GROUP BY r.x
  HAVING bool_or(coalesce(o.v, '') = 'block') AND NOT bool_or(coalesce(o.v, '') = 'allow')
), q AS (
  SELECT page_id, node, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r AS (
  SELECT page_id, node, host, path,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN node IN (SELECT u FROM spread) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""".replace("{plain_url}", _PLAIN.format("url")).replace("{plain_t}", _PLAIN.format("t"))

ORACLES["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op10_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.b FROM reach r JOIN link l ON r.y = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.x = e.vec_id
"""

ORACLES["op5_suffix"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS k, unnest(list_transform(range(0, len(w) - 49), lambda i: hash(w[i + 1:i + 50]))) AS h FROM w WHERE len(w) >= 50
), f AS (
  SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM g
), d AS (
  SELECT *, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM f WHERE first_doc < doc_id
), i AS (
  SELECT *, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM d
)
SELECT doc_id, min(k) AS first_word, max(k) + 50 - min(k) AS n_words, min(first_doc) AS kept_in_doc_id FROM i GROUP BY doc_id, island
"""
