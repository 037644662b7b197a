"""The text queries that DuckDB's SQL can say in full, on the same tables."""

from __future__ import annotations

from .link_trust import LINK_HOST, LINKS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: op12: rules, seeds, links between hosts, and twenty rounds of both walks.
URL_FILTER = f"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS row FROM rest
), ruled AS (
  SELECT u.row, any_value(u.page_id) AS page_id, any_value(u.host) AS host, any_value(u.path) AS path,
    arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS said
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.row
), seeds AS (
  SELECT host, CASE WHEN count_if(said = 'allow') > 0.5 * count(*) THEN 0.15::DOUBLE ELSE 0 END AS trust,
    CASE WHEN count_if(said = 'block') > 0.5 * count(*) THEN 0.15::DOUBLE ELSE 0 END AS distrust FROM ruled GROUP BY host
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{LINKS.replace("'", "''")}', 1)) AS link FROM urls
), bare AS (
  SELECT src, regexp_replace(link, '^["'' \\t\\r\\n\\f]+', '') AS link FROM links
), ends AS (
  SELECT src, translate(regexp_replace(regexp_extract(link, '{LINK_HOST}', 1), '["'' \\t\\r\\n\\f]+$', ''), '{UPPER}', '{LOWER}') AS dst FROM bare
), edges AS (
  SELECT src, dst, count(*)::DOUBLE AS n FROM ends WHERE dst <> '' AND src <> '' AND src <> dst GROUP BY ALL
), shares AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS ahead, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges
), walk(round, host, trust, distrust) AS (
  SELECT 0, host, trust, distrust FROM seeds
  UNION ALL
  SELECT round + 1, host, sum(trust), sum(distrust) FROM (
    SELECT r.round, s.host, s.trust, s.distrust FROM seeds s, (SELECT DISTINCT round FROM walk) r
    UNION ALL SELECT w.round, e.dst, 0.85 * w.trust * e.ahead, 0 FROM walk w JOIN shares e ON e.src = w.host
    UNION ALL SELECT w.round, e.src, 0, 0.85 * w.distrust * e.back FROM walk w JOIN shares e ON e.dst = w.host
  ) WHERE round < 20 GROUP BY round, host
), bad AS (SELECT host FROM walk WHERE round = 20 AND distrust >= 0.01 AND distrust > trust)
SELECT r.page_id, r.host, r.path, r.rule,
  coalesce(r.said, CASE WHEN r.host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r
"""

_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: op13: every document against every item by the formula of the score.
RANKED_SEARCH = f"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents
), docs AS (SELECT row, doc_id, len(terms)::BIGINT AS n, terms FROM words WHERE len(terms) > 0
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs
), held AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL
), df AS (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term
), weights AS (
  SELECT term, floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals t
), asked AS (
  SELECT item_id, row, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, row_number() OVER () AS row, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT a.row AS item, a.item_id, h.row, h.doc_id,
    sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * h.n * t.docs) // t.terms))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term), totals t GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 20
"""

#: op3: shingle sets, all pairs that share a shingle, and what can be reached by links.
JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT row, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    ELSE [array_to_string(words, ' ')] END) AS shingle FROM words WHERE len(words) > 0
), sizes AS (SELECT row, count(*) AS n FROM sets GROUP BY row
), links AS (
  SELECT a.row AS a, b.row AS b FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.row <> b.row JOIN sizes x ON x.row = a.row JOIN sizes y ON y.row = b.row
  GROUP BY a.row, b.row, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reached(row, other) AS (
  SELECT row, row FROM words UNION SELECT r.row, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT w.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (row) JOIN reached r USING (row) JOIN words o ON o.row = r.other GROUP BY w.row, w.doc_id
"""
