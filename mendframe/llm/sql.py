"""SQL twins of the queries, for DuckDB over the same tables."""

from mendframe.llm.mixing import TARGETS
from mendframe.llm.url_filter import HOST_RULES, PATTERN_RULES

_WORD = r"'[^ \t\n\x0b\f\r]+'"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS digest FROM p
), last AS (
  SELECT digest, max(page_id) AS last_id FROM d WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM d LEFT JOIN last ON d.digest = last.digest AND d.n >= 1000
"""

_PATTERN = " OR ".join(f"regexp_matches(low, '{r.regex}')" for r in PATTERN_RULES)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
URLS = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES}),
u AS (
  SELECT page_id, translate(coalesce(url, ''), {_FOLD}) AS low,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_FOLD}) AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT u.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rverdict WHEN {_PATTERN} THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN fit USING (page_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda c: c * c))) AS size
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a AS vec_id, min(b) AS lowest FROM reach GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id,
  vec_id <= coalesce(lowest, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""

NEAR_TEXTS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_WORD}) AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS grams FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), rare AS (
  SELECT gram, count(*) AS f FROM g GROUP BY gram HAVING count(*) > 1
), o AS (
  SELECT doc_id, n, gram, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), gram) AS r
  FROM g LEFT JOIN rare USING (gram)
), cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM o a JOIN o b ON a.gram = b.gram AND a.doc_id < b.doc_id
  WHERE a.r <= a.n - (80 * a.n + 99) // 100 + 1 AND b.r <= b.n - (80 * b.n + 99) // 100 + 1
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), links AS (
  SELECT a, b FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.grams, y.grams)) >= 80 * (len(x.grams) + len(y.grams) - len(list_intersect(x.grams, y.grams)))
), twoway AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM twoway UNION SELECT reach.a, twoway.b FROM reach JOIN twoway ON reach.b = twoway.a
), low AS (
  SELECT a AS doc_id, min(b) AS lowest FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(doc_id, coalesce(lowest, doc_id)) AS component_id,
  doc_id <= coalesce(lowest, doc_id) AS kept
FROM s LEFT JOIN low USING (doc_id)
"""

_FINITE = "len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0"

TOPK = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 20
"""

HARD = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND {_FINITE}
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), h AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s USING (anchor_id)
  WHERE p.n <= 5 AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INT) AS rank, negative_id, positive_score, negative_score FROM h WHERE n <= 5
"""

_LEVELS = ("domain", "lang", "source")


def _share(depth: int) -> str:
    """The CTE b<depth> with the budgets of the nodes at this depth."""
    level = _LEVELS[depth - 1]
    keys = ", ".join(_LEVELS[:depth])
    up = ", ".join(_LEVELS[: depth - 1]) or "1"
    link = " AND ".join(f"n.{k} = p.{k}" for k in _LEVELS[: depth - 1]) or "true"
    own = ", ".join(f"n.{k}" for k in _LEVELS[:depth])
    by = f"PARTITION BY {', '.join(f'n.{k}' for k in _LEVELS[: depth - 1]) or '1'} ORDER BY CAST(n.cap AS DOUBLE) / n.w, n.{level}"
    return f"""
n{depth} AS (
  SELECT {keys}, sum(cap) AS cap, coalesce(max(t.weight), 1) AS w
  FROM leaves LEFT JOIN targets t ON t.level = '{level}' AND t.name = {level} GROUP BY ALL
), f{depth} AS (
  SELECT {own}, n.cap, n.w,
    p.budget - coalesce(sum(n.cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(n.w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
  FROM n{depth} n JOIN b{depth - 1} p ON {link}
), o{depth} AS (
  SELECT *, max(CASE WHEN rest * w >= cap * among THEN 0 ELSE 1 END)
    OVER (PARTITION BY {up} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM f{depth}
), b{depth} AS (
  SELECT {keys}, CASE WHEN open = 0 THEN cap
    ELSE least(cap, w * max(rest) OVER (PARTITION BY {up}, open) // max(among) OVER (PARTITION BY {up}, open)) END AS budget FROM o{depth}
)"""


_TARGETS = ", ".join(f"('{level}', '{name}', {weight})" for level, name, weight in TARGETS)

MIX = f"""
WITH targets(level, name, weight) AS (VALUES {_TARGETS}),
rows AS (
  SELECT doc_id, md5(coalesce(text, '')) AS mark, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
    regexp_replace(coalesce(source, ''), '[0-9]+$', '') || '-' ||
      CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INT), 0) % 2 AS VARCHAR) AS domain,
    len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS n_tokens
  FROM documents
), d AS (SELECT * FROM rows WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, 4 * sum(n_tokens) AS cap FROM d GROUP BY ALL),
b0 AS (SELECT least(sum(tokens), sum(cap)) AS budget FROM leaves),
{",".join(_share(i) for i in (1, 2, 3))},
plan AS (
  SELECT domain, lang, source, budget // tokens AS full_epochs, budget % tokens AS rest FROM leaves JOIN b3 USING (domain, lang, source)
), placed AS (SELECT * FROM d JOIN plan USING (domain, lang, source)),
upto AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('20/' || CAST(full_epochs + 1 AS VARCHAR) || '/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || mark), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed WHERE rest > 0
)
SELECT doc_id, domain, lang, source, CAST(unnest(range(1, CAST(full_epochs AS BIGINT) + 1)) AS INT) AS epoch, n_tokens, n_tokens AS n_taken FROM placed
UNION ALL
SELECT doc_id, domain, lang, source, CAST(full_epochs + 1 AS INT) AS epoch, n_tokens,
  CAST(least(n_tokens, rest - (upto - n_tokens)) AS BIGINT) AS n_taken
FROM upto WHERE rest > upto - n_tokens
"""
