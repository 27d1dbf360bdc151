"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from arbolex.llm.licenses import TEMPLATES, THRESHOLD, bigrams_of, size_bounds

MIX = """
WITH sizes AS (
  SELECT doc_id, source, row_number() OVER () AS rw,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS total
  FROM totals
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT arg_min(level, cap / weight) FROM levels WHERE cap >= level * weight))::DOUBLE AS target
  FROM levels
), lines AS (
  SELECT s.*, t.source_size, t.target, round(t.target)::BIGINT AS words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size, s.rw ROWS UNBOUNDED PRECEDING) - s.size AS spot
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(spot + size, words) - least(spot, words))
        + greatest(0, least(spot + source_size + size, words) - least(spot + source_size, words))
        + greatest(0, least(spot + 2 * source_size + size, words) - least(spot + 2 * source_size, words)))::BIGINT AS taken
FROM lines
"""

TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), shared AS (
  SELECT digest, max(page_id) AS first_id FROM payloads WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NOT DISTINCT FROM page_id THEN NULL ELSE first_id END AS refers_to
FROM payloads p LEFT JOIN shared s ON p.digest = s.digest AND n >= 1000
"""


def _templates() -> str:
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        grams = bigrams_of(text)
        low, high = size_bounds(len(grams))
        rows.append(f"('{name}', {grams!r}, {low}, {high})")
    return ", ".join(rows)


LICENSES = f"""
WITH templates(name, grams, low, high) AS (VALUES {_templates()}),
units AS (
  SELECT row_number() OVER () AS rw, doc_id, list_distinct(list_concat([coalesce(text, '')],
           regexp_split_to_array(coalesce(text, ''), '\n[\x20\t\r]*\n'), string_split(coalesce(text, ''), chr(10)))) AS u
  FROM documents
), split AS (
  SELECT rw, unnest(u) AS unit FROM units
), worded AS (
  SELECT rw, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM split
), grams AS (
  SELECT row_number() OVER () AS unit, rw,
         list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g
  FROM worded WHERE len(w) > 1
), scored AS (
  SELECT unit, rw, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams g JOIN templates t ON len(g.g) BETWEEN t.low AND t.high
), best AS (
  SELECT rw, unit, dice, name FROM scored WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, name) = 1
), found AS (
  SELECT rw, count(*) AS n, max(dice) AS dice, first(name ORDER BY dice DESC, name) AS best,
         array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses
  FROM best GROUP BY rw
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, best, dice, coalesce(licenses, '') AS licenses
FROM units LEFT JOIN found USING (rw)
"""
