"""DuckDB counterpart of the Jaccard join: all pairs of sets that share a shingle, and the closure of the links."""

from __future__ import annotations

JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS rw, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT rw, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s
  FROM worded
), classes AS MATERIALIZED (
  SELECT s, len(s) AS n, min(doc_id) AS class_id, row_number() OVER (ORDER BY min(doc_id)) AS c FROM sets WHERE len(s) > 0 GROUP BY s
), items AS MATERIALIZED (
  SELECT c, n, unnest(s) AS shingle FROM classes
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(c, v) AS (
  SELECT c, c FROM classes UNION SELECT r.c, e.b FROM reached r JOIN edges e ON r.v = e.a
), lowest AS (
  SELECT r.c, min(k.class_id) AS component_id FROM reached r JOIN classes k ON r.v = k.c GROUP BY r.c
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND sets.s = classes.s LEFT JOIN lowest USING (c)
"""
