"""DuckDB counterpart of the spelling groups: words with one place taken out, compared place by place."""

from __future__ import annotations

from arbolex.llm.sql_merkle import CRC_TABLE, crc32

#: a letter of Latin-1 beyond ASCII has the octets 195 and its code less 64
_OCTETS = """list_concat(list_transform(string_split(doc || ':', ''), lambda x: ascii(x)::BIGINT),
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)))"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), pairs AS (
  SELECT doc, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT *, {crc32(_OCTETS)} AS h FROM pairs, crc
), typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), gaps AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
         CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked USING (word)
), chain(word, root) AS (
  SELECT word, word FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM formed f JOIN chain c ON f.form = c.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
