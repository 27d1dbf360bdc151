"""DuckDB counterpart of the URL filter: its own rules, suffixes and formulas, stated as the contract does."""

from __future__ import annotations

URLS = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), numbered AS (
  SELECT *, CASE WHEN regexp_matches(path, '/[0-9]{1,18}(\.html|/)?$')
                 THEN regexp_extract(path, '/([0-9]{1,18})(\.html|/)?$', 1)::BIGINT END AS item
  FROM parsed
), outcomes AS (
  SELECT doc_id AS item, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1
), hosts AS (
  SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS name,
         count(bad)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM numbered LEFT JOIN outcomes USING (item) GROUP BY 1
), named AS (
  SELECT *, CASE WHEN regexp_full_match(name, '[0-9.]*') THEN name
                 WHEN regexp_matches(name, '(^|\.)(ac\.uk|co\.in|co\.jp|co\.kr|co\.nz|co\.uk|co\.za|com\.ar|com\.au|com\.br|com\.cn|com\.mx|com\.tr|gov\.uk|net\.au|org\.au|org\.uk)$')
                 THEN regexp_extract(name, '([^.]*\.)?[^.]*\.[^.]*$')
                 ELSE regexp_extract(name, '([^.]*\.)?[^.]*$') END AS domain
  FROM hosts
), domains AS (
  SELECT domain, CASE WHEN regexp_full_match(domain, '[0-9.]*') OR NOT contains(domain, '.') THEN domain
                      ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix,
         sum(n) AS n, sum(bad) AS bad
  FROM named GROUP BY domain
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 0.5::DOUBLE) / (sum(sum(n)) OVER () + 1) AS mean
  FROM domains GROUP BY suffix
), s1 AS (
  SELECT 1 / CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0
    THEN greatest(0.001, least(0.9, sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean))))
    ELSE 0.1 END - 1 AS s FROM suffixes
), d AS (
  SELECT domains.*, (t.bad + s * t.mean) / (t.n + s) AS mean FROM domains JOIN suffixes t USING (suffix), s1
), s2 AS (
  SELECT 1 / CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0
    THEN greatest(0.001, least(0.9, sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean))))
    ELSE 0.1 END - 1 AS s FROM d
), h AS (
  SELECT named.*, (d.bad + s * d.mean) / (d.n + s) AS mean FROM named JOIN d USING (domain), s2
), s3 AS (
  SELECT 1 / CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0
    THEN greatest(0.001, least(0.9, sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean))))
    ELSE 0.1 END - 1 AS s FROM h
), rated AS (
  SELECT host, n, bad, ln(a / b) - 1.645::DOUBLE * sqrt(1 / a + 1 / b) AS odds
  FROM (SELECT host, n, bad, bad + s * mean AS a, n - bad + s * (1 - mean) AS b FROM h, s3)
), rules(verdict, rule, host, path) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), keyed AS (
  SELECT row_number() OVER () AS rw, * FROM numbered
), fitting AS (
  SELECT rw, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM keyed k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
  GROUP BY rw
)
SELECT page_id, k.host, k.path, f.rule,
       coalesce(f.verdict, CASE WHEN n > 0 AND odds > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labelled, bad AS n_bad
FROM keyed k LEFT JOIN fitting f USING (rw) JOIN rated USING (host)
"""
