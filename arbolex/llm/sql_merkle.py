"""DuckDB counterpart of the Merkle manifest, with one common table per level of the trees."""

from __future__ import annotations

#: levels that the text spells out: 8 ** LEVELS documents a language
LEVELS = 7


def _hash(columns: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in columns) + ")"


def _rise(name: str, base: str, key: str, value: str, place: str) -> str:
    """CTEs ``name0`` ...: nodes (k, i, h, n) of each level; a tree of one node stays as it is."""
    text = f"{name}0 AS (SELECT {key} AS k, {place} AS i, {value} AS h, count(*) OVER (PARTITION BY {key}) AS n FROM {base})"
    for level in range(1, LEVELS + 1):
        text += f""", {name}{level} AS (
  SELECT k, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,
         any_value(CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END) AS n, list(h ORDER BY i) AS run, any_value(n) AS below
  FROM {name}{level - 1} GROUP BY k, CASE WHEN n > 1 THEN i // 8 ELSE i END
)"""
    return text


def _fold(name: str, start: str, nodes: str) -> str:
    """CTEs ``name0`` ...: rows of ``start`` (rw, k, i, cur, proof) led through the levels of ``nodes``."""
    text = f"{name}0 AS (SELECT * FROM {start})"
    for level in range(1, LEVELS + 1):
        text += f""", {name}{level} AS (
  SELECT rw, k, CASE WHEN below > 1 THEN f.i // 8 ELSE f.i END AS i,
         CASE WHEN below > 1 THEN sha256(array_to_string(run[1:f.i % 8], '') || cur || array_to_string(run[f.i % 8 + 2:], '')) ELSE cur END AS cur,
         CASE WHEN below > 1 THEN proof || array_to_string(run[1:f.i % 8], '') || array_to_string(run[f.i % 8 + 2:], '') ELSE proof END AS proof
  FROM {name}{level - 1} f JOIN {nodes}{level} t USING (k)
  WHERE t.i = CASE WHEN below > 1 THEN f.i // 8 ELSE f.i END
)"""
    return text


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: the reversed CRC-32 with the polynomial 0xEDB88320, a bit at a time
CRC_TABLE = """crc(tab) AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))
)"""


def crc32(octets: str) -> str:
    """Unsigned CRC-32 of a list of byte values."""
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::BIGINT))"


MANIFEST = f"""
WITH {CRC_TABLE}, leaves AS (
  SELECT row_number() OVER () AS rw, doc_id, lang,
         {_hash(['doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', 'text'])} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 3 = 0
              THEN {_hash(['doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', _LOWERED])} END AS other
  FROM documents, crc
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS k,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rw) - 1 AS i
  FROM leaves
), {_rise('a', 'placed', 'k', 'leaf', 'i')},
subroots AS (SELECT k, h FROM a{LEVELS}),
{_rise('b', 'subroots', '0', 'h', 'k - 1')},
root AS (SELECT h AS root FROM b{LEVELS}),
start AS (SELECT rw, k, i, coalesce(other, leaf) AS cur, '' AS proof FROM placed),
{_fold('f', 'start', 'a')},
middle AS (SELECT rw, 0 AS k, k - 1 AS i, cur, proof FROM f{LEVELS}),
{_fold('g', 'middle', 'b')}
SELECT p.doc_id, p.leaf, s.h AS subroot, root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = root AS verified
FROM placed p JOIN subroots s USING (k) JOIN g{LEVELS} g USING (rw), root
"""
