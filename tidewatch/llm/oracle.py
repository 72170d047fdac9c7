"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: Lines by key; the largest document keeps a line that enough documents share.
SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, line, place, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.place, r.key IS NOT NULL AND k.doc_id <> r.keep AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Leaves, levels, siblings and folds as rows; the CRC of an id is worked out bit by bit.
SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE documents_ AS (
  SELECT doc_id, lang, row_number() OVER () AS r,
    concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AS tampered
  FROM documents
), hashed AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claimed
  FROM documents_
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n
), subroots AS (
  SELECT tree, digest AS subroot, level AS height FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, tree AS place, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, place // 2, n
), steps AS (
  SELECT l.r, n.level, n.place < (l.place >> n.level) AS on_left, n.digest FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.place = xor(l.place >> n.level, 1)
  UNION ALL
  SELECT l.r, s.height + t.level, t.place < (l.tree >> t.level), t.digest
  FROM leaves l JOIN subroots s USING (tree) JOIN top t ON t.place = xor(l.tree >> t.level, 1)
), walks AS (
  SELECT l.r, s.height + (SELECT max(level) FROM top) AS height, coalesce(l.claimed, l.leaf) AS start FROM leaves l JOIN subroots s USING (tree)
), folds AS (
  SELECT r, 0 AS level, height, start AS digest FROM walks
  UNION ALL
  SELECT f.r, f.level + 1, f.height, sha256(CASE WHEN s.r IS NULL THEN f.digest WHEN s.on_left THEN s.digest || f.digest ELSE f.digest || s.digest END)
  FROM folds f LEFT JOIN steps s ON s.r = f.r AND s.level = f.level WHERE f.level < f.height
), proofs AS (
  SELECT r, string_agg(digest, '' ORDER BY level) AS siblings FROM steps GROUP BY r
), result AS (
  SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root
  FROM leaves l JOIN subroots s USING (tree) JOIN top t ON t.n = 1 JOIN folds f ON f.r = l.r AND f.level = f.height LEFT JOIN proofs p ON p.r = l.r
)
SELECT *, folded_root = root AS verified FROM result
"""
