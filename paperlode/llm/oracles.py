"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: Every phrase of up to five words of every piece, counted; each cut of each frequent one scored with 128-bit products.
COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents) AS x
), placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0
), totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang
), often AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, s, count(*) AS a
  FROM (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS s FROM placed) AS x WHERE i + s - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), found AS (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE s > 1
), around AS (
  SELECT lang, inner_phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1 : s - 1], ' '), array_to_string(w[2 : s], ' ')]) AS inner_phrase FROM found WHERE s > 2) AS x GROUP BY ALL
), cuts AS (
  SELECT f.lang, f.phrase, f.a, t.n, k, l.a AS l, r.a AS r, CAST(1000 AS HUGEINT) * f.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM found) AS f JOIN totals AS t USING (lang)
  JOIN often AS l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1 : k], ' ')
  JOIN often AS r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1 : f.s], ' ')
  LEFT JOIN around AS o ON o.lang = f.lang AND o.inner_phrase = f.phrase
  WHERE o.longer IS NULL OR o.longer < f.a
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""

_CANONICAL = "concat({})".format(", ".join("CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END".format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
#: CRC-32 bit by bit over the digits.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for _ in range(8)]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: Levels by recursion, then each leaf's way up by another; a tree is a lang, or the one above all langs.
MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_CANONICAL}) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND ({_CRC}) % 7 = 0 THEN sha256({_CANONICAL.replace('n_chars', '(n_chars + 1)')}) END AS changed FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM leaves
), up AS (
  SELECT t, 0 AS lev, idx, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM placed
  UNION ALL
  SELECT t, lev + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY t, lev, idx // 2
), subroots AS (SELECT t, h FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lev, t AS idx, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lev + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lev, idx // 2
), levels AS (SELECT t, max(lev) AS depth FROM up GROUP BY t
), every AS (SELECT t, lev, idx, h, n FROM up UNION ALL SELECT -1, lev, idx, h, n FROM top
), way AS (
  SELECT p.t AS leaf_t, p.idx AS leaf_idx, p.t, 0 AS lev, p.idx, coalesce(p.changed, p.leaf) AS h, '' AS proof FROM placed AS p
  UNION ALL
  SELECT w.leaf_t, w.leaf_idx, CASE WHEN w.t >= 0 AND e.n = 1 THEN -1 ELSE w.t END, CASE WHEN e.n = 1 THEN 0 ELSE w.lev + 1 END, CASE WHEN e.n = 1 THEN w.t ELSE w.idx // 2 END,
    CASE WHEN e.n = 1 THEN w.h WHEN s.h IS NULL THEN sha256(w.h) WHEN w.idx % 2 = 1 THEN sha256(concat(s.h, w.h)) ELSE sha256(concat(w.h, s.h)) END, concat(w.proof, coalesce(s.h, ''))
  FROM way AS w JOIN every AS e ON e.t = w.t AND e.lev = w.lev AND e.idx = w.idx
  LEFT JOIN every AS s ON s.t = w.t AND s.lev = w.lev AND s.idx = xor(w.idx, 1)
  WHERE NOT (w.t = -1 AND e.n = 1)
), ends AS (SELECT w.* FROM way AS w JOIN top AS e ON w.t = -1 AND e.lev = w.lev AND e.idx = w.idx AND e.n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM placed AS p JOIN ends AS w ON w.leaf_t = p.t AND w.leaf_idx = p.idx JOIN subroots AS s ON s.t = p.t JOIN (SELECT h FROM top WHERE n = 1) AS r ON true
"""

ORACLE_SQL = {"op11_phrase_collocations": COLLOCATIONS, "op12_merkle_manifest": MERKLE}
