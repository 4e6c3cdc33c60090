"""DuckDB SQL of operators whose modules do not hold it."""

from __future__ import annotations

#: Windows of 100 bytes as hexadecimal text; all but the first of each are late, and runs of them leave the document.
OP2_SQL = """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS nb FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(nb - 99, 0))) AS i FROM n)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM late),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, run),
parts AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS e FROM sp UNION ALL SELECT n.doc_id, coalesce(max(b), 0), nb FROM n LEFT JOIN sp USING (doc_id) GROUP BY n.doc_id, nb),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS kh FROM parts p JOIN n USING (doc_id) GROUP BY p.doc_id),
r AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT n.doc_id, CAST(nb AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kh, ''))) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
