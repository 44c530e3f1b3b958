"""SQL of the numbered problems' queries where SQL can express them."""

from __future__ import annotations

_SHINGLES = """
WITH p AS (SELECT page_id, any_value(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS w FROM pages WHERE text IS NOT NULL GROUP BY page_id),
s AS (SELECT DISTINCT page_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 30)),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id),
o AS (SELECT a.page_id AS pa, b.page_id AS pb, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.page_id < b.page_id GROUP BY 1, 2)
"""


_LINES = """
WITH p AS (SELECT page_id, any_value(document_id) AS document_id, any_value(text) AS text FROM pages WHERE text IS NOT NULL GROUP BY page_id),
x AS (SELECT page_id, document_id, string_split(text, chr(10)) AS a FROM p),
l AS (SELECT page_id, document_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM x),
n AS (SELECT page_id, line_no, document_id, source, regexp_replace(lower(regexp_replace(trim(line, ' '), ' +', ' ', 'g')), '[0-9]+', '0', 'g') AS norm
      FROM l JOIN documents ON doc_id = document_id WHERE source IS NOT NULL AND length(regexp_replace(line, '\\P{L}', '', 'g')) >= 20),
r AS (SELECT source, norm FROM n GROUP BY 1, 2 HAVING count(DISTINCT document_id) >= 6),
f AS (SELECT page_id, line_no FROM n JOIN r USING (source, norm))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _LINES + "SELECT page_id, line_no::INTEGER AS line_no FROM f",
        "p2_clean_pages": _LINES
        + """, k AS (SELECT l.page_id, string_agg(line, chr(10) ORDER BY l.line_no) AS text FROM l ANTI JOIN f ON l.page_id = f.page_id AND l.line_no = f.line_no GROUP BY 1)
        SELECT q.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM (SELECT DISTINCT page_id FROM pages) q LEFT JOIN p ON p.page_id = q.page_id LEFT JOIN k ON k.page_id = q.page_id""",
        "p7_round_trip": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, true AS equal FROM documents",
        "p5_found": _SHINGLES + "SELECT pa AS page_id_a, pb AS page_id_b FROM o JOIN n a ON a.page_id = pa JOIN n b ON b.page_id = pb WHERE o >= 0.6 * (a.n + b.n - o) - 1e-9",
    }
