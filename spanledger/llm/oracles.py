"""DuckDB SQL for the queries that SQL can express beside those with an oracle of their own."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


NEAR_COPIES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || '|' ELSE array_to_string(w[i:i+3], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
    JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)
), r(id, root) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) c ON c.id = d.doc_id"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (SELECT *, sha1(t) AS x FROM p
), b AS (SELECT *, list_transform(range(4), lambda c: ('0x' || substr(x, 10 * c + 1, 10))::BIGINT) AS v FROM h)
SELECT page_id, strlen(t) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM b"""

_WORDS = rf"regexp_extract_all({_low('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), c AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS g
    FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), t AS (
    SELECT doc_id, i, m, array_to_string(w[i:i+m-1], ' ') AS g
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM c) WHERE len(w) >= m)
), h AS (SELECT doc_id, i, t.m, item_id FROM t JOIN c ON c.g = t.g AND c.m = t.m
), k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1
), f AS (
    SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)"""
