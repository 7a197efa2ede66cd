"""SQL for DuckDB of the queries that it can express over whole tables."""

from __future__ import annotations

from millrace.llm.line_dedup import OP5_SQL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK_WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE low < doc_id), (SELECT unnest(range(50)) AS j)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d WHERE len(w) > 0),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS low FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((
    (instr('0123456789abcdef', substr(x, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(x, (5 * i // 4 + 2)::INT, 1)) - 1
  ) >> (3 - (5 * i) % 4)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM p JOIN f USING (h)
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_BLANK_WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN sizes USING (doc_id) JOIN low ON low.doc_id = d.doc_id
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_ALNUM_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_folded('text')}, '{_ALNUM_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
),
hits AS (SELECT dw.doc_id, dw.i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items FROM hits GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN hit USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op8_near_duplicates": OP8_SQL, "op9_decontaminate": OP9_SQL}
