"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import ann, bpe, chat, decontamination, html, neardup, quality, sharding, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_shards": sharding.op2_shards,
    "op3_neardup": neardup.op3_neardup,
    "op4_warc": warc.op4_warc,
    "op5_chat": chat.op5_chat,
    "op6_neighbours": ann.op6_neighbours,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html": html.op8_html,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
}

#: Weighted similarity of all pairs that share a shingle, and what can be reached by links.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE ['#' || text] END) AS g FROM words
), counted AS (SELECT doc_id, hash(g) AS g, count(*) AS n FROM shingles GROUP BY ALL),
totals AS (SELECT doc_id, sum(n) AS total FROM counted GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common FROM counted a JOIN counted b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN totals s ON s.doc_id = x JOIN totals t ON t.doc_id = y WHERE 5 * common >= 4 * (s.total + t.total - common)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reached r JOIN ways ON x = r.other)
SELECT doc_id, min(other) AS class_id, doc_id = min(other) AS is_first FROM reached GROUP BY doc_id
"""

#: Base 32 of a digest: its hexadecimal digits as bits, five at a time.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(h, i + 1, 1)) - 3, 4)), '') AS b FROM p
), named AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (substr(b, 5 * i + j + 1, 1) = '1')::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first FROM bits
)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url FROM named
"""

ORACLES = {"op3_neardup": OP3_SQL, "op4_warc": OP4_SQL, "op5_chat": chat.OP5_SQL, "op6_neighbours": ann.OP6_SQL}
