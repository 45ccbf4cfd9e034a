"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wiretally.llm.conversation_repair import op11_conversation_repair
from wiretally.llm.decontaminate import op6_decontamination
from wiretally.llm.fingerprints import op3_fingerprints
from wiretally.llm.hard_negatives import op13_hard_negatives
from wiretally.llm.hmm import op2_lm_scoring
from wiretally.llm.jaccard_join import op12_jaccard_join
from wiretally.llm.near_dedup import op9_near_dedup
from wiretally.llm.packing import op10_packing
from wiretally.llm.quality import op8_quality
from wiretally.llm.secret_scan import op5_secret_scans
from wiretally.llm.token_counts import op1_token_counts
from wiretally.llm.url_filter import op7_url_filters
from wiretally.llm.warc import op4_warc

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
d AS (SELECT payload_digest, max(page_id) AS of_page FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN of_page IS NULL OR of_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN of_page <> page_id THEN of_page END AS refers_to
FROM p LEFT JOIN d USING (payload_digest)
"""

_LINKED_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id{more}
FROM w JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

NEAR_SQL = _LINKED_SQL.replace("{width}", "4").replace("{more}", ", w.doc_id = component_id AS kept")
JOIN_SQL = _LINKED_SQL.replace("{width}", "5").replace("{more}", "")

REPAIR_SQL = r"""
WITH RECURSIVE s AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
bits AS (
  SELECT *, flatten(list_transform(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))),
    lambda b: list_transform(range(8), lambda k: CAST((b >> k) & 1 AS BIGINT)))) AS bits FROM s),
h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], bits),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS h
  FROM bits),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM h WHERE h <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM d),
f AS (
  SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS c,
         CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM o),
r AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 3 ELSE 0 END AS t FROM f),
n AS (SELECT conv_id, max(i) AS n FROM r GROUP BY 1),
cost AS (     -- of what follows, before turn i: nothing yet, behind s, u, a
  SELECT conv_id, n + 1 AS i, 0 AS b0, 6 AS b1, 3 AS b2, 0 AS b3 FROM n
  UNION ALL
  SELECT conv_id, i, least(p0, 3 + p2, 6 + p3), least(p1, 3 + p2, 6 + p3), least(p2, 3 + p3), least(p3, 3 + p2)
  FROM (
    SELECT r.conv_id, r.i,
      least(4 + b0, CASE WHEN gone THEN 4 + b0 WHEN c = 's' THEN least(t + b1, t + 3 + b2) WHEN c = 'u' THEN t + b2 ELSE t + 3 + b2 END) AS p0,
      least(4 + b1, CASE WHEN gone THEN 4 + b1 WHEN c = 'u' THEN t + b2 ELSE t + 3 + b2 END) AS p1,
      least(4 + b2, CASE WHEN gone THEN 4 + b2 WHEN c = 'a' THEN t + b3 ELSE t + 3 + b3 END) AS p2,
      least(4 + b3, CASE WHEN gone THEN 4 + b3 WHEN c = 'u' THEN t + b2 ELSE t + 3 + b2 END) AS p3
    FROM cost JOIN r ON r.conv_id IS NOT DISTINCT FROM cost.conv_id AND r.i = cost.i - 1)),
v AS (SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM cost),
trace AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM n
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END,
    CASE WHEN e = 'D' THEN q WHEN e = 'K' AND c = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
           ELSE list_append(lines, CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT x.*, r.role, r.text, r.c,
      CASE WHEN r.i IS NOT NULL AND here.b[q] = 4 + behind.b[q] THEN 'D'
           WHEN here.b[q] = 3 + here.b[CASE q WHEN 3 THEN 4 ELSE 3 END] THEN 'I'
           WHEN c = 's' AND q = 1 AND here.b[q] = t + behind.b[2] THEN 'K'
           WHEN c = CASE q WHEN 3 THEN 'a' ELSE 'u' END AND here.b[q] = t + behind.b[CASE q WHEN 3 THEN 4 ELSE 3 END] THEN 'K'
           ELSE 'R' END AS e
    FROM trace x JOIN v here ON here.conv_id IS NOT DISTINCT FROM x.conv_id AND here.i = x.i
    LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i
    LEFT JOIN v behind ON behind.conv_id IS NOT DISTINCT FROM x.conv_id AND behind.i = x.i + 1
    WHERE r.i IS NOT NULL OR here.b[q] > 0)),
last AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM trace GROUP BY 1),
pairs AS (SELECT conv_id, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM r),
bad AS (SELECT conv_id, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
         count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated FROM r GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1
LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id
"""

HARD_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_lm_scoring, op3_fingerprints, op4_warc, op5_secret_scans,
                                    op6_decontamination, op7_url_filters, op8_quality, op9_near_dedup, op10_packing,
                                    op11_conversation_repair, op12_jaccard_join, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op9_near_dedup": NEAR_SQL, "op11_conversation_repair": REPAIR_SQL, "op12_jaccard_join": JOIN_SQL, "op13_hard_negatives": HARD_SQL}
