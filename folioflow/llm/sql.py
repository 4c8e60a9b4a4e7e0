"""SQL that says the same as some of the queries; the others are tested against brute force."""

from __future__ import annotations

_SAMPLE = """
SELECT src, key, strftime(batch, '%Y-%m-%d') AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY src, batch ORDER BY sha256('sample:' || key), key) AS place, count(*) OVER (PARTITION BY src, batch) AS n
  FROM (
    SELECT src, key, min(day) AS batch, any_value(open_day) AS open_day
    FROM (SELECT *, max(day) OVER (PARTITION BY src) AS open_day FROM (
      SELECT 'manifest' AS src, regexp_replace(lower(id), '[^0-9a-z]+', '', 'g') AS key, CAST(received_at AS DATE) AS day FROM manifest
      UNION ALL
      SELECT 'documents', regexp_replace(lower(document_id), '[^0-9a-z]+', '', 'g'), CAST(created_at AS DATE) FROM documents
    ) WHERE key <> '' AND day IS NOT NULL)
    GROUP BY src, key
  )
) WHERE batch < open_day AND place <= ceil(n * 0.05)
"""

_WIDE = "translate({0}, 'ＳｓＰｐ０１２３４５６７８９', 'SsPp0123456789')"
#: Reachability over shared entities; groups are small enough on these tables for all pairs of a group.
_GROUPS = f"""
WITH RECURSIVE d AS (SELECT doc_id, dataset_split, regexp_replace(regexp_replace(lower(document_id), '[^0-9a-z]+', '', 'g'), 'p[0-9]{{1,4}}$', '') AS volume,
  nullif(regexp_extract(regexp_replace(upper({_WIDE.format('author')}), '[^0-9A-Z가-힣]+', '', 'g'), '(?:^|[^A-Z])S([0-9]{{8}})(?:[^0-9]|$)', 1), '') AS staff FROM documents),
e AS (SELECT doc_id, 'v' || volume AS entity FROM d WHERE volume <> '' UNION SELECT doc_id, 's' || staff FROM d WHERE staff IS NOT NULL),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT b.doc_id, r.root FROM r JOIN e a ON a.doc_id = r.doc_id JOIN e b ON b.entity = a.entity),
g AS (SELECT doc_id, min(root) AS group_id FROM r GROUP BY 1)
"""
_BROKEN = _GROUPS + "SELECT doc_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g JOIN d USING (doc_id) GROUP BY 1 HAVING count(DISTINCT dataset_split) > 1)"
_VOLUME = "nullif(regexp_replace(regexp_replace(lower({0}), '[^0-9a-z]+', '', 'g'), 'p[0-9]{{1,4}}$', ''), '')"
_SPLITS = f"""{_GROUPS},
n AS (SELECT group_id, coalesce(min(nullif(volume, '')), 'doc:' || min(doc_id)) AS key FROM g JOIN d USING (doc_id) GROUP BY 1),
w AS (SELECT DISTINCT volume, key FROM g JOIN d USING (doc_id) JOIN n USING (group_id) WHERE volume <> ''),
m AS (SELECT row_id, {_VOLUME.format('id')} AS volume FROM manifest),
a AS (SELECT 'documents' AS src, doc_id AS row_id, key AS group_key FROM g JOIN n USING (group_id) UNION ALL SELECT 'manifest', row_id, coalesce(key, m.volume, 'row:' || row_id) FROM m LEFT JOIN w ON w.volume = m.volume),
p AS (SELECT *, ('0x' || substr(sha256('split:' || group_key), 1, 13))::UBIGINT / pow(16, 13) AS place FROM a)
SELECT src, row_id, group_key, CASE WHEN place < 0.8::DOUBLE THEN 'train' WHEN place < 0.9::DOUBLE THEN 'dev' ELSE 'final' END AS dataset_split FROM p
"""
ORACLES: dict[str, str] = {"p1_found": _BROKEN, "p1_splits": _SPLITS, "p7_sample": _SAMPLE}
