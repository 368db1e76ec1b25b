"""SQL equivalents, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from rankloom.functions.constants import TRACKING_PARAMS

_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_GONE = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)

_KEYED = rf"""
u AS (
  SELECT result_id, query_id, title,
         regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^{_SPACE}+', ''), '{_SPACE}+$', '')), '#.*$', ''), '^https?://(www\.)?', '') AS u,
         coalesce(regexp_matches(regexp_replace(regexp_replace(url, '^[\x00-\x20\x{{00a0}}\x{{3000}}\x{{feff}}]+', ''), '[\x00-\x20\x{{00a0}}\x{{3000}}\x{{feff}}]+$', ''), '^(?i:https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'), false) AS ok
  FROM search_results),
k AS (
  SELECT result_id, query_id,
         regexp_replace(regexp_extract(u, '^([^?]*)', 1), '/$', '') || '?' || array_to_string(list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> ''),
           lambda p: lower(regexp_extract(p, '^([^=]*)', 1)) || '=' || regexp_extract(p, '^[^=]*=?(.*)$', 1)), lambda p: NOT list_contains([{_GONE}], regexp_extract(p, '^([^=]*)', 1)))), '&') AS url_key,
         lower(regexp_replace(title, '[\p{{Cf}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{fe00}}-\x{{fe0f}}\x{{034f}}\x{{115f}}\x{{1160}}\x{{3164}}]', '', 'g')) AS t
  FROM u WHERE ok AND query_id IS NOT NULL),
t AS (
  SELECT *, regexp_replace(t, '{_SPACE}', '', 'g') AS bare,
         array_to_string(list_sort(list_transform(regexp_split_to_array(t, '{_SPACE}+[|｜·•\-‐‑‒–—―]+{_SPACE}+'), lambda p: regexp_replace(p, '[\p{{P}}|`~^｜]|{_SPACE}', '', 'g'))), '') AS joined
  FROM k),
keyed AS (
  SELECT result_id, query_id, url_key, CASE WHEN joined = '' THEN bare ELSE joined END AS title_key
  FROM t WHERE coalesce(bare, '') <> '')
"""

ORACLES = {
    "p2_found": f"""
WITH {_KEYED}
SELECT first_id, result_id AS copy_id
FROM (SELECT *, min(result_id) OVER (PARTITION BY query_id, url_key, title_key) AS first_id FROM keyed)
WHERE result_id <> first_id
""",
    "p2_collapsed": f"""
WITH {_KEYED}
SELECT min(result_id) AS first_id, query_id, count(*) AS copies FROM keyed GROUP BY query_id, url_key, title_key
UNION ALL
SELECT result_id, query_id, 1 FROM search_results WHERE result_id NOT IN (SELECT result_id FROM keyed)
""",
}
