"""SQL for DuckDB that gives the same results as the pipeline's stages, as common table expressions."""

from __future__ import annotations

from rankloom.functions.constants import AGGREGATOR_HOSTS, DOC_HOST, DOC_PATH, ECHO_WORDS, ENGINE_WEIGHTS, HAN_RUN, SPACE_RE2, TRACKING_PARAMS

_OUT = r"[\x00-\x20\x{00a0}\x{3000}\x{feff}]"
_ADDRESS = r"^(?i:https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def trimmed(url: str) -> str:
    return f"regexp_replace(regexp_replace({url}, '^{_OUT}+', ''), '{_OUT}+$', '')"


def part(url: str, n: int) -> str:
    return f"coalesce(regexp_extract({trimmed(url)}, '{_ADDRESS}', {n}), '')"


def valid(url: str) -> str:
    return f"coalesce(regexp_matches({trimmed(url)}, '{_ADDRESS}'), false)"


def host(url: str) -> str:
    return f"lower({part(url, 1)})"


def path(url: str) -> str:
    return f"CASE WHEN {part(url, 1)} = '' THEN '' WHEN {part(url, 2)} = '' THEN '/' ELSE {part(url, 2)} END"


def url_key(url: str) -> str:
    decoded = "regexp_replace(url_decode(replace(p, '+', ' ')), '&', '%26', 'g')"
    pairs = f"list_transform(list_filter(string_split({part(url, 3)}, '&'), lambda p: p <> ''), lambda p: {decoded})"
    named = f"list_transform({pairs}, lambda p: lower(regexp_extract(p, '^([^=]*)', 1)) || '=' || regexp_extract(p, '^[^=]*=?(.*)$', 1))"
    params = f"array_to_string(list_sort(list_filter({named}, lambda p: NOT list_contains([{quoted(TRACKING_PARAMS)}], regexp_extract(p, '^([^=]*)', 1)))), '&')"
    way = f"CASE WHEN length({path(url)}) > 1 THEN regexp_replace({path(url)}, '/$', '') ELSE {path(url)} END"
    return f"CASE WHEN {url} IS NULL THEN NULL WHEN {part(url, 1)} = '' THEN {url} ELSE regexp_replace({host(url)}, '^www\\.', '') || '|' || ({way}) || '|' || {params} END"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{SPACE_RE2}+', ' ', 'g'))"


def clean_query(q: str) -> str:
    return f"regexp_replace({squeezed(q)}, '[.,;:!?。，；：！？、]+$', '')"


def language(q: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({q}, ''), '{HAN_RUN}{{2,}}') THEN 'cn' ELSE 'en' END"


def bigrams(runs: str) -> str:
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) >= 2 THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE []::VARCHAR[] END))"


def distinct(items: str) -> str:
    """Distinct items in order of appearance."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def query_terms(q: str) -> str:
    words = f"list_filter(regexp_extract_all(lower(coalesce({q}, '')), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$'))"
    return f"list_distinct(list_concat({words}, {bigrams(f'''regexp_extract_all(coalesce({q}, ''), '{HAN_RUN}{{2,}}')''')}))"


def coverage(terms: str, text: str) -> str:
    return f"CASE WHEN len({terms}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({terms}, lambda t: contains(lower({text}), lower(t))))::DOUBLE / len({terms}) END"


def tokens(text: str) -> str:
    runs = f"regexp_extract_all({text}, '[一-鿿㐀-䶿]+')"
    return f"list_concat(list_concat(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]+'), lambda w: lower(w)), list_filter({runs}, lambda r: length(r) = 1)), {bigrams(runs)})"


def weight(engine: str) -> str:
    return f"CASE {engine} " + " ".join(f"WHEN '{e}' THEN {w}::DOUBLE" for e, w in ENGINE_WEIGHTS.items()) + " ELSE 0.8::DOUBLE END"


CLEAN_RULES = r"""
rules_clean AS (
  SELECT regexp_replace(lower(trim(rule)), '^\*?\.', '') AS domain,
         CASE WHEN lower(trim(rule)) LIKE '.%' THEN 'tld' WHEN lower(trim(rule)) LIKE '*.%' THEN 'sub' ELSE 'domain' END AS kind, action, min(ord) AS ord
  FROM domain_rules WHERE coalesce(lower(trim(rule)), '') <> '' GROUP BY ALL)
"""

#: The rules that match a host.
MATCHES = "(kind = 'domain' AND (h = domain OR h LIKE '%.' || domain)) OR (kind = 'sub' AND h LIKE '%.' || domain) OR (kind = 'tld' AND suffix(h, domain))"

QUERIES_CLEAN = f"""
queries_clean AS (SELECT query_id, {clean_query('q')} AS q, lang, {language(clean_query('q'))} AS route, gold FROM queries)
"""

#: The pool of a captured row.
POOL = "query_id * 100000000 + coalesce(floor(epoch(coalesce(captured_at, ingested_at)) / 60), 90000000 + (result_id // 64) % 10000000)::BIGINT"

KEPT = f"""
{CLEAN_RULES},
captured AS (
  SELECT *, {POOL} AS pool FROM search_results WHERE query_id IS NOT NULL),
hosted AS (
  SELECT *, {host('url')} AS host FROM captured
  WHERE {valid('url')} AND NOT regexp_matches(url, '(?i){AGGREGATOR_HOSTS}') AND NOT regexp_matches(coalesce(title, ''), '百度图片|视频大全')),
acts AS (
  SELECT h AS host, list(DISTINCT action) AS actions FROM (SELECT DISTINCT host AS h FROM hosted), rules_clean WHERE {MATCHES} GROUP BY h),
kept AS (
  SELECT k.*, regexp_replace(k.host, '^www\\.', '') AS domain, {url_key('k.url')} AS key, coalesce(list_contains(actions, 'lower'), false) AS lower_host,
         list_filter(list_transform(string_split(coalesce(source, ''), '+'), lambda s: trim(s)), lambda s: s <> '') AS sources,
         row_number() OVER (PARTITION BY pool ORDER BY pos, result_id) - 1 AS idx
  FROM hosted k LEFT JOIN acts a ON a.host = k.host WHERE NOT coalesce(list_contains(actions, 'remove'), false)),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY pool, engine ORDER BY idx) AS rank FROM (SELECT *, unnest(sources) AS engine FROM kept))
"""

MERGED = f"""
{KEPT},
key_engines AS (
  SELECT pool, key, list({{'seen': seen, 'engine': engine, 'rank': rank}} ORDER BY seen, engine, rank) AS engines
  FROM (SELECT pool, key, engine, min(rank) AS rank, min(idx) AS seen FROM ranks GROUP BY ALL) GROUP BY pool, key),
key_rows AS (
  SELECT pool, key, arg_min({{'title': title, 'url': url, 'host': host, 'domain': domain, 'lower_host': lower_host}}, idx) AS f,
         first(snippet ORDER BY length(coalesce(snippet, '')) DESC, idx) AS snippet, min(idx) AS first_idx, count(*) AS n_rows
  FROM kept GROUP BY pool, key),
merged AS (
  SELECT pool, key, unnest(f), snippet, first_idx, n_rows, engines FROM key_rows LEFT JOIN key_engines USING (pool, key))
"""

TITLES = f"""
{MERGED},
items AS (
  SELECT pool, key, row_number() OVER (PARTITION BY pool ORDER BY first_idx) AS n, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}]+')) AS words FROM merged),
fold AS (
  SELECT pool, n, key, key AS head, [{{'key': key, 'words': words}}] AS heads FROM items WHERE n = 1
  UNION ALL
  SELECT pool, n, key, coalesce(found, key), CASE WHEN found IS NULL THEN list_append(heads, {{'key': key, 'words': words}}) ELSE heads END
  FROM (SELECT i.pool, i.n, i.key, i.words, f.heads,
               list_filter(f.heads, lambda h: len(h.words) > 0 AND len(i.words) > 0 AND len(list_intersect(h.words, i.words))::DOUBLE / (len(h.words) + len(i.words) - len(list_intersect(h.words, i.words))) > 0.85)[1].key AS found
        FROM fold f JOIN items i ON i.pool = f.pool AND i.n = f.n + 1)),
headed AS (SELECT m.*, head FROM merged m JOIN fold USING (pool, key)),
head_engines AS (
  SELECT pool, head, list({{'seen': seen, 'engine': engine, 'rank': rank}} ORDER BY seen, engine, rank) AS engines
  FROM (SELECT pool, head, e.engine AS engine, min(e.rank) AS rank, min({{'first_idx': first_idx, 'seen': e.seen}}) AS seen FROM (SELECT pool, head, first_idx, unnest(engines) AS e FROM headed) GROUP BY ALL) GROUP BY pool, head),
titled AS (
  SELECT pool, head AS key, unnest(f), snippet, first_idx, n_rows, engines
  FROM (SELECT pool, head, arg_min({{'title': title, 'url': url, 'host': host, 'domain': domain, 'lower_host': lower_host}}, first_idx) AS f,
               first(snippet ORDER BY length(coalesce(snippet, '')) DESC, first_idx) AS snippet, min(first_idx) AS first_idx, sum(n_rows) AS n_rows
        FROM headed GROUP BY pool, head) LEFT JOIN head_engines USING (pool, head))
"""

_TEXT = "coalesce(title, '') || ' ' || coalesce(snippet, '')"
_STEMS = r"list_filter(list_transform(regexp_extract_all(lower(coalesce(q, '')), '[a-z][a-z0-9.+#\-]{2,}'), lambda w: regexp_replace(w, '[.+#\-]', '', 'g')), lambda w: length(w) >= 3)"

SIGNALS = f"""
{TITLES},
{QUERIES_CLEAN},
covered AS (
  SELECT t.*, q.query_id, q.q, q.lang, q.gold, {query_terms('q.q')} AS terms, {coverage(query_terms('q.q'), _TEXT)} AS coverage
  FROM titled t JOIN queries_clean q ON q.query_id = floor(t.pool / 100000000)::BIGINT),
domain_acts AS (
  SELECT h AS domain_, list(DISTINCT action) AS acts FROM (SELECT DISTINCT domain AS h FROM titled), rules_clean WHERE {MATCHES} GROUP BY h),
signalled AS (
  SELECT c.*,
         CASE WHEN coalesce(list_contains(acts, 'mirror'), false) THEN 0.0
              WHEN coalesce(list_contains(acts, 'authority'), false) THEN CASE WHEN regexp_matches(domain, '^www\\.') AND NOT regexp_matches(domain, '{DOC_HOST}') THEN 0.9 ELSE 1.0 END
              WHEN len(list_filter({_STEMS}, lambda w: contains(regexp_replace(domain, '[.\\-]', '', 'g'), w))) > 0 THEN 0.6
              WHEN regexp_matches(url, '{DOC_PATH}') AND len(list_filter(string_split({path('url')}, '/'), lambda s: s <> '')) >= 2 THEN 0.4 ELSE 0.0 END::DOUBLE AS authority,
         coalesce(list_contains(acts, 'tutorial'), false)::INT AS tutorial, coalesce(list_contains(acts, 'mirror'), false)::INT AS mirror,
         ({host('url')} <> '' AND regexp_matches({path('url')}, '^/*$') AND coverage <= 0.20)::INT AS homepage,
         count(*) OVER (PARTITION BY pool, domain) AS host_n,
         coalesce(list_sum(list_transform(engines, lambda e: 1.0::DOUBLE / (20 + e.rank))), 0.0) AS rrf_raw,
         CASE WHEN coalesce(title, '') <> '' AND {coverage('terms', "coalesce(title, '') || ' '")} >= 0.8 AND regexp_matches(title, '(?i){ECHO_WORDS}') THEN 1 ELSE 0 END AS echo
  FROM covered c LEFT JOIN domain_acts ON domain_ = domain),
scored AS (
  SELECT *, rrf_raw / greatest(max(rrf_raw) OVER (PARTITION BY pool), 1e-9) AS rrf FROM signalled),
finals AS (
  SELECT *, rrf - 0.15 * lower_host::INT - 0.40 * echo + 0.18 * authority - 0.08 * tutorial - 0.18 * mirror - 0.10 * homepage AS final_score FROM scored),
floored AS (
  SELECT *, max(coverage) OVER (PARTITION BY pool) AS best, sum((coverage >= 0.12 OR authority >= 0.9)::INT) OVER (PARTITION BY pool) AS left_ FROM finals
  QUALIFY best < 0.40 OR coverage >= 0.12 OR authority >= 0.9 OR left_ = 0),
ranking AS (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY final_score DESC, first_idx) AS rank FROM floored)
"""
