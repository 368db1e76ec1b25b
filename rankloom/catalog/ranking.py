"""Queries of the ranking pipeline: cleaning, addresses, filters, merges, signals, scores, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import urls as U
from rankloom.functions.constants import DOC_PATH, WEIXIN_QUERY
from rankloom.operators import pool as P
from rankloom.operators import rank as R
from rankloom.plans import pools as L
from rankloom.plans import sql as S
from rankloom.plans.skew import salted_join

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {S.QUERIES_CLEAN} SELECT query_id, q, route, regexp_matches(q, '{WEIXIN_QUERY}') AS weixin FROM queries_clean")
def clean_and_route(spark: SparkSession, d: str) -> DataFrame:
    return L.queries_clean(spark, d).select("query_id", "q", "route", F.col("q").rlike(WEIXIN_QUERY).alias("weixin"))


@query(f"WITH {S.QUERIES_CLEAN} SELECT query_id, array_to_string({S.query_terms('q')}, ' ') AS terms, len({S.query_terms('q')}) AS n FROM queries_clean")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    # DuckDB's list_distinct has no order: both sides sort
    q = L.queries_clean(spark, d).withColumn("t", F.array_sort(T.query_terms(F.col("q"))))
    return q.select("query_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("bigint").alias("n"))


SQL["query_terms"] = f"WITH {S.QUERIES_CLEAN} SELECT query_id, array_to_string(list_sort({S.query_terms('q')}), ' ') AS terms, len({S.query_terms('q')}) AS n FROM queries_clean"


@query(f"""
SELECT result_id, {S.valid('url')} AS valid, {S.host('url')} AS host, {S.path('url')} AS path, {S.part('url', 3)} AS params,
       {S.host('url')} <> '' AND regexp_matches({S.path('url')}, '^/*$') AS homepage,
       coalesce({S.host('url')} <> '' AND NOT regexp_matches({S.path('url')}, '^/*$') AND len(list_filter(string_split({S.path('url')}, '/'), lambda s: s <> '')) >= 2 AND regexp_matches(url, '{DOC_PATH}'), false) AS doc_page
FROM search_results""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    doc = ~U.is_homepage(u) & (U.path_segments(u) >= 2) & u.rlike(DOC_PATH) & (U.host(u) != "")
    return L.table(spark, d, "search_results").select("result_id", U.is_valid_url(u).alias("valid"), U.host(u).alias("host"), U.path(u).alias("path"), U.query_string(u).alias("params"), U.is_homepage(u).alias("homepage"), F.coalesce(doc, F.lit(False)).alias("doc_page"))


@query(f"SELECT result_id, {S.url_key('url')} AS key FROM search_results")
def url_key(spark: SparkSession, d: str) -> DataFrame:
    return U.with_address(L.table(spark, d, "search_results").select("result_id", "url")).select("result_id", "key")


@query(f"""
SELECT result_id, CASE WHEN u <> '' AND regexp_matches(t, '^https?://') THEN t ELSE raw_url END AS target
FROM (SELECT *, CASE WHEN u = '' THEN '' ELSE coalesce(decode(try(from_base64(rpad(b, (((length(b) + 3) // 4) * 4)::INT, '=')))), '') END AS t
      FROM (SELECT *, translate(regexp_replace(u, '^a1', ''), '-_', '+/') AS b FROM (SELECT result_id, raw_url, regexp_extract({S.part('raw_url', 3)}, '(?:^|&)u=([^&]*)', 1) AS u FROM search_results)))""")
def redirect_decode(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "search_results").select("result_id", U.decode_bing_redirect(F.col("raw_url")).alias("target"))


@query(f"""
WITH {S.CLEAN_RULES}, hosts AS (SELECT DISTINCT {S.host('url')} AS h FROM search_results)
SELECT h AS host, array_to_string(list_sort(list(DISTINCT action)), ',') AS actions FROM hosts, rules_clean WHERE h <> '' AND ({S.MATCHES}) GROUP BY h""")
def host_actions(spark: SparkSession, d: str) -> DataFrame:
    hosts = L.table(spark, d, "search_results").select(U.host(F.col("url")).alias("host"))
    return P.match_rules(hosts, L.table(spark, d, "domain_rules")).select("host", F.array_join(F.array_sort("actions"), ",").alias("actions"))


@query(f"WITH {S.KEPT} SELECT result_id, pool, idx, domain, lower_host AS lower FROM kept")
def kept_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.kept_rows(spark, d).select("result_id", "pool", "idx", "domain", "lower")


@query(f"WITH {S.KEPT} SELECT result_id, engine, rank FROM ranks")
def engine_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.with_engine_ranks(L.kept_rows(spark, d)).select("result_id", "engine", "rank")


_ENGINES = "array_to_string(list_transform(coalesce(engines, []), lambda e: e.engine || ':' || e.rank), '+') AS engines"
_engines = F.array_join  # the same on the other side


def _engine_list():  # noqa: ANN202
    return F.array_join(F.transform("engines", lambda e: F.concat(e["engine"], F.lit(":"), e["rank"])), "+").alias("engines")


@query(f"WITH {S.MERGED} SELECT pool, key, title, url, snippet, first_idx, n_rows, lower_host AS lower, {_ENGINES} FROM merged")
def url_merge(spark: SparkSession, d: str) -> DataFrame:
    return P.merged_by_key(L.kept_rows(spark, d)).select("pool", "key", "title", "url", "snippet", "first_idx", "n_rows", "lower", _engine_list())


@query(f"WITH RECURSIVE {S.TITLES} SELECT pool, key, title, snippet, first_idx, n_rows::BIGINT AS n_rows, {_ENGINES} FROM titled")
def title_merge(spark: SparkSession, d: str) -> DataFrame:
    return L.merged_rows(spark, d).select("pool", "key", "title", "snippet", "first_idx", "n_rows", _engine_list())


@query(f"""
WITH {S.QUERIES_CLEAN}, c AS (SELECT r.*, q.q, {S.query_terms('q.q')} AS terms FROM search_results r JOIN queries_clean q USING (query_id))
SELECT result_id, {S.coverage('terms', "coalesce(title, '') || ' ' || coalesce(snippet, '')")} AS coverage FROM c""")
def term_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = salted_join(L.table(spark, d, "search_results").select("result_id", "query_id", "title", "snippet"), L.queries_clean(spark, d).select("query_id", "q"), ["query_id"], by="result_id")
    return R.with_coverage(rows).select("result_id", "coverage")


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""
WITH w AS (SELECT result_id, {S.POOL} AS pool, {_WORDS.format('title')} AS w FROM search_results WHERE query_id IS NOT NULL)
SELECT a.result_id AS a, b.result_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity
FROM w a JOIN w b ON a.pool = b.pool AND a.result_id < b.result_id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.85""")
def title_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one pool with titles that are alike (a pool is one capture: tens of rows).

    Two word sets that are more than SAME_TITLE alike share a word among the first few of each in any common
    order, so only rows that share one of those are compared, not all pairs of a pool.
    """
    w = L.captured(spark, d).select("result_id", "pool", T.word_set(F.col("title")).alias("w")).where(F.size("w") > 0)
    order = F.transform(F.array_sort(F.transform("w", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s["h"])
    first = F.size("w") - F.ceil(F.size("w") * P.SAME_TITLE).cast("int") + 1
    each = w.withColumn("h", F.explode(F.slice(order, F.lit(1), first)))
    a, b = (each.select("pool", "h", F.col("result_id").alias(n), F.col("w").alias(f"w{n}")) for n in "ab")
    j = a.join(b, ["pool", "h"]).where("a < b").dropDuplicates(["a", "b"]).withColumn("s", T.jaccard(F.col("wa"), F.col("wb"))).where(F.col("s") > P.SAME_TITLE)
    return j.select("a", "b", F.round("s", 6).alias("similarity"))


def _rrf(weighted: bool, k: int):  # noqa: ANN202
    w = S.weight("e.engine") if weighted else "1.0::DOUBLE"
    return f"""
WITH RECURSIVE {S.TITLES}, r AS (SELECT pool, key, coalesce(list_sum(list_transform(engines, lambda e: ({w}) / ({k} + e.rank))), 0.0) AS rrf_raw FROM titled)
SELECT pool, key, round(rrf_raw, 9) AS rrf_raw, round(rrf_raw / greatest(max(rrf_raw) OVER (PARTITION BY pool), 1e-9), 9) AS rrf FROM r"""


@query(_rrf(False, 20))
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.with_rrf(L.merged_rows(spark, d)).select("pool", "key", F.round("rrf_raw", 9).alias("rrf_raw"), F.round("rrf", 9).alias("rrf"))


@query(_rrf(True, 60))
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return R.with_rrf(L.merged_rows(spark, d), 60.0, weighted=True).select("pool", "key", F.round("rrf_raw", 9).alias("rrf_raw"), F.round("rrf", 9).alias("rrf"))


@query(f"""
WITH RECURSIVE {S.SIGNALS}
SELECT pool, key, round(coverage, 9) AS coverage, authority, tutorial, mirror, homepage, echo, host_n FROM signalled""")
def host_signals(spark: SparkSession, d: str) -> DataFrame:
    return L.signals(spark, d).select("pool", "key", F.round("coverage", 9).alias("coverage"), "authority", "tutorial", "mirror", "homepage", "echo", "host_n")


@query(f"WITH RECURSIVE {S.SIGNALS} SELECT pool, key, title, url, rank, round(final_score, 6) AS score, round(coverage, 6) AS coverage FROM ranking")
def final_ranking(spark: SparkSession, d: str) -> DataFrame:
    return L.ranking(spark, d).select("pool", "key", "title", "url", "rank", F.round("final_score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH RECURSIVE {S.SIGNALS} SELECT pool, string_agg(rank || '. ' || coalesce(title, '') || ' ' || url || ' ' || coalesce(nullif({S.squeezed('snippet')}, ''), '(no snippet)'), chr(10) ORDER BY rank) AS answer FROM ranking WHERE rank <= 5 GROUP BY pool")
def answer_text(spark: SparkSession, d: str) -> DataFrame:
    """The numbered list that a person reads; five rows at most for each pool."""
    top = L.ranking(spark, d).where("rank <= 5")
    line = F.concat(F.col("rank"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit(" "), "url", F.lit(" "), F.coalesce(F.nullif(T.squeeze(F.col("snippet")), F.lit("")), F.lit("(no snippet)")))
    return top.groupBy("pool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))


_FIELDS = f"""
docs AS (
  SELECT t.pool, t.key, {S.tokens("coalesce(q.q, '')")} AS wanted, {S.tokens("coalesce(t.title, '')")} AS title_words, {S.tokens("coalesce(t.snippet, '') || ' ' || t.domain || ' ' || t.url")} AS text_words
  FROM titled t JOIN queries_clean q ON q.query_id = floor(t.pool / 100000000)::BIGINT),
fields AS (SELECT pool, key, wanted, 'title' AS field, 3.0::DOUBLE AS boost, title_words AS words FROM docs UNION ALL SELECT pool, key, wanted, 'text', 1.0, text_words FROM docs),
stats AS (SELECT pool, field, avg(len(words)) AS avg_n, count(*) AS n_docs FROM fields GROUP BY ALL),
hits AS (SELECT * FROM (SELECT pool, key, field, boost, len(words) AS n, word, len(list_filter(words, lambda w: w = word)) AS tf FROM (SELECT *, unnest(list_distinct(wanted)) AS word FROM fields)) WHERE tf > 0),
dfs AS (SELECT pool, field, word, count(*) AS df FROM hits GROUP BY ALL),
bm AS (
  SELECT pool, key, count(DISTINCT word) * sum(boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * n / avg_n)))) AS bm25_raw
  FROM hits JOIN dfs USING (pool, field, word) JOIN stats USING (pool, field) GROUP BY pool, key),
bms AS (SELECT pool, key, bm25_raw, bm25_raw / max(bm25_raw) OVER (PARTITION BY pool) AS bm25 FROM bm)
"""


@query(f"WITH RECURSIVE {S.TITLES}, {S.QUERIES_CLEAN}, {_FIELDS} SELECT pool, key, round(bm25_raw, 6) AS bm25_raw, round(bm25, 6) AS bm25 FROM bms")
def bm25_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = L.with_query(L.merged_rows(spark, d), spark, d)
    return R.with_bm25(rows).where("bm25_raw is not null").select("pool", "key", F.round("bm25_raw", 6).alias("bm25_raw"), F.round("bm25", 6).alias("bm25"))


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_FIELDS}
SELECT s.pool, s.key, round(0.5 * coverage + 0.25 * coalesce(bm25, 0.0) + 0.25 * coalesce(list_max(list_transform(engines, lambda e: {S.weight('e.engine')})), 0.85) / (first_idx + 1) - 0.3 * lower_host::INT, 6) AS score
FROM scored s LEFT JOIN bms b USING (pool, key)""")
def legacy_score(spark: SparkSession, d: str) -> DataFrame:
    return L.signals(spark, d, with_bm25=True).select("pool", "key", F.round(R.legacy_score(), 6).alias("score"))


@query(f"WITH RECURSIVE {S.SIGNALS} SELECT pool, key FROM floored")
def coverage_floor(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage_floor(L.signals(spark, d)).select("pool", "key")


@query(f"WITH {S.KEPT} SELECT engine, count(*) AS rows, count(DISTINCT pool) AS pools, round(avg(rank), 6) AS mean_rank FROM ranks GROUP BY engine")
def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    r = P.with_engine_ranks(L.kept_rows(spark, d))
    return r.groupBy("engine").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pool").alias("pools"), F.round(F.avg("rank"), 6).alias("mean_rank"))


_HEALTH = f"""
engines_of AS (SELECT pool, count(DISTINCT engine) AS contributing FROM (SELECT pool, unnest(list_filter(list_transform(string_split(coalesce(source, ''), '+'), lambda s: trim(s)), lambda s: s <> '')) AS engine FROM captured) GROUP BY pool),
top5 AS (SELECT pool, max(coverage) AS best, count_if(coverage = 0) AS zero, count(*) AS n FROM ranking WHERE rank <= 5 GROUP BY pool),
health AS (
  SELECT e.pool, contributing, coalesce(best, 0.0) AS best, coalesce(zero, 0) AS zero, coalesce(zero::DOUBLE / n, 1.0) AS zero_share,
         contributing < 2 AS single, coalesce(zero::DOUBLE / n, 1.0) > 0.4 AND coalesce(best, 0.0) < 0.30 AS irrelevant
  FROM engines_of e LEFT JOIN top5 USING (pool))
"""


def _health(spark: SparkSession, d: str) -> DataFrame:
    raw = L.captured(spark, d).select("pool", F.explode(T.split_sources(F.col("source"))).alias("engine"))
    engines = raw.groupBy("pool").agg(F.countDistinct("engine").alias("contributing"))
    top = L.ranking(spark, d).where("rank <= 5").groupBy("pool").agg(F.max("coverage").alias("best"), F.count_if(F.col("coverage") == 0).alias("zero"), F.count(F.lit(1)).alias("n"))
    h = engines.join(top, "pool", "left").withColumn("zero_share", F.coalesce(F.col("zero") / F.col("n"), F.lit(1.0))).withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("zero", F.coalesce("zero", F.lit(0)))
    return h.withColumn("single", F.col("contributing") < 2).withColumn("irrelevant", (F.col("zero_share") > 0.4) & (F.col("best") < 0.30))


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_HEALTH}
SELECT pool, contributing, round(best, 6) AS best, zero, NOT (single OR irrelevant) AS ok,
       array_to_string(list_filter([CASE WHEN single THEN 'single-engine' END, CASE WHEN irrelevant THEN 'irrelevant-heavy' END], lambda x: x IS NOT NULL), ',') AS reasons FROM health""")
def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    h = _health(spark, d)
    reasons = F.array_join(F.array(F.when(F.col("single"), "single-engine"), F.when(F.col("irrelevant"), "irrelevant-heavy")), ",")
    return h.select("pool", "contributing", F.round("best", 6).alias("best"), F.col("zero").cast("bigint").alias("zero"), (~(F.col("single") | F.col("irrelevant"))).alias("ok"), reasons.alias("reasons"))


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_HEALTH}
SELECT pool, CASE WHEN single OR irrelevant THEN 'memory' WHEN best < 0.12 THEN 'none' ELSE 'memory+disk' END AS target,
       CASE WHEN single OR irrelevant THEN 90 WHEN best < 0.12 THEN 0 ELSE 21600 END AS ttl_seconds FROM health""")
def cache_policy(spark: SparkSession, d: str) -> DataFrame:
    h, bad = _health(spark, d), F.col("single") | F.col("irrelevant")
    low = F.col("best") < 0.12
    return h.select("pool", F.when(bad, "memory").when(low, "none").otherwise("memory+disk").alias("target"), F.when(bad, 90).when(low, 0).otherwise(21600).alias("ttl_seconds"))


#: Engines behind search interfaces; their rows only come in by the gates.
API = ["tavily", "bocha", "zhipu"]
RESCUE_FLOOR, QUALITY_FLOOR = 12, 3


def rescue_floor(value: str | None) -> int:
    """The floor that a setting names: a whole number of 1 or more, else RESCUE_FLOOR."""
    return int(value) if value and value.strip().isdigit() and int(value) >= 1 else RESCUE_FLOOR


def _api(source):  # noqa: ANN001, ANN202
    return F.exists(T.split_sources(source), lambda s: s.isin(API))


_API_SQL = "len(list_intersect(list_transform(string_split(coalesce(source, ''), '+'), lambda s: trim(s)), ['tavily', 'bocha', 'zhipu'])) > 0"
_CAPTURED = f"captured AS (SELECT *, {S.POOL} AS pool FROM search_results WHERE query_id IS NOT NULL)"


@query(f"""
WITH {_CAPTURED}, {S.QUERIES_CLEAN}, t AS (SELECT c.*, route, {_API_SQL} AS api FROM captured c JOIN queries_clean q USING (query_id)),
n AS (SELECT *, count_if(NOT api) OVER (PARTITION BY pool) AS production FROM t WHERE route = 'cn')
SELECT result_id, pool, api FROM n WHERE NOT api OR production < 12""")
def rescue_gate(spark: SparkSession, d: str, floor: str | None = None) -> DataFrame:
    """Chinese pools: rows of search interfaces are appended only where the other engines gave fewer rows than the floor (a setting, else RESCUE_FLOOR)."""
    t = salted_join(L.captured(spark, d).select("result_id", "query_id", "pool", "source"), L.queries_clean(spark, d).select("query_id", "route"), ["query_id"], by="result_id").where("route = 'cn'").withColumn("api", _api(F.col("source")))
    n = t.withColumn("production", F.count_if(~F.col("api")).over(Window.partitionBy("pool")))
    return n.where(~F.col("api") | (F.col("production") < rescue_floor(floor))).select("result_id", "pool", "api")


#: Order in which English pools fall back.
TIERS = [("main", ["intlBing", "ddgs"]), ("api", API), ("cnBing", ["cnBing"]), ("so360", ["so360"]), ("baiduMobile", ["baiduMobile"])]


@query(f"""
WITH {_CAPTURED}, {S.QUERIES_CLEAN}, e AS (SELECT c.result_id, c.pool, trim(string_split(coalesce(source, ''), '+')[1]) AS engine FROM captured c JOIN queries_clean q USING (query_id) WHERE route = 'en'),
t AS (SELECT *, CASE WHEN engine IN ('intlBing', 'ddgs') THEN 0 WHEN engine IN ('tavily', 'bocha', 'zhipu') THEN 1 WHEN engine = 'cnBing' THEN 2 WHEN engine = 'so360' THEN 3 WHEN engine = 'baiduMobile' THEN 4 END AS tier FROM e),
n AS (SELECT pool, tier, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pool ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT result_id, pool, tier FROM t JOIN b USING (pool, tier) WHERE before < 3""")
def tiered_fallback(spark: SparkSession, d: str) -> DataFrame:
    """English pools: a tier's rows come in while all tiers before gave fewer than QUALITY_FLOOR rows."""
    e = salted_join(L.captured(spark, d).select("result_id", "query_id", "pool", "source"), L.queries_clean(spark, d).select("query_id", "route"), ["query_id"], by="result_id").where("route = 'en'")
    first = F.trim(F.get(F.split(F.coalesce("source", F.lit("")), r"\+"), F.lit(0)))
    tier = F.lit(None).cast("int")
    for k, (_, engines) in enumerate(TIERS):
        tier = F.when(first.isin(engines), k).otherwise(tier)
    t = e.select("result_id", "pool", tier.alias("tier")).where("tier is not null")
    n = t.groupBy("pool", "tier").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pool").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(n.withColumn("before", before).where(F.col("before") < QUALITY_FLOOR).select("pool", "tier"), ["pool", "tier"]).select("result_id", "pool", "tier")


@query(f"""
WITH {_CAPTURED}, {S.QUERIES_CLEAN}, t AS (SELECT c.result_id, c.pool, trim(string_split(coalesce(source, ''), '+')[1]) IN ('so360', 'intlBing', 'ddgs') AS spare FROM captured c JOIN queries_clean q USING (query_id) WHERE route = 'cn')
SELECT result_id, pool FROM t WHERE spare AND pool NOT IN (SELECT pool FROM t WHERE NOT spare)""")
def empty_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Chinese pools that no main engine answered: rows of the spare engines."""
    t = salted_join(L.captured(spark, d).select("result_id", "query_id", "pool", "source"), L.queries_clean(spark, d).select("query_id", "route"), ["query_id"], by="result_id").where("route = 'cn'")
    spare = F.trim(F.get(F.split(F.coalesce("source", F.lit("")), r"\+"), F.lit(0))).isin("so360", "intlBing", "ddgs")
    t = t.select("result_id", "pool", spare.alias("spare"))
    return t.where("spare").join(t.where("not spare").select("pool").distinct(), "pool", "left_anti").select("result_id", "pool")


@query(f"""
WITH {_CAPTURED}, h AS (SELECT *, {S.host('url')} AS host, {_API_SQL} AS api FROM captured WHERE {S.valid('url')})
SELECT pool, host, count(*) AS rows FROM h WHERE api AND NOT EXISTS (SELECT 1 FROM h p WHERE p.pool = h.pool AND p.host = h.host AND NOT p.api) GROUP BY pool, host""")
def new_domains(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that only search interfaces brought into a pool."""
    h = U.with_address(L.captured(spark, d).select("pool", "url", _api(F.col("source")).alias("api"))).where("host <> ''")
    n = h.groupBy("pool", "host").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("api").alias("only"))
    return n.where("only").select("pool", "host", "rows")


@query("SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM search_results WHERE query_id IS NOT NULL)")
def missing_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries without any captured row, which a further capture would ask."""
    seen = L.table(spark, d, "search_results").where("query_id is not null").select("query_id").distinct()
    return L.table(spark, d, "queries").select("query_id").join(seen, "query_id", "left_anti")


_DOC = f"len(list_filter(string_split({S.path('url')}, '/'), lambda s: s <> '')) >= 2 AND regexp_matches(url, '{DOC_PATH}')"


@query(f"""
WITH {_CAPTURED}, o AS (SELECT *, official_dom || '' AS dom, {S.host('url')} AS host, {S.url_key('url')} AS key, ({_DOC}) AS doc FROM captured WHERE {S.valid('url')} AND official_dom IS NOT NULL),
s AS (SELECT pool, key, min(pos) AS pos, min(result_id) AS result_id, bool_or(doc) AS doc FROM o WHERE host = lower(dom) OR host LIKE '%.' || lower(dom) GROUP BY ALL),
n AS (SELECT *, bool_or(doc) OVER (PARTITION BY pool) AS any_doc, row_number() OVER (PARTITION BY pool ORDER BY doc DESC, pos, result_id) AS rank FROM s)
SELECT pool, key, doc, rank, NOT any_doc AS second_phase FROM n""")
def official_docs(spark: SparkSession, d: str) -> DataFrame:
    """Rows on a pool's official host, documentation pages first (stable); ``second_phase``: no such page, so the hint query would be asked."""
    raw = L.captured(spark, d).where("official_dom is not null").select("pool", "pos", "result_id", "url", F.lower("official_dom").alias("dom"))
    o = U.with_address(raw).where((F.col("host") == F.col("dom")) | F.endswith("host", F.concat(F.lit("."), F.col("dom"))))
    doc = (F.size(F.filter(F.split("path", "/"), lambda s: s != "")) >= 2) & F.col("url").rlike(DOC_PATH)
    s = o.withColumn("doc", doc).groupBy("pool", "key").agg(F.min("pos").alias("pos"), F.min("result_id").alias("result_id"), F.bool_or("doc").alias("doc"))
    w = Window.partitionBy("pool")
    n = s.withColumn("any_doc", F.bool_or("doc").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("doc").desc(), "pos", "result_id")))
    return n.select("pool", "key", "doc", "rank", (~F.col("any_doc")).alias("second_phase"))


@query(f"""
WITH {S.KEPT}, {S.QUERIES_CLEAN}, e AS (SELECT r.pool, r.engine, {S.coverage(S.query_terms('q.q'), "coalesce(title, '') || ' ' || coalesce(snippet, '')")} AS coverage FROM ranks r JOIN queries_clean q USING (query_id))
SELECT engine, round(avg(coverage), 6) AS quality, count(*) AS rows FROM e GROUP BY engine""")
def engine_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage of each engine's rows."""
    rows = L.with_query(L.kept_rows(spark, d), spark, d)
    each = R.with_coverage(rows).select(F.explode("sources").alias("engine"), "coverage")
    return each.groupBy("engine").agg(F.round(F.avg("coverage"), 6).alias("quality"), F.count(F.lit(1)).alias("rows"))
