"""Queries of routing: which engines' rows come together for a query, and in what order; lookups around the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.catalog import evaluation as V
from rankloom.catalog.ranking import _API_SQL, _CAPTURED, _DOC, API, TIERS, _api
from rankloom.functions import text as T
from rankloom.functions import urls as U
from rankloom.functions.constants import DOC_PATH, LABEL_STOP, WEIXIN_QUERY
from rankloom.operators import evaluate as E
from rankloom.operators import official as O
from rankloom.operators import pool as P
from rankloom.operators import rank as R
from rankloom.plans import pools as L
from rankloom.plans import sql as S
from rankloom.plans.skew import salted_join
from rankloom.sources import engines as N

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def first_engine() -> Column:
    """The engine that captured a row: the first of a joined source."""
    return F.trim(F.get(F.split(F.coalesce("source", F.lit("")), r"\+"), F.lit(0)))


_FIRST = "trim(string_split(coalesce(source, ''), '+')[1])"
#: Order of the engines of the Chinese main chain; the one for public accounts only answers queries about them.
CN_MAIN = ["baiduMobile", "cnBing", "sogou", "sogouWeixin", "officialDocs"]


def _order(engines: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for k, e in enumerate(engines):
        out = F.when(first_engine() == e, k).otherwise(out)
    return out


def _order_sql(engines: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_FIRST} = '{e}' THEN {k}" for k, e in enumerate(engines)) + " END"


def _routed(spark: SparkSession, d: str, route: str) -> DataFrame:
    """Captured rows of the queries of one route, with ``q``."""
    q = L.queries_clean(spark, d).where(F.col("route") == route).select("query_id", "q")
    return salted_join(L.captured(spark, d).select("result_id", "query_id", "pool", "pos", "source"), q, ["query_id"], by="result_id")


@query(f"""
WITH {_CAPTURED}, {S.QUERIES_CLEAN}, t AS (SELECT c.result_id, c.pool, c.pos, {_order_sql(CN_MAIN)} AS engine_ord, regexp_matches(q, '{WEIXIN_QUERY}') AS weixin FROM captured c JOIN queries_clean q USING (query_id) WHERE route = 'cn')
SELECT result_id, pool, row_number() OVER (PARTITION BY pool ORDER BY engine_ord, pos, result_id) AS place FROM t WHERE engine_ord IS NOT NULL AND (engine_ord <> 3 OR weixin)""")
def cn_main_union(spark: SparkSession, d: str) -> DataFrame:
    """Chinese pools: rows of the main engines one engine after another, official documentation last."""
    t = _routed(spark, d, "cn").withColumn("engine_ord", _order(CN_MAIN)).where(F.col("engine_ord").isNotNull() & ((F.col("engine_ord") != 3) | F.col("q").rlike(WEIXIN_QUERY)))
    return t.select("result_id", "pool", F.row_number().over(Window.partitionBy("pool").orderBy("engine_ord", "pos", "result_id")).alias("place"))


_EN_ORDER = [e for _, engines in TIERS for e in engines]
_TIER_SQL = "CASE " + " ".join(f"WHEN {_FIRST} IN ({S.quoted(engines)}) THEN {k}" for k, (_, engines) in enumerate(TIERS)) + " END"


@query(f"""
WITH {_CAPTURED}, {S.QUERIES_CLEAN}, t AS (SELECT c.result_id, c.pool, c.pos, {_TIER_SQL} AS tier, {_order_sql([*_EN_ORDER, 'officialDocs'])} AS engine_ord FROM captured c JOIN queries_clean q USING (query_id) WHERE route = 'en'),
n AS (SELECT pool, tier, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pool ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
taken AS (SELECT t.* FROM t JOIN b USING (pool, tier) WHERE before < 3 UNION ALL BY NAME SELECT * FROM t WHERE engine_ord = {len(_EN_ORDER)})
SELECT result_id, pool, row_number() OVER (PARTITION BY pool ORDER BY engine_ord, pos, result_id) AS place FROM taken""")
def en_main_union(spark: SparkSession, d: str) -> DataFrame:
    """English pools: main engines, fallbacks while the tiers before gave too few rows, and official documentation after them, so that it can't suppress a fallback."""
    tier = F.lit(None).cast("int")
    for k, (_, engines) in enumerate(TIERS):
        tier = F.when(first_engine().isin(engines), k).otherwise(tier)
    t = _routed(spark, d, "en").withColumn("tier", tier).withColumn("engine_ord", _order([*_EN_ORDER, "officialDocs"])).where("engine_ord is not null")
    pool = Window.partitionBy("pool")
    # rows of the tiers before: all rows of lower tiers, by a range frame over the tier
    before = F.coalesce(F.sum(F.when(F.col("tier").isNotNull(), 1).otherwise(0)).over(pool.orderBy(F.coalesce("tier", F.lit(99))).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = t.withColumn("before", before).where(F.col("tier").isNull() | (F.col("before") < 3))
    return taken.select("result_id", "pool", F.row_number().over(pool.orderBy("engine_ord", "pos", "result_id")).alias("place"))


@query(f"""
WITH {_CAPTURED}, h AS (SELECT pool, pos, result_id, url, {S.host('url')} AS host, {S.url_key('url')} AS key, lower(max(official_dom) OVER (PARTITION BY pool)) AS dom, {_FIRST} = 'officialDocs' AS stamped, coalesce({_DOC}, false) AS doc FROM captured WHERE {S.valid('url')}),
o AS (SELECT * FROM h WHERE host = dom OR host LIKE '%.' || dom),
a AS (SELECT *, coalesce(bool_or(doc AND stamped) OVER (PARTITION BY pool), false) AS answered FROM o),
u AS (SELECT pool, key, min((NOT stamped)::INT) AS phase, bool_or(doc) AS doc, min(pos) AS pos, min(result_id) AS result_id FROM a WHERE stamped OR NOT answered GROUP BY pool, key)
SELECT pool, key, phase + 1 AS phase, doc, row_number() OVER (PARTITION BY pool ORDER BY doc DESC, phase, pos, result_id) AS rank FROM u""")
def official_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows on a pool's official host in two phases: those stamped as documentation; where none of them is a documentation page, the other engines' rows too; addresses once, documentation pages first."""
    pool = Window.partitionBy("pool")
    raw = U.with_address(L.captured(spark, d).select("pool", "pos", "result_id", "url", "source", "official_dom")).where("host <> ''")
    h = raw.withColumn("dom", F.lower(F.max("official_dom").over(pool))).where((F.col("host") == F.col("dom")) | F.endswith("host", F.concat(F.lit("."), F.col("dom"))))
    doc = (F.size(F.filter(F.split("path", "/"), lambda s: s != "")) >= 2) & F.col("url").rlike(DOC_PATH)
    o = h.withColumn("stamped", first_engine() == "officialDocs").withColumn("doc", F.coalesce(doc, F.lit(False)))
    a = o.withColumn("answered", F.bool_or(F.col("doc") & F.col("stamped")).over(pool)).where("stamped or not answered")
    u = a.groupBy("pool", "key").agg(F.min(F.when(F.col("stamped"), 1).otherwise(2)).alias("phase"), F.bool_or("doc").alias("doc"), F.min("pos").alias("pos"), F.min("result_id").alias("result_id"))
    return u.select("pool", "key", "phase", "doc", F.row_number().over(pool.orderBy(F.col("doc").desc(), "phase", "pos", "result_id")).alias("rank"))


#: Engines of the site search by route, in order; rows of other engines come after theirs.
SITE_ENGINES = {"cn": ["cnBing", "sogou", "baidu", "intlBing"], "en": ["intlBing", "ddgs", "cnBing"]}
_SITE_SQL = f"coalesce(CASE WHEN route = 'cn' THEN {_order_sql(SITE_ENGINES['cn'])} ELSE {_order_sql(SITE_ENGINES['en'])} END, 9)"


@query(f"""
WITH {_CAPTURED}, {S.QUERIES_CLEAN}, h AS (SELECT c.*, route, regexp_replace({S.host('url')}, '^www\\.', '') AS domain, {S.url_key('url')} AS key, {_SITE_SQL} AS engine_ord FROM captured c JOIN queries_clean q USING (query_id) WHERE {S.valid('url')}),
g AS (SELECT DISTINCT query_id, lower(unnest(gold)) AS site FROM queries),
m AS (SELECT h.query_id, site, key, min({{'e': engine_ord, 'p': pos, 'r': result_id}}) AS o FROM h JOIN g ON g.query_id = h.query_id AND (domain = site OR domain LIKE '%.' || site) GROUP BY ALL)
SELECT query_id, site, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, site ORDER BY o) AS rank FROM m) WHERE rank <= 10""")
def site_search(spark: SparkSession, d: str) -> DataFrame:
    """For each query and site (its gold hosts): the first ten pages of that site, one engine after another, without repeats.

    The pages of a hot query are pre-aggregated by address before they are numbered.
    """
    q = L.queries_clean(spark, d).select("query_id", "route")
    rows = salted_join(L.captured(spark, d).select("query_id", "result_id", "pos", "url", "source"), q, ["query_id"], by="result_id")
    engine = F.coalesce(F.when(F.col("route") == "cn", _order(SITE_ENGINES["cn"])).otherwise(_order(SITE_ENGINES["en"])), F.lit(9))
    rows = U.with_address(rows.withColumn("engine_ord", engine)).where("host <> ''").select("query_id", "result_id", "pos", "engine_ord", F.explode(U.host_suffixes(F.col("domain"))).alias("site"), "key")
    sites = L.table(spark, d, "queries").select("query_id", F.explode(F.array_distinct(F.transform("gold", lambda g: F.lower(g)))).alias("site"))
    m = rows.join(sites, ["query_id", "site"]).groupBy("query_id", "site", "key").agg(F.min(F.struct("engine_ord", "pos", "result_id")).alias("o"))
    r = m.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "site").orderBy("o")))
    return r.where("rank <= 10").select("query_id", "site", "key", "rank")


@query(f"""
WITH k AS (SELECT raw_url AS address, min(url) AS target FROM search_results WHERE raw_url IS NOT NULL AND {S.valid('url')} GROUP BY raw_url)
SELECT result_id, coalesce(target, r.raw_url, url) AS url FROM search_results r LEFT JOIN k ON k.address = r.raw_url""")
def redirects_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Each row's address, with redirects replaced by what any capture of the same redirect led to."""
    r = L.table(spark, d, "search_results")
    known = r.where(F.col("raw_url").isNotNull() & U.is_valid_url(F.col("url"))).groupBy(F.col("raw_url").alias("address")).agg(F.min("url").alias("target"))
    return N.resolve_redirects(r.select("result_id", F.coalesce("raw_url", "url").alias("url")), known)


@query(f"""
WITH a AS (SELECT query_id, count(*) AS n, max(api_score) AS best FROM search_results WHERE {_API_SQL} GROUP BY query_id)
SELECT q.query_id, coalesce(n, 0) AS n, best FROM queries q LEFT JOIN a USING (query_id)""")
def api_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For every query the rows that search interfaces have for it, and their best score."""
    a = L.table(spark, d, "search_results").where(_api(F.col("source"))).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("api_score").alias("best"))
    return L.table(spark, d, "queries").select("query_id").join(a, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), "best")


#: Default selection of an evaluation run: languages, and words one of which the query holds.
EVAL_LANGS, EVAL_WORDS = ("cn", "en"), ("cache", "log", "index", "日志", "缓存", "索引")


@query(f"""
SELECT query_id, q, lang FROM queries WHERE lang IN ({S.quoted(list(EVAL_LANGS))}) AND ({' OR '.join(f"contains(lower(q), '{w}')" for w in EVAL_WORDS)})""")
def query_selection(spark: SparkSession, d: str, langs: tuple[str, ...] = EVAL_LANGS, words: tuple[str, ...] = EVAL_WORDS) -> DataFrame:
    """Queries of an evaluation run: of the languages, and with any of the words (in any case)."""
    q = F.lower("q")
    return L.table(spark, d, "queries").where(F.col("lang").isin(list(langs)) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))).select("query_id", "q", "lang")


def _label_sql(stem: str, label: str) -> str:
    return f"""CASE WHEN length({stem}) < 3 OR length({label}) < 3 THEN 0 WHEN {stem} = {label} THEN 4 WHEN length({stem}) >= 4 AND starts_with({label}, {stem}) THEN 3 WHEN length({label}) >= 4 AND starts_with({stem}, {label}) THEN 3
 WHEN length({stem}) >= 4 AND contains({label}, {stem}) THEN 2 WHEN substr({stem}, 1, 3) = substr({label}, 1, 3) AND levenshtein({stem}, {label}) <= 2 THEN 1 ELSE 0 END"""


_BARE_WORD = "regexp_replace(regexp_replace(w, '[0-9]+$', ''), '[.+#-]', '', 'g')"
_LABELS = f"list_filter(string_split(dom, '.'), lambda s: length(s) >= 3 AND NOT list_contains([{S.quoted(LABEL_STOP)}], s))"


@query(f"""
WITH {S.QUERIES_CLEAN}, o AS (SELECT query_id, lower(min(official_dom)) AS dom FROM search_results WHERE official_dom IS NOT NULL GROUP BY query_id),
w AS (SELECT query_id, q, dom, n, w FROM (SELECT query_id, q, dom, regexp_extract_all(lower(q), '[a-z][a-z0-9+#]*') AS ws FROM queries_clean JOIN o USING (query_id)), unnest(ws) WITH ORDINALITY u(w, n)),
k AS (SELECT query_id, w, min(n) AS n FROM w WHERE len(list_filter({_LABELS}, lambda s: ({_label_sql(_BARE_WORD, 's')}) > 0)) > 0 GROUP BY query_id, w),
t AS (SELECT query_id, array_to_string(list(w ORDER BY n)[1:3], ' ') AS words FROM k GROUP BY query_id)
SELECT query_id, CASE WHEN words IS NOT NULL THEN words || ' reference guide documentation' ELSE q END AS hint FROM queries_clean JOIN o USING (query_id) LEFT JOIN t USING (query_id)""")
def docs_hint(spark: SparkSession, d: str) -> DataFrame:
    """The query that would ask a query's official host for its documentation."""
    o = L.table(spark, d, "search_results").where("official_dom is not null").groupBy("query_id").agg(F.lower(F.min("official_dom")).alias("dom"))
    return L.queries_clean(spark, d).join(o, "query_id").select("query_id", O.docs_query(F.col("q"), F.col("dom")).alias("hint"))


@query("""
SELECT query_id, regexp_matches(coalesce(q, ''), '[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]') AS cjk,
       array_to_string(list_transform(coalesce(gold, []), lambda g: CASE WHEN contains(d(g), '.') THEN d(g) ELSE d(g) || '.com' END), ' ') AS sites FROM queries""".replace("d(g)", "regexp_extract(regexp_replace(regexp_replace(lower(trim(g)), '^https?://', ''), '^www\\.', ''), '^([^/?#]*)', 1)"))
def typed_sites(spark: SparkSession, d: str) -> DataFrame:
    """Whether a query has characters of East Asian scripts, and its gold hosts as a person may have typed them, made regular."""
    q = L.table(spark, d, "queries")
    return q.select("query_id", T.has_cjk(F.col("q")).alias("cjk"), F.array_join(F.transform(F.coalesce("gold", F.array().cast("array<string>")), U.normalize_domain), " ").alias("sites"))


_API_RANKED = f"""
api_rows AS (SELECT c.pool, c.query_id, q.lang, q.gold, c.url, c.title, c.snippet, {S.coverage(S.query_terms('q.q'), "coalesce(title, '') || ' ' || coalesce(snippet, '')")} AS coverage, row_number() OVER (PARTITION BY c.pool ORDER BY c.pos, c.result_id) AS rank
  FROM (SELECT *, {S.POOL} AS pool FROM search_results WHERE query_id IS NOT NULL) c JOIN queries_clean q USING (query_id) WHERE {_API_SQL} AND {S.valid('url')} AND title IS NOT NULL)"""


def api_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Rows of search interfaces in their own order, with the columns that metrics need."""
    raw = L.captured(spark, d).where(_api(F.col("source")) & F.col("title").isNotNull()).select("result_id", "pool", "pos", "title", "url", "snippet")
    raw = R.ranked(U.with_address(raw).where("host <> ''").withColumn("order", F.struct("pos", "result_id")).withColumn("none", F.lit(0)), score="none", tie="order")
    rows = R.with_coverage(L.with_query(raw, spark, d))
    acts = P.match_rules(U.with_address(L.table(spark, d, "search_results").select("url")), L.table(spark, d, "domain_rules")).select("host", "actions")
    rows = salted_join(rows, acts, ["host"], by="pool", how="left")
    return V.flagged(rows).withColumn("junk", E.is_junk(F.col("domain"), F.col("actions")))


_METRICS = ["hit1", "hit3", "hit5", "mrr", "p5", "ndcg5"]


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_API_RANKED}, removed AS (SELECT DISTINCT h FROM (SELECT DISTINCT {S.host('url')} AS h FROM api_rows), rules_clean WHERE action = 'remove' AND ({S.MATCHES})),
{V._metrics_sql('ranking', 'pool, query_id, lang')}, {V._metrics_sql('api_rows', 'pool, query_id, lang').replace(f"regexp_matches({V._DOMAIN}, '{V._JUNK}') AS junk", f"regexp_matches({V._DOMAIN}, '{V._JUNK}') OR {S.host('url')} IN (SELECT h FROM removed) AS junk")},
both_ AS (SELECT 'own' AS way, * FROM metrics_ranking UNION ALL BY NAME SELECT 'api' AS way, * FROM metrics_api_rows),
g AS (SELECT way, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS queries, {V._MEANS}, round(avg(junk), 3) AS junk FROM (SELECT * REPLACE (coalesce(lang, '(none)') AS lang) FROM both_) GROUP BY GROUPING SETS ((way, lang), (way)))
SELECT a.lang, a.queries, {', '.join(f'a.{m} AS {m}_api, round(a.{m} - o.{m}, 4) AS {m}_gain' for m in _METRICS)}, a.junk AS junk_api FROM g a LEFT JOIN g o ON o.lang = a.lang AND o.way = 'own' WHERE a.way = 'api'""")
def api_only_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Search interfaces alone, by language and overall, beside the whole pipeline."""
    by_query = lambda rows, way: E.metrics(rows, ["pool", "query_id", "lang"]).withColumn("way", F.lit(way))
    both = by_query(api_ranked(spark, d), "api").unionByName(by_query(V.flagged(L.ranking(spark, d)), "own"))
    s = E.summary(both, ["way"])
    one = s.groupBy("lang").agg(*[F.max(F.when(F.col("way") == w, F.col(c))).alias(f"{c}_{w}") for w in ("api", "own") for c in [*_METRICS, "junk", "queries"]]).where("queries_api is not null")
    return one.select("lang", F.col("queries_api").alias("queries"), *[x for m in _METRICS for x in (F.col(f"{m}_api"), F.round(F.col(f"{m}_api") - F.col(f"{m}_own"), 4).alias(f"{m}_gain"))], "junk_api")


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_API_RANKED},
a AS (SELECT pool, count(*) AS n, max(coverage) AS best, count_if(coverage = 0) AS zero, round(avg(length(coalesce(snippet, ''))), 0) AS chars FROM api_rows WHERE rank <= 5 GROUP BY pool),
o AS (SELECT pool, max(coverage) AS best, count_if(coverage = 0) AS zero FROM ranking WHERE rank <= 5 GROUP BY pool),
p AS (SELECT DISTINCT pool FROM captured JOIN queries_clean USING (query_id))
SELECT p.pool, coalesce(a.n, 0) AS n, round(a.best, 6) AS best_api, round(o.best, 6) AS best_own, a.zero AS zero_api, o.zero AS zero_own, a.chars,
       CASE WHEN a.n IS NULL THEN 'no rows' WHEN round(a.best, 2) > round(o.best, 2) AND a.zero < o.zero THEN 'better' ELSE 'even or for a person to judge' END AS verdict
FROM p LEFT JOIN a USING (pool) LEFT JOIN o USING (pool)""")
def api_verdict(spark: SparkSession, d: str) -> DataFrame:
    """For every pool the first five rows of search interfaces against the first five of the pipeline."""
    first = lambda rows: rows.where("rank <= 5").groupBy("pool")
    a = first(api_ranked(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.max("coverage").alias("best_api"), F.count_if(F.col("coverage") == 0).alias("zero_api"), F.round(F.avg("chars"), 0).alias("chars"))
    o = first(L.ranking(spark, d)).agg(F.max("coverage").alias("best_own"), F.count_if(F.col("coverage") == 0).alias("zero_own"))
    r = L.query_of_pools(spark, d).select("pool").join(a, "pool", "left").join(o, "pool", "left")
    better = (F.round("best_api", 2) > F.round("best_own", 2)) & (F.col("zero_api") < F.col("zero_own"))
    verdict = F.when(F.col("n").isNull(), "no rows").when(better, "better").otherwise("even or for a person to judge")
    return r.select("pool", F.coalesce("n", F.lit(0)).alias("n"), F.round("best_api", 6).alias("best_api"), F.round("best_own", 6).alias("best_own"), "zero_api", "zero_own", "chars", verdict.alias("verdict"))


#: Ways of taking in rows of search interfaces, in the order of their numbers.
WAYS = ["prod", "append", "gate020", "gate040", "new_domain", "max5", "single", "rescue8", "rescue12", "single_or_rescue8"]


def with_ways(rows: DataFrame) -> DataFrame:
    """One row for each way that takes the row in, numbered by ``way``; of raw rows with ``pool``, ``q``, ``pos``, ``source`` and ``host``.

    Rows of the other engines are in every way; those of search interfaces come after them. No shuffle for rows partitioned by pool.
    """
    pool = Window.partitionBy("pool")
    own = ~_api(F.col("source"))
    w = R.with_coverage(rows).withColumn("own", own).withColumn("prod", F.count_if("own").over(pool))
    w = w.withColumn("engines", F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("own"), T.split_sources(F.col("source")))).over(pool)))))
    w = w.withColumn("known", F.bool_or("own").over(Window.partitionBy("pool", "host"))).withColumn("nth", F.sum(F.when(F.col("own"), 0).otherwise(1)).over(pool.orderBy("pos", "result_id").rowsBetween(Window.unboundedPreceding, 0)))
    single = F.col("engines") < 2
    tests = [F.lit(False), F.lit(True), F.col("coverage") >= 0.2, F.col("coverage") >= 0.4, ~F.col("known") & (F.col("host") != ""), F.col("nth") <= 5, single, F.col("prod") < 8, F.col("prod") < 12, single | (F.col("prod") < 8)]
    return w.withColumn("way", F.explode(F.array_compact(F.array(*[F.when(F.col("own") | t, k) for k, t in enumerate(tests)]))))


_WAYS_SQL = f"""
raw_ AS (SELECT c.*, {S.POOL} AS pool_, {S.host('url')} AS host_, NOT ({_API_SQL}) AS own, {S.coverage(S.query_terms('q.q'), "coalesce(title, '') || ' ' || coalesce(snippet, '')")} AS coverage_, list_filter(list_transform(string_split(coalesce(source, ''), '+'), lambda s: trim(s)), lambda s: s <> '') AS names FROM search_results c JOIN queries_clean q USING (query_id)),
counts_ AS (SELECT *, count_if(own) OVER (PARTITION BY pool_) AS prod, len(list_distinct(flatten(list(CASE WHEN own THEN names END) OVER (PARTITION BY pool_)))) AS engines_, bool_or(own) OVER (PARTITION BY pool_, host_) AS known, sum((NOT own)::INT) OVER (PARTITION BY pool_ ORDER BY pos, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM raw_),
ways AS (SELECT *, unnest(list_filter([CASE WHEN own THEN 0 END, 1, CASE WHEN own OR coverage_ >= 0.2 THEN 2 END, CASE WHEN own OR coverage_ >= 0.4 THEN 3 END, CASE WHEN own OR (NOT known AND host_ <> '') THEN 4 END, CASE WHEN own OR nth <= 5 THEN 5 END,
  CASE WHEN own OR engines_ < 2 THEN 6 END, CASE WHEN own OR prod < 8 THEN 7 END, CASE WHEN own OR prod < 12 THEN 8 END, CASE WHEN own OR engines_ < 2 OR prod < 8 THEN 9 END], lambda x: x IS NOT NULL)) AS way FROM counts_)"""
_NAME_WAY = "[" + ", ".join(f"'{w}'" for w in WAYS) + "][way + 1]"


@query(f"WITH {S.QUERIES_CLEAN}, {_WAYS_SQL} SELECT {_NAME_WAY} AS strategy, count(*) AS rows, count(DISTINCT pool_) AS pools FROM ways GROUP BY way")
def ab_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each way of taking in rows of search interfaces would rank."""
    return with_ways(_raw_with_query(spark, d)).groupBy("way").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pool").alias("pools")).select(_way_name(), "rows", "pools")


def _way_name() -> Column:
    return F.element_at(F.array(*map(F.lit, WAYS)), F.col("way") + 1).alias("strategy")


def _raw_with_query(spark: SparkSession, d: str) -> DataFrame:
    raw = L.captured(spark, d).select("result_id", "pool", "pos", "title", "url", "snippet", "source", U.host(F.col("url")).alias("host"))
    return L.with_query(raw.repartition("pool"), spark, d)


def _ways_as_pools(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows with a pool of each way: the pipeline ranks each of them apart; interfaces' rows come last in it."""
    ways = with_ways(_raw_with_query(spark, d))
    return ways.select("result_id", F.col("query_id"), (F.col("pool") * 16 + F.col("way")).alias("pool"), (F.col("pos") + F.when(F.col("own"), 0).otherwise(1_000_000)).alias("pos"), "title", "url", "snippet", "source")


_WAYS_PIPELINE = S.SIGNALS.replace(f"SELECT *, {S.POOL} AS pool FROM search_results WHERE query_id IS NOT NULL", "SELECT * EXCLUDE (pos, own, prod, known, nth), pos + CASE WHEN own THEN 0 ELSE 1000000 END AS pos, pool_ * 16 + way AS pool FROM ways").replace("floor(t.pool / 100000000)::BIGINT", "(t.pool // 1600000000)").replace(f"{S.QUERIES_CLEAN},", "")


@query(f"""
WITH RECURSIVE {S.QUERIES_CLEAN}, {_WAYS_SQL}, {_WAYS_PIPELINE}, {V._metrics_sql('ranking', 'pool, query_id, lang')},
m AS (SELECT *, pool % 16 AS way FROM metrics_ranking), g AS (SELECT way, count(*) AS queries, {V._MEANS}, round(avg(junk), 3) AS junk FROM m GROUP BY way)
SELECT {_NAME_WAY} AS strategy, queries, {', '.join(_METRICS)}, junk, round(ndcg5 - (SELECT ndcg5 FROM g WHERE way = 0), 4) AS gain FROM g""")
def ab_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each way of taking in rows of search interfaces, and its gain over the way without them."""
    m = _ab_by_query(spark, d)
    g = m.groupBy("way").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in _METRICS], F.round(F.avg("junk"), 3).alias("junk"))
    base = F.max(F.when(F.col("way") == 0, F.col("ndcg5"))).over(Window.partitionBy())  # a row for each of WAYS
    return g.select(_way_name(), "queries", *_METRICS, "junk", F.round(F.col("ndcg5") - base, 4).alias("gain"))


def _ab_by_query(spark: SparkSession, d: str) -> DataFrame:
    raw = _ways_as_pools(spark, d)
    return E.metrics(V.flagged(L.ranking(spark, d, raw=raw)), ["pool", "query_id", "lang"]).withColumn("way", F.pmod("pool", F.lit(16)).cast("int")).withColumn("pool", F.floor(F.col("pool") / 16).cast("bigint"))


@query(f"""
WITH RECURSIVE {S.QUERIES_CLEAN}, {_WAYS_SQL}, {_WAYS_PIPELINE}, {V._metrics_sql('ranking', 'pool, query_id, lang')},
m AS (SELECT pool // 16 AS pool, pool % 16 AS way, ndcg5 FROM metrics_ranking)
SELECT b.pool, {_NAME_WAY.replace('way', 'b.way')} AS strategy, round(a.ndcg5, 6) AS ndcg5_prod, round(b.ndcg5, 6) AS ndcg5, round(b.ndcg5 - a.ndcg5, 6) AS delta FROM m a JOIN m b ON b.pool = a.pool AND a.way = 0 AND b.way > 0 WHERE abs(b.ndcg5 - a.ndcg5) >= 0.005""")
def ab_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Pools that a way moves by 0.005 of nDCG or more against the way without search interfaces."""
    m = _ab_by_query(spark, d).select("pool", "way", "ndcg5")
    # the base is a row of the same pool: a window in place of a join
    base = F.max(F.when(F.col("way") == 0, F.col("ndcg5"))).over(Window.partitionBy("pool"))
    r = m.withColumn("base", base).withColumn("delta", F.col("ndcg5") - F.col("base")).where((F.col("way") > 0) & (F.abs("delta") >= 0.005))
    return r.select("pool", _way_name(), F.round("base", 6).alias("ndcg5_prod"), F.round("ndcg5", 6).alias("ndcg5"), F.round("delta", 6).alias("delta"))


@query(f"""
WITH RECURSIVE {S.SIGNALS},
p AS (SELECT k.pool, count(*) AS rows, bool_or({V._GOLD.replace('gold,', 'q.gold,')}) AS in_pool FROM kept k JOIN queries_clean q USING (query_id) GROUP BY k.pool),
o AS (SELECT pool, bool_or({V._GOLD}) AS in_top, min(CASE WHEN {V._GOLD} THEN rank END) AS first_rank FROM ranking WHERE rank <= 5 GROUP BY pool)
SELECT pool, rows, in_pool, coalesce(in_top, false) AS in_top, first_rank, CASE WHEN coalesce(in_top, false) THEN 'shown' WHEN in_pool THEN 'ranked too low' ELSE 'not recalled' END AS diagnosis FROM p LEFT JOIN o USING (pool)""")
def recall_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Where gold is lost: not recalled into the pool, recalled but ranked too low, or shown among the first five."""
    rows = L.with_query(L.kept_rows(spark, d), spark, d)
    p = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(E.is_gold(F.col("domain"), F.col("gold"))).alias("in_pool"))
    top = V.flagged(L.ranking(spark, d)).where("rank <= 5").groupBy("pool").agg(F.bool_or("is_gold").alias("in_top"), F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_rank"))
    r = p.join(top, "pool", "left").withColumn("in_top", F.coalesce("in_top", F.lit(False)))
    return r.select("pool", "rows", "in_pool", "in_top", "first_rank", F.when(F.col("in_top"), "shown").when(F.col("in_pool"), "ranked too low").otherwise("not recalled").alias("diagnosis"))


@query(f"""
WITH c AS (SELECT *, {S.POOL} AS pool FROM search_results WHERE query_id IS NOT NULL)
SELECT pool, (row_number() OVER (PARTITION BY pool ORDER BY pos, result_id) - 1)::INT AS place, title, url, snippet, source FROM c""")
def capture_store(spark: SparkSession, d: str) -> DataFrame:
    """Captures written as one JSON item for each pool, as an evaluation run stores them, and read back as rows."""
    return read_captures(spark, write_captures(L.captured(spark, d)))


_ITEM = "pool bigint, raw array<struct<title:string,url:string,snippet:string,source:string>>"


def write_captures(rows: DataFrame) -> str:
    """Writes one JSON item for each pool (a capture: tens of rows, in order) to the shared folder and returns where."""
    from rankloom.plans.durable import place

    item = F.transform(F.array_sort(F.collect_list(F.struct("pos", "result_id", "title", "url", "snippet", "source"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["snippet"].alias("snippet"), x["source"].alias("source")))
    path = place(rows.sparkSession)
    rows.groupBy("pool").agg(item.alias("raw")).write.json(path)
    return path


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Rows of stored captures: ``pool``, ``place`` (from 0), title, url, snippet, source."""
    return spark.read.schema(_ITEM).json(path).select("pool", F.posexplode("raw").alias("place", "x")).select("pool", "place", "x.*")


__all__ = ["API", "QUERIES", "SQL"]
