"""Queries over state and dimensions: caches, negative caches, breakers, official hosts, host lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import constants as C
from rankloom.functions import text as T
from rankloom.functions import urls as U
from rankloom.operators import official as O
from rankloom.plans import pools as L
from rankloom.plans import sql as S
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


@query("""
WITH c AS (SELECT * FROM result_cache QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY created_at DESC, engine NULLS LAST, results NULLS LAST) = 1)
SELECT query_hash, coalesce(engine, '(none)') AS engine, created_at, CASE WHEN results IS NOT NULL THEN json_valid(results) AND coalesce(json_type(try_cast(results AS JSON)) = 'ARRAY', false) END AS ok, CASE WHEN json_valid(results) AND json_type(try_cast(results AS JSON)) = 'ARRAY' THEN json_array_length(results)::INT END AS n FROM c WHERE query_hash IS NOT NULL""")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each key wins; broken and null bodies are kept as misses."""
    c = L.table(spark, d, "result_cache").where("query_hash is not null")
    # nulls come last: a body or engine that is there wins; texts are compared the other way round than times
    order = F.struct("created_at", F.col("engine").isNotNull().alias("a"))
    latest = c.groupBy("query_hash").agg(F.max(order).alias("o")).select("query_hash", "o.*").withColumnRenamed("created_at", "at")
    same = c.withColumn("a", F.col("engine").isNotNull()).join(latest.withColumnRenamed("a", "b"), "query_hash").where("created_at = at and a = b")
    last = same.groupBy("query_hash").agg(F.max("created_at").alias("created_at"), F.min(F.struct(F.coalesce("engine", F.lit("")).alias("e"), F.col("results").isNull().alias("n"), F.coalesce("results", F.lit("")).alias("r"), "engine", "results")).alias("x"))
    last = last.select("query_hash", "created_at", "x.engine", "x.results")
    n = F.json_array_length("results")
    return last.select("query_hash", F.coalesce("engine", F.lit("(none)")).alias("engine"), "created_at", F.when(F.col("results").isNull(), F.lit(None).cast("boolean")).otherwise(n.isNotNull()).alias("ok"), n.alias("n"))


@query("""
SELECT query_hash, created_at, (i - 1)::INT AS pos, json_extract_string(results, '$[' || (i - 1) || '].title') AS title, json_extract_string(results, '$[' || (i - 1) || '].url') AS url, json_extract_string(results, '$[' || (i - 1) || '].source') AS source
FROM (SELECT query_hash, created_at, results, unnest(range(1, json_array_length(results)::BIGINT + 1)) AS i FROM result_cache WHERE json_valid(results))""")
def cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows inside cached answers; broken and null bodies have none."""
    c = L.table(spark, d, "result_cache").where(F.json_array_length("results").isNotNull())
    rows = F.from_json("results", "array<struct<title:string,url:string,source:string>>")
    return c.select("query_hash", "created_at", F.posexplode(rows).alias("pos", "r")).select("query_hash", "created_at", "pos", "r.title", "r.url", "r.source")


#: Lifetime of a disk entry.
DISK_TTL = "INTERVAL 360 MINUTES"


@query(f"""
WITH {S.QUERIES_CLEAN}, h AS (SELECT query_id, sha1(q) AS query_hash FROM queries_clean), a AS (SELECT DISTINCT query_id, captured_at FROM search_results WHERE query_id IS NOT NULL AND captured_at IS NOT NULL AND pos = 1),
w AS (SELECT query_hash, created_at AS ts, NULL::BIGINT AS query_id, created_at AS written FROM result_cache WHERE json_valid(results) AND json_type(try_cast(results AS JSON)) = 'ARRAY' AND query_hash IS NOT NULL UNION ALL SELECT query_hash, captured_at, a.query_id, NULL FROM a JOIN h USING (query_id)),
l AS (SELECT *, last_value(written IGNORE NULLS) OVER (PARTITION BY query_hash ORDER BY ts, query_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM w)
SELECT query_id, ts AS asked_at, coalesce(seen > ts - {DISK_TTL}, false) AS hit FROM l WHERE query_id IS NOT NULL""")
def cache_lookup_ttl(spark: SparkSession, d: str) -> DataFrame:
    """For each first-place capture: would the cache have answered, written at most DISK_TTL before?

    An as-of look-back as a window over the union of writes and questions. A query that is asked again and
    again is split by day with the writes of the day before, so that no key gathers all of its history.
    """
    h = L.queries_clean(spark, d).select("query_id", F.sha1("q").alias("query_hash"))
    asked = L.table(spark, d, "search_results").where("query_id is not null and captured_at is not null and pos = 1").select("query_id", "captured_at").distinct().join(h, "query_id")
    asked = asked.select("query_hash", F.col("captured_at").alias("ts"), "query_id", F.lit(None).cast("timestamp").alias("written"), F.to_date("captured_at").alias("day"))
    writes = L.table(spark, d, "result_cache").where(F.json_array_length("results").isNotNull() & F.col("query_hash").isNotNull())
    days = F.array(F.to_date("created_at"), F.date_add(F.to_date("created_at"), 1))
    writes = writes.select("query_hash", F.col("created_at").alias("ts"), F.lit(None).cast("bigint").alias("query_id"), F.col("created_at").alias("written"), F.explode(days).alias("day"))
    w = Window.partitionBy("query_hash", "day").orderBy(F.col("ts"), F.col("query_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(writes).withColumn("seen", F.last("written", ignorenulls=True).over(w)).where("query_id is not null")
    return seen.select("query_id", F.col("ts").alias("asked_at"), F.coalesce(F.col("seen") > F.col("ts") - F.expr(DISK_TTL), F.lit(False)).alias("hit"))


@query("""
WITH l AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM events)
SELECT event_id, coalesce(failed > ts - INTERVAL 5 MINUTES, false) AS refused FROM l""")
def negative_cache(spark: SparkSession, d: str) -> DataFrame:
    """Events of a key within five minutes of its last failure (the key's history is split by hour with the hour before)."""
    e = L.table(spark, d, "events")
    hour = F.date_trunc("hour", "ts")
    each = e.select("event_id", "user_id", "ts", "event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).withColumn("hour", hour + F.make_dt_interval(hours=F.col("later")))
    # the copy in the next hour only serves as history
    w = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    l = each.withColumn("failed", F.last(F.when(F.col("event_type") == "error", F.col("ts")), ignorenulls=True).over(w)).where("later = 0")  # noqa: E741
    return l.select("event_id", F.coalesce(F.col("failed") > F.col("ts") - F.expr("INTERVAL 5 MINUTES"), F.lit(False)).alias("refused"))


@query("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def engine_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of engine events (an extension: the streaming form is in ``rankloom.streaming``)."""
    e = L.table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""
WITH e AS (SELECT * FROM events),
o AS (SELECT event_id, ts FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM o WHERE o.ts < e.ts AND o.ts > e.ts - INTERVAL 5 MINUTES) AS open FROM e""")
def breaker(spark: SparkSession, d: str) -> DataFrame:
    """The engine-wide breaker: open while any failure lies less than five minutes back.

    Failures mark the five-minute slots they can reach into (their own and the next); events meet the
    failures of their slot only through the slot's pre-aggregated distinct failure times.
    """
    e = L.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    slot = F.floor(F.unix_micros("ts") / 300_000_000)
    failures = e.where("event_type = 'error'").select("ts", slot.alias("slot"))
    # within its own slot an event needs the first failure, in the next slot the last one
    first, last = failures.groupBy("slot").agg(F.min("ts").alias("first")), failures.groupBy((F.col("slot") + 1).alias("slot")).agg(F.max("ts").alias("last"))
    s = e.withColumn("slot", slot).join(first, "slot", "left").join(last, "slot", "left")
    opened = F.coalesce(F.col("first") < F.col("ts"), F.lit(False)) | F.coalesce(F.col("last") > F.col("ts") - F.expr("INTERVAL 5 MINUTES"), F.lit(False))
    return s.select("event_id", opened.alias("open"))


_BUILT_IN = ", ".join(f"('{r}')" for r in [*("." + t for t in N.NOTORIOUS_TLDS), *(h for h in C.SHORTENERS if h != "shortest.link")])
_LOWERED = ", ".join(f"('lower', '{h}')" for h in C.LOWERED)


@query(f"""
WITH u AS (SELECT {S.host('url')} AS host, min(result_id) AS n FROM search_results GROUP BY 1), h AS (SELECT * FROM u WHERE host <> ''),
hosts AS (SELECT host AS rule FROM h WHERE host LIKE '%.test' AND contains(host, '.') AND NOT regexp_matches(host, '^[0-9.]+$|:') ORDER BY n LIMIT 1000),
abp AS (SELECT host AS rule FROM h WHERE NOT host LIKE '%.test' AND contains(host, '.') AND regexp_full_match(host, '[a-z0-9_.-]+') AND NOT regexp_matches(host, '^[0-9.]+$') ORDER BY n LIMIT 1500),
tlds AS (SELECT DISTINCT '.' || regexp_extract(host, '([^.]+)$', 1) AS rule FROM h WHERE regexp_full_match(regexp_extract(host, '([^.]+)$', 1), '[a-z0-9-]{{2,}}') AND (host LIKE '%.test' OR regexp_extract(host, '([^.]+)$', 1) IN ({S.quoted(N.NOTORIOUS_TLDS)})))
SELECT 'remove' AS action, rule FROM (SELECT rule FROM hosts UNION SELECT rule FROM abp UNION SELECT rule FROM tlds UNION SELECT * FROM (VALUES {_BUILT_IN}) b(rule))
UNION ALL SELECT * FROM (VALUES {_LOWERED}) l(action, rule)""")
def blocklist_etl(spark: SparkSession, d: str) -> DataFrame:
    """Three host lists as text in their formats, in the order in which hosts first appear, parsed with each list's limit and joined to the built-in rules."""
    seen = L.table(spark, d, "search_results").select("result_id", U.host(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.min("result_id").alias("n"))
    test = F.endswith("host", F.lit(".test"))
    one = lambda name, value: F.struct(F.lit(name).alias("list"), F.lit(name).alias("kind"), value.alias("value"))
    tld = F.concat(F.lit("||*."), F.regexp_extract("host", r"([^.]+)$", 1), F.when(test, "^").otherwise("^$denyallow=example.org"))
    lines = F.array(F.when(test, one("hosts", F.concat(F.lit("0.0.0.0 "), "host", F.lit(" # seen")))).otherwise(one("abp", F.concat(F.lit("||"), "host", F.lit("^$third-party")))), one("abp-tlds", tld))
    return N.parse_blocklists(seen.select("n", F.explode(lines).alias("x")).select("n", "x.*"))


def _fallback_sql(name: str, keep: str) -> str:
    built = ", ".join(f"('{r}', 'remove')" for r in [*C.JUNK_TLDS, *C.SHORTENERS]) + ", " + ", ".join(f"('{r}', 'lower')" for r in C.LOWERED)
    own = f"SELECT rule, action FROM domain_rules WHERE trim(rule) <> '' AND {keep}"
    return f"SELECT '{name}' AS rules, rule, action FROM ({own} UNION ALL SELECT rule, action FROM (VALUES {built}) b(rule, action) WHERE action NOT IN (SELECT action FROM domain_rules WHERE trim(rule) <> '' AND {keep}))"


@query(" UNION ALL ".join([_fallback_sql("all", "true"), _fallback_sql("without lower", "action <> 'lower'"), _fallback_sql("none", "action NOT IN ('lower', 'remove')")]))
def rule_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The rules in force with the whole table, and with tables that lack one or both kinds, for which the built-in lists step in."""
    rules = L.table(spark, d, "domain_rules")
    kinds = {"all": rules, "without lower": rules.where("action <> 'lower'"), "none": rules.where("action not in ('lower', 'remove')")}
    parts = [N.with_fallback(r).select(F.lit(k).alias("rules"), "rule", "action") for k, r in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""
WITH {S.QUERIES_CLEAN}, r AS (SELECT regexp_replace(lower(trim(rule)), '^\\*?\\.', '') AS dom, min(ord) AS ord FROM domain_rules WHERE action = 'authority' GROUP BY 1),
stems AS (SELECT query_id, unnest(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(q), '[a-z][a-z0-9+#]*'), lambda w: length(w) >= 3), lambda w: regexp_replace(regexp_replace(w, '[0-9]+$', ''), '[.+#-]', '', 'g')), lambda s: length(s) >= 3))) AS stem FROM queries_clean),
labels AS (SELECT dom, ord, string_split(dom, '.') AS parts, unnest(string_split(dom, '.')) AS label FROM r),
m AS (
  SELECT query_id, dom, ord, label, CASE WHEN NOT list_contains([{S.quoted(O.LABEL_STOP)}], parts[1]) AND len(parts) >= 3 AND stem = parts[1] THEN 5 WHEN stem = label THEN 4
         WHEN length(stem) >= 4 AND starts_with(label, stem) THEN 3 WHEN length(label) >= 4 AND starts_with(stem, label) THEN 3 WHEN length(stem) >= 4 AND contains(label, stem) THEN 2
         WHEN substr(stem, 1, 3) = substr(label, 1, 3) AND levenshtein(stem, label) <= 2 THEN 1 ELSE 0 END AS score
  FROM stems, labels WHERE length(label) >= 3 AND NOT list_contains([{S.quoted(O.LABEL_STOP)}], label)),
best AS (SELECT query_id, arg_min(dom, {{'s': -score, 'l': CASE WHEN score = 5 THEN 0 ELSE length(label) END, 'o': ord}}) AS domain, max(score) AS score FROM m WHERE score > 0 GROUP BY query_id),
named AS (SELECT query_id, CASE {' '.join(f"WHEN contains({'lower(q)' if a.isascii() else 'q'}, '{a}') THEN '{h}'" for a, h in C.OFFICIAL_ALIASES)} END AS alias FROM queries_clean)
SELECT query_id, coalesce(alias, domain) AS domain, CASE WHEN alias IS NULL THEN score END AS score FROM named LEFT JOIN best USING (query_id) WHERE coalesce(alias, domain) IS NOT NULL""")
def official_domain(spark: SparkSession, d: str) -> DataFrame:
    """The documentation host of a query: that of the first product alias it names (without a score), else the one its product words spell, of the authority hosts in the rule table."""
    q = L.queries_clean(spark, d)
    best = O.inferred(q, L.table(spark, d, "domain_rules"))
    named = q.select("query_id", O.alias(F.col("q")).alias("alias")).join(best, "query_id", "left")
    return named.select("query_id", F.coalesce("alias", "domain").alias("domain"), F.when(F.col("alias").isNull(), F.col("score")).alias("score")).where("domain is not null")


_PROVIDER = "CASE WHEN list_contains(engines, 'tavily') THEN 'tavily' WHEN list_contains(engines, 'bocha') THEN 'bocha' WHEN list_contains(engines, 'zhipu') THEN 'zhipu' END"
_SPLIT = "list_transform(string_split(coalesce(source, ''), '+'), lambda s: trim(s)) AS engines"


@query(f"""
WITH e AS (SELECT *, {_SPLIT} FROM search_results), p AS (SELECT *, {_PROVIDER} AS provider FROM e)
SELECT result_id, title, url, substr(snippet, 1, CASE provider WHEN 'tavily' THEN 800 ELSE 500 END) AS snippet, provider AS source FROM p WHERE provider IS NOT NULL AND {S.valid('url')} AND title IS NOT NULL""")
def api_responses(spark: SparkSession, d: str) -> DataFrame:
    """Rows of search interfaces (alone or joined with other engines) written as each provider's JSON and parsed back by its parser."""
    r = L.table(spark, d, "search_results").where(F.col("url").isNotNull() & F.col("title").isNotNull())
    return N.parsed(N.as_responses(r)).select(F.col("ref").alias("result_id"), "title", "url", "snippet", "source")


@query("""
SELECT query_hash, created_at, CASE WHEN regexp_matches(results, '"(?:code|status)"\\s*:\\s*(?:401|403|429)\\b') OR regexp_matches(results, '(?i)unauthori[sz]ed|invalid.{0,10}key|api key|quota|rate limit') THEN 'auth' ELSE 'contract' END AS error
FROM result_cache WHERE results IS NOT NULL""")
def answer_errors(spark: SparkSession, d: str) -> DataFrame:
    """Cached bodies read as a provider's answers: none has the shape of one, so each is an error of the contract or, by its wording, of the key."""
    c = L.table(spark, d, "result_cache").where("results is not null").select(F.struct("query_hash", "created_at").alias("ref"), F.lit("tavily").alias("source"), F.col("results").alias("body"))
    return N.failures(c).select("ref.query_hash", "ref.created_at", "error")


@query(f"""
WITH c AS (SELECT *, {S.POOL} AS pool, {_SPLIT} FROM search_results WHERE query_id IS NOT NULL),
f AS (SELECT pool, bool_or(list_contains(engines, 'tavily')) AS t, bool_or(list_contains(engines, 'bocha')) AS b, bool_or(list_contains(engines, 'zhipu')) AS z FROM c GROUP BY pool)
SELECT pool, CASE WHEN t THEN 'tavily' WHEN b THEN 'bocha' WHEN z THEN 'zhipu' END AS provider FROM f""")
def provider_choice(spark: SparkSession, d: str) -> DataFrame:
    """The search interface that answers for each pool: the first of the fixed order that has rows there, null without one."""
    c = L.captured(spark, d).select("pool", T.split_sources(F.col("source")).alias("engines"))
    f = c.groupBy("pool").agg(*[F.bool_or(F.array_contains("engines", F.lit(p))).alias(p) for p in N.PROVIDERS])
    return f.select("pool", F.coalesce(*[F.when(F.col(p), p) for p in N.PROVIDERS]).alias("provider"))
