"""Queries over fetched pages: charset, text, headings, markdown, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import urls as U
from rankloom.functions.text import squeeze
from rankloom.operators import extract as X
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


def _squeezed(t: str) -> str:
    t = f"regexp_replace({t}, '[ \\t\\x{{00a0}}\\x{{3000}}]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9))"


@query(f"SELECT extract_id, {_squeezed('plain')} AS text FROM extractions WHERE plain IS NOT NULL")
def squeezed_text(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "extractions").where("plain is not null").select("extract_id", X.squeezed(F.col("plain")).alias("text"))


@query("""
SELECT extract_id, coalesce(nullif(lower(regexp_extract(charset, '([A-Za-z0-9_-]+)', 1)), ''), nullif(lower(regexp_extract(substr(html, 1, 4096), '(?i)<meta[^>]+charset=["'']?([A-Za-z0-9_-]+)', 1)), ''), 'utf-8') AS charset FROM extractions""")
def charset_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Declared charset, else the one of a meta tag in the first 4 KB, else utf-8."""
    return L.table(spark, d, "extractions").select("extract_id", X.charset(F.col("charset"), F.col("html")).alias("charset"))


_HEAD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\[\s*#*\s*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '^\s*#+\s*', ''), '\s*#+\s*$', '')"
_PIECES = r"list_filter(list_transform(regexp_split_to_array({}, '\s*[|｜·_–—-]\s*'), lambda p: lower(trim(regexp_replace(p, '\s+', ' ', 'g')))), lambda p: p <> '')"


def _heading(title: str) -> str:
    return f"coalesce(list_reduce({_PIECES.format(_HEAD.format(title))}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, ''), '')"


@query(f"SELECT extract_id, {_heading("coalesce(title, '')")} AS heading FROM extractions")
def heading_norm(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "extractions").select("extract_id", X.normal_heading(F.coalesce("title", F.lit(""))).alias("heading"))


@query(f"""
WITH c AS (SELECT extract_id, title, '# [#](#top) ' || regexp_extract(coalesce(title, ''), '^([^|·]*)', 1) || chr(10) || chr(10) || coalesce(plain, '') AS content FROM extractions),
h AS (SELECT *, {_heading("trim(split_part(content, chr(10), 1))")} AS head, {_heading("coalesce(title, '')")} AS whole FROM c)
SELECT extract_id, CASE WHEN regexp_matches(trim(split_part(content, chr(10), 1)), '^#\\s') AND head <> '' AND whole <> '' AND starts_with(whole, head) THEN regexp_replace(regexp_replace(content, '^[^\\n]*\\n', ''), '^\\n+', '') ELSE content END AS content FROM h""")
def title_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Each page's text under a heading made of its title (with the anchor that sites put there), without the heading where it repeats the title."""
    title = F.regexp_extract(F.coalesce("title", F.lit("")), "^([^|·]*)", 1)
    content = F.concat(F.lit("# [#](#top) "), title, F.lit("\n\n"), F.coalesce("plain", F.lit("")))
    return L.table(spark, d, "extractions").select("extract_id", X.without_title(content, F.col("title")).alias("content"))


@query(f"""
WITH t AS (SELECT extract_id, title, url, via, {_squeezed('plain')} AS text FROM extractions WHERE plain IS NOT NULL)
SELECT extract_id, '# ' || coalesce(title, '') || chr(10) || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || chr(10) ||
       CASE WHEN text = '' THEN '(no content, way taken: ' || coalesce(via, 'none') || '; the page may need scripts)' WHEN length(text) > 800 THEN substr(text, 1, 800) || chr(10) || chr(10) || '[...truncated at 800 characters]' ELSE text END AS answer FROM t""")
def fetch_envelope(spark: SparkSession, d: str) -> DataFrame:
    t = L.table(spark, d, "extractions").where("plain is not null").withColumn("text", X.squeezed(F.col("plain")))
    return t.select("extract_id", X.envelope(F.col("title"), F.col("url"), X.answer(X.truncated(F.col("text"), 800), F.col("via"))).alias("answer"))


_TAGS = "|".join(sorted(X.BLOCK_TAGS))
_ENT = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


_BARE = f"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)</?({_TAGS}|br)(\\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query(f"SELECT extract_id, {_squeezed(_ENT.format(_BARE))} AS text FROM extractions WHERE html IS NOT NULL")
def plain_text_basic(spark: SparkSession, d: str) -> DataFrame:
    """Text of the html by patterns alone, without a parser."""
    return L.table(spark, d, "extractions").where("html is not null").select("extract_id", X.text_by_patterns(F.col("html")).alias("text"))


@query("""
SELECT via, count(*) AS pages, count_if(length(coalesce(plain, '')) < 80) AS short, round(avg(length(plain)), 4) AS mean_chars FROM extractions GROUP BY via""")
def extraction_paths(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "extractions")
    return e.groupBy("via").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length(F.coalesce("plain", F.lit(""))) < 80).alias("short"), F.round(F.avg(F.length("plain")), 4).alias("mean_chars"))


@query("""
SELECT page_id, max(fetched_at) AS fetched_at, arg_max(extract_id, {'a': fetched_at, 'b': extract_id}) AS extract_id, count(*) AS fetches FROM extractions GROUP BY page_id""")
def latest_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The latest fetch of each page; equal times go to the larger id."""
    e = L.table(spark, d, "extractions")
    return e.groupBy("page_id").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("extract_id", F.struct("fetched_at", "extract_id")).alias("extract_id"), F.count(F.lit(1)).alias("fetches"))


def _meta(pattern: str) -> str:
    return f"regexp_extract(coalesce(html, ''), '{pattern}', 1)"


#: The ways in which a page describes itself, and its first paragraph.
_OG = r"(?is)<meta[^>]+property=[\x22\x27]og:description[\x22\x27][^>]*content=[\x22\x27]([^\x22\x27]*)"
_DESCRIPTION = r"(?is)<meta[^>]+name=[\x22\x27]description[\x22\x27][^>]*content=[\x22\x27]([^\x22\x27]*)"
_FIRST_P = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[\s>]|\z)"
_DESCRIBED = f"coalesce(nullif({_meta(_OG)}, ''), nullif({_meta(_DESCRIPTION)}, ''), nullif({_ENT.format(f'regexp_replace({_meta(_FIRST_P)}, {chr(39)}<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, ''), plain, '')"


def _described():  # noqa: ANN202
    html = F.coalesce("html", F.lit(""))
    part = lambda p: F.regexp_extract(html, p, 1)
    return F.coalesce(F.nullif(part(_OG), F.lit("")), F.nullif(part(_DESCRIPTION), F.lit("")), F.nullif(X.entities(F.regexp_replace(part(_FIRST_P), "<[^>]*>", "")), F.lit("")), "plain", F.lit(""))


@query(f"""
WITH p AS (SELECT {S.url_key('url')} AS key, arg_max(substr({S.squeezed(_DESCRIBED)}, 1, 300), {{'a': fetched_at, 'b': extract_id}}) AS text FROM extractions WHERE url IS NOT NULL GROUP BY 1),
s AS (SELECT result_id, snippet, {S.url_key('url')} AS key FROM search_results)
SELECT result_id, CASE WHEN length(coalesce(snippet, '')) < 60 AND length(text) >= 60 THEN text ELSE snippet END AS snippet FROM s LEFT JOIN p USING (key)""")
def enriched_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets under 60 characters replaced by what the page says of itself where it was fetched: its description, else its first paragraph, else its text."""
    e = L.table(spark, d, "extractions").where("url is not null").withColumn("text", F.substring(squeeze(_described()), 1, 300))
    p = U.with_address(e).groupBy("key").agg(F.max_by("text", F.struct("fetched_at", "extract_id")).alias("text"))
    s = U.with_address(L.table(spark, d, "search_results").select("result_id", "snippet", "url")).select("result_id", "snippet", "key")
    new = F.when((F.length(F.coalesce("snippet", F.lit(""))) < 60) & (F.length("text") >= 60), F.col("text")).otherwise(F.col("snippet"))
    return salted_join(s, p, ["key"], by="result_id", how="left").select("result_id", new.alias("snippet"))


#: Words of page furniture that good extraction leaves out.
_FURNITURE = "(?i)cookie|©|newsletter|privacy|隐私|版权|impressum|mentions légales|aviso legal"


@query(f"""
WITH t AS (SELECT title, unnest([{{'strategy': 'stored', 'text': plain}}, {{'strategy': 'patterns', 'text': {_squeezed(_ENT.format(_BARE))}}}, {{'strategy': 'first paragraph', 'text': nullif({_ENT.format(f'regexp_replace({_meta(_FIRST_P)}, {chr(39)}<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '')}}], recursive := true) FROM extractions)
SELECT strategy, count(*) AS pages, count_if(text IS NOT NULL) AS answered, count_if(contains(lower(text), {_heading("coalesce(title, '')")})) AS titled, count_if(regexp_matches(text, '{_FURNITURE}')) AS with_furniture, round(avg(length(text)), 4) AS mean_chars FROM t GROUP BY strategy""")
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    """Three ways of extraction side by side: pages answered, with their title kept, and with words of furniture left in."""
    html = F.coalesce("html", F.lit(""))
    first = F.nullif(X.entities(F.regexp_replace(F.regexp_extract(html, _FIRST_P, 1), "<[^>]*>", "")), F.lit(""))
    ways = {"stored": F.col("plain"), "patterns": X.text_by_patterns(F.col("html")), "first paragraph": first}
    t = L.table(spark, d, "extractions").select("title", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), c.alias("text")) for k, c in ways.items()])).alias("x")).select("title", "x.*")
    title = X.normal_heading(F.coalesce("title", F.lit("")))
    return t.groupBy("strategy").agg(F.count(F.lit(1)).alias("pages"), F.count("text").alias("answered"), F.count_if(F.contains(F.lower("text"), title)).alias("titled"), F.count_if(F.col("text").rlike(_FURNITURE)).alias("with_furniture"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query(f"""
WITH k AS (SELECT extract_id, url, html, plain, via, CASE WHEN html IS NOT NULL THEN 'text/html' ELSE 'text/plain' END AS kind FROM extractions)
SELECT extract_id, CASE WHEN NOT {S.valid('url')} THEN 'invalid address' WHEN kind = 'text/html' AND coalesce(plain, html) = '' THEN 'empty' WHEN kind = 'text/html' THEN 'page' WHEN regexp_matches(plain, '^\\s*<') THEN 'page' WHEN plain = '' THEN 'empty' ELSE 'text' END AS route,
       CASE WHEN NOT {S.valid('url')} THEN NULL ELSE '# ' || {S.host('url')} || chr(10) || chr(10) || 'URL: ' || url END AS head FROM k""")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """What a fetch does with each answer: pages go to the extraction, text passes, empty ones get a note; addresses must be http or https."""
    url, host = F.col("url"), U.host(F.col("url"))
    html = F.col("html").isNotNull()
    route = F.when(~U.is_valid_url(url), "invalid address").when(html & (F.coalesce("plain", "html") == ""), "empty").when(html | F.col("plain").rlike(r"^\s*<"), "page").when(F.col("plain") == "", "empty").otherwise("text")
    head = F.when(U.is_valid_url(url), F.concat(F.lit("# "), host, F.lit("\n\nURL: "), url))
    return L.table(spark, d, "extractions").select("extract_id", route.alias("route"), head.alias("head"))


@query("""
SELECT extract_id, replace(plain, chr(0), '') AS text FROM extractions WHERE plain IS NOT NULL""")
def decoded_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each text as the bytes of an answer that names UTF-8, decoded again by the reader of bodies."""
    bodies = L.table(spark, d, "extractions").where("plain is not null").select("extract_id", F.encode("plain", "UTF-8").alias("body"), F.lit("utf-8").alias("charset"))
    return X.decoded(bodies)


@query(r"""
SELECT extract_id, coalesce(nullif(trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')), ''), '') AS document_title, len(regexp_extract_all(coalesce(html, ''), '(?i)<(?:script|style|noscript|iframe|svg|canvas|form|button|input|select|textarea)[\s>/]')) AS stripped FROM extractions""")
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    """The document title of each page, and how many elements go before anything else is read."""
    html = F.coalesce("html", F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    gone = F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<(?:script|style|noscript|iframe|svg|canvas|form|button|input|select|textarea)[\s>/])"), F.lit(1)))
    return L.table(spark, d, "extractions").select("extract_id", title.alias("document_title"), gone.cast("bigint").alias("stripped"))


@query()
def page_content(spark: SparkSession, d: str) -> DataFrame:
    """Title, text, markdown and the way taken of each page, by the parser (tested on small pages)."""
    return X.extracted(L.table(spark, d, "extractions"))


@query("""
SELECT extract_id, len(regexp_extract_all(html, '(?i)<a\\s')) AS links, len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS headings, len(regexp_extract_all(html, '(?i)<li[ >]')) AS items,
       len(regexp_extract_all(html, '(?i)<tr[ >]')) AS table_rows, len(regexp_extract_all(html, '(?i)<pre[ >]')) AS code_blocks FROM extractions WHERE html IS NOT NULL""")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(f"(?i)({p})"), F.lit(1))).cast("bigint")
    return L.table(spark, d, "extractions").where("html is not null").select("extract_id", n(r"<a\s").alias("links"), n("<h[1-6][ >]").alias("headings"), n("<li[ >]").alias("items"), n("<tr[ >]").alias("table_rows"), n("<pre[ >]").alias("code_blocks"))

