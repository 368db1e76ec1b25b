"""The three tools over stored tables: search, site search and fetch, with their limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import urls as U
from rankloom.functions.text import clean_query, round_half_up
from rankloom.operators import extract as X
from rankloom.plans import pools as L

#: Rows of an answer and characters of a page, at most and where the caller doesn't say.
MOST_ROWS, ROWS = 10, 5
MOST_CHARS, CHARS = 50_000, 8_000


def clamped(n: int | None, least: int, most: int, default: int) -> int:
    return default if n is None else max(least, min(most, int(n)))


def search(spark: SparkSession, tables: str, text: str, n: int | None = None) -> DataFrame:
    """The latest ranked answer to a query: ``rank``, title, url, snippet, score; 1 to MOST_ROWS rows. A text that is empty once cleaned raises ValueError."""
    cleaned = clean_query(F.lit(text))
    if not spark.range(1).select(cleaned.alias("q")).first().q:
        raise ValueError("empty query")
    asked = L.queries_clean(spark, tables).where(F.col("q") == cleaned).select("query_id")
    raw = L.captured(spark, tables).join(F.broadcast(asked), "query_id", "left_semi")  # the same text under several ids
    last = raw.agg(F.max("pool").alias("pool"))
    own = L.ranking(spark, tables, raw=raw.join(F.broadcast(last), "pool", "left_semi"))
    return own.where(F.col("rank") <= clamped(n, 1, MOST_ROWS, ROWS)).select("rank", "title", "url", "snippet", round_half_up(F.col("final_score"), 4).alias("score")).orderBy("rank")


def site(spark: SparkSession, tables: str, domain: str, text: str, n: int | None = None) -> DataFrame:
    """Captured pages of a domain for a query, each address once: ``rank``, title, url, snippet; 1 to MOST_ROWS rows."""
    asked = L.queries_clean(spark, tables).where(F.col("q") == clean_query(F.lit(text))).select("query_id")
    rows = U.with_address(L.captured(spark, tables).join(F.broadcast(asked), "query_id", "left_semi"))
    dom = U.normalize_domain(F.lit(domain))
    own = rows.where((F.col("host") == dom) | F.endswith("host", F.concat(F.lit("."), dom)))
    first = own.groupBy("key").agg(F.min_by(F.struct("title", "url", "snippet"), F.struct("pos", "result_id")).alias("x"), F.min(F.struct("pos", "result_id")).alias("o"))
    top = first.orderBy("o").limit(clamped(n, 1, MOST_ROWS, ROWS))  # the answer's length is the feature
    return top.select(F.col("o.pos").alias("pos"), "x.*")


def fetch(spark: SparkSession, tables: str, url: str, length: int | None = None) -> DataFrame:
    """The latest fetch of a page as Markdown under its title and address, cut after ``length`` (1 to MOST_CHARS) characters: ``answer``."""
    key = U.url_key(F.lit(url))
    pages = U.with_address(L.table(spark, tables, "extractions").where("html is not null")).where(F.col("key") == key)
    last = pages.orderBy(F.col("fetched_at").desc(), F.col("extract_id").desc()).limit(1).select("extract_id", "html", "url")
    page = X.extracted(last)
    content = X.without_title(X.truncated(X.answer(F.col("markdown"), F.col("via")), clamped(length, 1, MOST_CHARS, CHARS)), F.col("title"))
    return page.select(X.envelope(F.col("title"), F.lit(url), content).alias("answer"))


def status(spark: SparkSession, tables: str) -> DataFrame:
    """Rows and pools of each engine in the captured tables."""
    from rankloom.catalog.ranking import engine_stats

    return engine_stats(spark, tables).orderBy("engine")
