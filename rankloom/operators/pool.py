"""Pools of candidate rows: filters, host rules, engine ranks, merges.

Every function takes and returns DataFrames with one row for each candidate of each query, so a batch of
queries is one plan. Shuffles are on the pool. A pool is one capture of
one query: its size is bounded by what the engines return at once, also for a query that is captured again
and again and holds a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.constants import AGGREGATOR_HOSTS
from rankloom.functions.text import jaccard, split_sources, word_set
from rankloom.functions.urls import host_suffixes, with_address
from rankloom.plans.durable import cut
from rankloom.plans.skew import bounded, salted_join

#: Titles of two rows that are more alike than this are one page.
SAME_TITLE = 0.85


def clean_rules(rules: DataFrame) -> DataFrame:
    """``domain``, ``kind``, ``action``, ``ord``: rules trimmed, in lower case, without repeats (the first order wins).

    The leading dot of '.tld' and '*.' of '*.sub' are cut off; null and blank rules are dropped.
    """
    rule = F.lower(F.trim("rule"))
    kind = F.when(F.startswith(rule, F.lit(".")), "tld").when(F.startswith(rule, F.lit("*.")), "sub").otherwise("domain")
    bare = F.regexp_replace(rule, r"^\*?\.", "")
    own = rules.where(F.coalesce(rule, F.lit("")) != "").select(bare.alias("domain"), kind.alias("kind"), "action", "ord")
    return own.groupBy("domain", "kind", "action").agg(F.min("ord").alias("ord"))


def match_rules(hosts: DataFrame, rules: DataFrame, key: str = "host") -> DataFrame:
    """``key`` of each distinct host with the ``actions`` of all rules that match it and, as ``bare_actions``, of those that match
    it without its ``www.`` (hosts without a match don't appear).

    A domain rule matches the host itself and its subdomains, a 'sub' rule only subdomains, a 'tld' rule any
    host that ends with it, with or without the dot. Hosts are expanded into their parent domains and, for
    'tld' rules, into all their endings, so that one hash join on equality matches all kinds; the aggregation
    keeps the partitioning of the distinct hosts.
    """
    h = F.col(key)
    r = bounded(clean_rules(rules).select(F.struct("domain", (F.col("kind") == "tld").alias("end")).alias("_rule"), "kind", "action"), of=rules)
    distinct = hosts.select(key).where(h != "").distinct()
    parents = F.transform(host_suffixes(h), lambda x: F.struct(x.alias("domain"), F.lit(False).alias("end")))
    # a 'tld' rule may end inside a label
    ends = F.transform(F.sequence(F.lit(1), F.length(h)), lambda k: F.struct(F.substring(h, -k, k).alias("domain"), F.lit(True).alias("end")))
    found = distinct.select(key, F.explode(F.concat(parents, ends)).alias("_rule")).join(r, "_rule")
    own, bare = F.length(h), F.length(h) - F.when(F.startswith(h, F.lit("www.")), 4).otherwise(0)
    n = F.length("_rule.domain")
    fits = lambda size: F.when(F.col("kind") == "sub", n < size).otherwise(n <= size)
    return found.groupBy(key).agg(F.collect_set(F.when(fits(own), F.col("action"))).alias("actions"), F.collect_set(F.when(fits(bare), F.col("action"))).alias("bare_actions")).where(F.size("actions") > 0)


def kept(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates that stay: valid address, no picture or video list, host not removed.

    Adds ``host``, ``domain`` (without ``www.``), ``key``, ``lower`` (the host ranks lower), ``acts`` (the rules' actions for the domain) and ``sources``.
    """
    rows = with_address(results).where("host <> ''")
    rows = rows.where(~F.col("url").rlike(f"(?i){AGGREGATOR_HOSTS}") & ~F.coalesce(F.col("title"), F.lit("")).rlike("百度图片|视频大全"))
    hosts = cut(with_address(results.select("url")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("_n")))
    joined = salted_join(rows, match_rules(hosts, rules), ["host"], by="result_id", how="left", counts=hosts)
    has = lambda a: F.coalesce(F.array_contains("actions", F.lit(a)), F.lit(False))
    return joined.where(~has("remove")).withColumn("lower", has("lower")).withColumn("sources", split_sources(F.col("source"))).withColumn("acts", F.coalesce("bare_actions", F.array().cast("array<string>"))).drop("actions", "bare_actions")


def with_engine_ranks(rows: DataFrame, order: str = "idx") -> DataFrame:
    """One row for each candidate and engine with the candidate's ``rank`` within the engine's rows of the query."""
    each = rows.select("*", F.explode("sources").alias("engine"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("pool", "engine").orderBy(order)))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``idx``, the candidate's place in its query by capture position and id, from 0."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("pool").orderBy("pos", "result_id")) - 1)


def merged_by_key(rows: DataFrame) -> DataFrame:
    """One row for each query and address key.

    The first row gives title and url; the engines are united in order of appearance, each with its best
    rank; ``snippet`` is the longest one, the earliest among equals; ``first_idx`` is the first place. Rows
    that are partitioned by pool stay so: there is no shuffle and no join.
    """
    each = rows.select("pool", "key", "idx", "title", "url", "host", "domain", "acts", "lower", "snippet", F.posexplode_outer("sources").alias("nth", "engine"))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("pool", "engine").orderBy("idx", "nth")))
    size = F.length(F.coalesce("snippet", F.lit("")))
    by_engine = each.groupBy("pool", "key", "engine").agg(
        F.min("rank").alias("rank"),
        F.min("idx").alias("seen"),
        F.min_by(F.struct("title", "url", "host", "domain", "acts", "lower"), "idx").alias("f"),
        F.max_by(F.struct(size.alias("size"), (-F.col("idx")).alias("place"), "snippet"), F.struct(size, -F.col("idx"))).alias("s"),
        F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("n_rows"),
    )
    one = by_engine.groupBy("pool", "key").agg(
        F.min_by("f", "seen").alias("f"),
        F.max_by("s", F.struct("s.size", "s.place"))["snippet"].alias("snippet"),
        F.min("seen").alias("first_idx"),
        F.sum("n_rows").alias("n_rows"),
        F.array_sort(F.collect_list(F.when(F.col("engine").isNotNull(), F.struct("seen", "engine", "rank")))).alias("engines"),
    )
    return one.select("pool", "key", "f.*", "snippet", "first_idx", "n_rows", "engines")


def merged_by_title(rows: DataFrame) -> DataFrame:
    """Rows of a query whose titles are alike joined to the first such row, in order and not transitively.

    A row joins the first kept row whose title's word set it is more than SAME_TITLE like; the kept row's
    title stays. Each query's fold runs over its merged rows, not over its captures. Rows that are
    partitioned by pool stay so: there is no shuffle and no join.
    """
    carried = ["title", "url", "host", "domain", "acts", "lower", "snippet", "n_rows", "engines"]
    pools = rows.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("first_idx", "key", word_set(F.col("title")).alias("words"), F.struct(*carried).alias("row")))).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        like = F.filter(acc, lambda h: jaccard(h["words"], x["words"]) > SAME_TITLE)
        return F.when(F.size(like) > 0, acc).otherwise(F.concat(acc, F.array(F.struct(x["key"].alias("key"), x["words"].alias("words")))))

    start = F.array().cast("array<struct<key:string,words:array<string>>>")
    # the first kept row that is like a row was kept before it, or is the row itself
    heads = F.aggregate("items", start, step)
    head_of = lambda x: F.coalesce(F.get(F.filter(F.col("heads"), lambda h: (h["key"] == x["key"]) | (jaccard(h["words"], x["words"]) > SAME_TITLE)), F.lit(0))["key"], x["key"])
    both = pools.withColumn("heads", heads).select("pool", F.explode(F.transform("items", lambda x: F.struct(head_of(x).alias("head"), x["first_idx"].alias("first_idx"), x["key"].alias("key"), x["row"].alias("row")))).alias("x"))
    each = both.select("pool", "x.head", "x.first_idx", "x.row", F.posexplode_outer("x.row.engines").alias("nth", "e"))
    size = F.length(F.coalesce("row.snippet", F.lit("")))
    best = each.groupBy("pool", "head", "e.engine").agg(
        F.min("e.rank").alias("rank"),
        F.min(F.struct("first_idx", "e.seen")).alias("seen"),
        F.min_by(F.struct("row.title", "row.url", "row.host", "row.domain", "row.acts", "row.lower"), "first_idx").alias("f"),
        F.max_by(F.struct(size.alias("size"), (-F.col("first_idx")).alias("place"), F.col("row.snippet").alias("snippet")), F.struct(size, -F.col("first_idx"))).alias("s"),
        F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("row.n_rows")).otherwise(0)).alias("n_rows"),
        F.min("first_idx").alias("first_idx"),
    )
    one = best.groupBy("pool", "head").agg(
        F.min_by("f", "first_idx").alias("f"),
        F.max_by("s", F.struct("s.size", "s.place"))["snippet"].alias("snippet"),
        F.min("first_idx").alias("first_idx"),
        F.sum("n_rows").alias("n_rows"),
        F.array_sort(F.collect_list(F.when(F.col("engine").isNotNull(), F.struct("seen", "engine", "rank")))).alias("engines"),
    )
    return one.select("pool", F.col("head").alias("key"), "f.*", "snippet", "first_idx", "n_rows", "engines")
