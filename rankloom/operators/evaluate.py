"""Evaluation of rankings: metrics of each query, their means by language, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.constants import AGGREGATOR_HOSTS, JUNK_TLDS

#: Ranks that the metrics look at.
K = 5


def is_gold(host: Column, gold: Column) -> Column:
    """True if the host is one of the gold hosts or below one; null gold has none."""
    return F.coalesce(F.exists(gold, lambda g: (host == F.lower(g)) | F.endswith(host, F.concat(F.lit("."), F.lower(g)))), F.lit(False))


def is_junk(host: Column, actions: Column | None = None) -> Column:
    """True for hosts of junk top-level domains, and for those that a rule removes (``actions``: the rules' actions for the host, or null)."""
    junk = host.rlike("(" + "|".join(t.replace(".", r"\.") for t in JUNK_TLDS) + ")$")
    return junk if actions is None else junk | F.coalesce(F.array_contains(actions, F.lit("remove")), F.lit(False))


def is_aggregator(url: Column) -> Column:
    return url.rlike(f"(?i){AGGREGATOR_HOSTS}")


def metrics(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``: hits, MRR, precision, nDCG over the first K ranks, and snippet counts.

    ``ranked`` has ``rank``, ``is_gold``, ``junk``, ``aggregator``, ``chars`` (of the snippet) and ``coverage``. Precision
    divides by the smaller of K and the number of rows; the ideal of nDCG has as many gold rows as were
    found. One aggregation with map-side combination; nothing is gathered by query.
    """
    top = F.col("rank") <= K
    gold = F.col("is_gold")
    length = F.col("chars")
    hit = lambda k: F.max(F.when(gold & (F.col("rank") <= k), 1).otherwise(0))
    agg = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        hit(1).alias("hit1"),
        hit(3).alias("hit3"),
        hit(5).alias("hit5"),
        F.coalesce(1 / F.min(F.when(gold, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(gold & top, 1).otherwise(0)).alias("found"),
        F.sum(F.when(gold & top, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("junk") & top, 1).otherwise(0)).alias("junk"),
        F.sum(F.when(F.col("aggregator") & top, 1).otherwise(0)).alias("aggregator"),
        F.sum(F.when(top & (length == 0), 1).otherwise(0)).alias("snip_empty"),
        F.sum(F.when(top & (length < 40), 1).otherwise(0)).alias("snip_short"),
        F.sum(F.when(top, length).otherwise(0)).alias("snip_chars"),
        F.max("coverage").alias("best_coverage"),
    )
    shown = F.least("n", F.lit(K))
    ideal = F.aggregate(F.when(F.col("found") > 0, F.sequence(F.lit(1), F.col("found").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    r = agg.withColumn("p5", F.col("found") / F.greatest(F.lit(1), shown)).withColumn("ndcg5", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0))
    return r.withColumn("shown", shown).drop("dcg", "found")


def summary(by_query: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Means over the queries, by language and overall ('all') in one pass of grouping sets; snippet rates are over rows."""
    own = groups or []
    cols = [*own, "lang"]
    sets = F.grouping("lang")
    r = by_query.withColumn("lang", F.coalesce("lang", F.lit("(none)"))).groupingSets([cols, own], *cols).agg(
        sets.alias("g"),
        F.count(F.lit(1)).alias("queries"),
        *[F.round(F.avg(c), 4).alias(c) for c in ("hit1", "hit3", "hit5", "mrr", "p5", "ndcg5")],
        F.round(F.avg("junk"), 3).alias("junk"),
        F.round(F.sum("snip_empty") / F.greatest(F.sum("shown"), F.lit(1)), 4).alias("snip_empty_rate"),
        F.round(F.sum("snip_short") / F.greatest(F.sum("shown"), F.lit(1)), 4).alias("snip_short_rate"),
    )
    return r.withColumn("lang", F.when(F.col("g") == 1, "all").otherwise(F.col("lang"))).drop("g")


def compared(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.005) -> DataFrame:
    """Queries whose nDCG differs by ``least`` or more between two runs: ``ndcg5_a``, ``ndcg5_b``, ``delta``."""
    both = a.select(*keys, F.col("ndcg5").alias("ndcg5_a")).join(b.select(*keys, F.col("ndcg5").alias("ndcg5_b")), keys)
    return both.withColumn("delta", F.col("ndcg5_b") - F.col("ndcg5_a")).where(F.abs("delta") >= least)
