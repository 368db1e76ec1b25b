"""The tables of the project as pools, and the whole ranking pipeline over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import clean_query, query_language
from rankloom.operators import pool as P
from rankloom.operators import rank as R
from rankloom.plans.durable import cut
from rankloom.plans.skew import salted_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool_id(df: DataFrame) -> DataFrame:
    """Adds ``pool``: the query and the minute of the capture, or of the ingestion where that is null.

    Rows without either time belong to no capture: 64 neighbouring result_ids make a pool, so that no pool gathers them all.
    """
    minute = F.floor(F.unix_timestamp(F.coalesce("captured_at", "ingested_at")) / 60)
    timeless = F.lit(90_000_000) + F.pmod(F.floor(F.col("result_id") / 64), F.lit(10_000_000))
    return df.withColumn("pool", (F.col("query_id") * 100_000_000 + F.coalesce(minute, timeless)).cast("bigint"))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with ``pool``; rows without a query belong to none."""
    return pool_id(table(spark, sf_dir, "search_results").where("query_id is not null"))


def queries_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id``, ``q`` cleaned, ``lang`` as labelled, ``route`` (cn or en), ``gold``."""
    q = table(spark, sf_dir, "queries")
    return q.select("query_id", clean_query(F.col("q")).alias("q"), "lang", query_language(clean_query(F.col("q"))).alias("route"), "gold")


def kept_rows(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Candidates after the filters, numbered within their pool, by which they are partitioned; of ``raw`` rows with a pool, else of all captured ones."""
    raw = (captured(spark, sf_dir) if raw is None else raw).select("result_id", "query_id", "pool", "pos", "title", "url", "snippet", "source")
    return P.numbered(P.kept(raw, table(spark, sf_dir, "domain_rules")))


def query_of_pools(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """``pool``, ``query_id``, ``q``, ``lang``, ``gold`` of each pool whose query is known; a query may have very many pools."""
    pools = cut((captured(spark, sf_dir) if raw is None else raw).select("pool", "query_id").distinct())
    return salted_join(pools, queries_clean(spark, sf_dir).drop("route"), ["query_id"], by="pool")


def with_query(rows: DataFrame, spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Adds ``query_id``, ``q``, ``lang`` and ``gold`` to rows that are partitioned by pool, and stay so."""
    return rows.drop("query_id").join(query_of_pools(spark, sf_dir, raw), "pool")


def merged_rows(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Candidates merged by address and by title."""
    return P.merged_by_title(P.merged_by_key(kept_rows(spark, sf_dir, raw)))


def signals(spark: SparkSession, sf_dir: str, config: R.RankConfig = R.DEFAULT, with_bm25: bool = False, with_qualities: bool = False, raw: DataFrame | None = None) -> DataFrame:
    """Merged candidates with every signal the score is made of. From the numbering on, all stages keep the partitioning by pool."""
    rows = R.with_coverage(with_query(merged_rows(spark, sf_dir, raw), spark, sf_dir, raw))
    rows = R.with_bm25(rows) if with_bm25 else rows.withColumn("bm25", F.lit(0.0))
    if with_qualities or config.quality_power:
        rows = R.with_qualities(rows)
    rows = R.with_echo(R.with_host_signals(rows, config))
    return R.with_rrf(rows, config.rrf_k, config.engine_weighted, config.quality_power).withColumn("echo", R.echo_penalty(config))


def ranking(spark: SparkSession, sf_dir: str, config: R.RankConfig = R.DEFAULT, raw: DataFrame | None = None) -> DataFrame:
    """The whole pipeline: merged, scored, floored and ranked candidates of every pool."""
    rows = signals(spark, sf_dir, config, with_bm25=config.w_bm25 != 0 or config.mode == "legacy", raw=raw)
    rows = rows.withColumn("final_score", R.legacy_score() if config.mode == "legacy" else R.fused_score(config))
    return R.ranked(R.coverage_floor(rows, config))
