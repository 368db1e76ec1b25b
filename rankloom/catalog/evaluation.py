"""Queries of the evaluation: metrics, means, comparison, grids of configurations, strategies, reranking."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.catalog.ranking import _FIELDS
from rankloom.functions.text import coverage
from rankloom.functions.urls import bare_host
from rankloom.operators import evaluate as E
from rankloom.operators import rank as R
from rankloom.plans import pools as L
from rankloom.plans import sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flagged(rows: DataFrame) -> DataFrame:
    """Adds what the metrics need to ranked rows with ``gold``."""
    return rows.withColumn("is_gold", E.is_gold(bare_host(F.col("url")), F.col("gold"))).withColumn("junk", E.is_junk(bare_host(F.col("url")))).withColumn("aggregator", E.is_aggregator(F.col("url"))).withColumn("chars", F.length(F.coalesce("snippet", F.lit(""))))


_JUNK = "({})$".format("|".join(t.replace(".", r"\.") for t in E.JUNK_TLDS))
_DOMAIN = f"regexp_replace({S.host('url')}, '^www\\.', '')"
_GOLD = f"coalesce(len(list_filter(gold, lambda g: {_DOMAIN} = lower(g) OR {_DOMAIN} LIKE '%.' || lower(g))) > 0, false)"


def _metrics_sql(source: str, keys: str) -> str:
    return f"""
flags_{source} AS (SELECT *, {_GOLD} AS is_gold, regexp_matches({_DOMAIN}, '{_JUNK}') AS junk, length(coalesce(snippet, '')) AS chars FROM {source}),
agg_{source} AS (
  SELECT {keys}, count(*) AS n, max((is_gold AND rank <= 1)::INT) AS hit1, max((is_gold AND rank <= 3)::INT) AS hit3, max((is_gold AND rank <= 5)::INT) AS hit5,
         coalesce(1.0::DOUBLE / min(CASE WHEN is_gold THEN rank END), 0.0) AS mrr, count_if(is_gold AND rank <= 5) AS found, sum(CASE WHEN is_gold AND rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0 END) AS dcg,
         count_if(junk AND rank <= 5) AS junk, count_if(rank <= 5 AND chars = 0) AS snip_empty, count_if(rank <= 5 AND chars < 40) AS snip_short, sum(CASE WHEN rank <= 5 THEN chars ELSE 0 END)::BIGINT AS snip_chars
  FROM flags_{source} GROUP BY ALL),
metrics_{source} AS (
  SELECT * EXCLUDE (dcg, found), least(n, 5) AS shown, found::DOUBLE / greatest(1, least(n, 5)) AS p5,
         CASE WHEN found > 0 THEN dcg / list_sum(list_transform(range(1, (found + 1)::BIGINT), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0.0 END AS ndcg5 FROM agg_{source})"""


_SUMMARY = """coalesce(lang, '(none)') AS lang"""
_MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("hit1", "hit3", "hit5", "mrr", "p5", "ndcg5"))


def _by_query(spark: SparkSession, d: str, config: R.RankConfig = R.DEFAULT) -> DataFrame:
    return E.metrics(flagged(L.ranking(spark, d, config)), ["pool", "query_id", "lang"])


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_metrics_sql('ranking', 'pool, query_id, lang')}
SELECT pool, query_id, lang, n, hit1, hit3, hit5, round(mrr, 6) AS mrr, round(p5, 6) AS p5, round(ndcg5, 6) AS ndcg5, junk, snip_empty, snip_short, snip_chars FROM metrics_ranking""")
def metrics_by_query(spark: SparkSession, d: str) -> DataFrame:
    m = _by_query(spark, d)
    return m.select("pool", "query_id", "lang", "n", "hit1", "hit3", "hit5", *[F.round(c, 6).alias(c) for c in ("mrr", "p5", "ndcg5")], "junk", "snip_empty", "snip_short", "snip_chars")


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_metrics_sql('ranking', 'pool, query_id, lang')}, named AS (SELECT * REPLACE (coalesce(lang, '(none)') AS lang) FROM metrics_ranking)
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS queries, {_MEANS}, round(avg(junk), 3) AS junk,
       round(sum(snip_empty)::DOUBLE / greatest(sum(shown), 1), 4) AS snip_empty_rate, round(sum(snip_short)::DOUBLE / greatest(sum(shown), 1), 4) AS snip_short_rate
FROM named GROUP BY GROUPING SETS ((lang), ())""")
def metrics_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(_by_query(spark, d))


#: The run without host signals, against which the ranking is compared.
PLAIN = R.RankConfig(w_authority=0.0, w_tutorial=0.0, w_mirror=0.0, w_homepage=0.0)

_PLAIN_SQL = """
plain_scores AS (SELECT *, rrf - 0.15 * lower_host::INT - 0.40 * echo AS score FROM scored),
plain_floor AS (SELECT *, max(coverage) OVER (PARTITION BY pool) AS best, sum((coverage >= 0.12)::INT) OVER (PARTITION BY pool) AS left_ FROM plain_scores QUALIFY best < 0.40 OR coverage >= 0.12 OR left_ = 0),
plain AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, first_idx) AS rank FROM plain_floor)"""


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_PLAIN_SQL}, {_metrics_sql('ranking', 'pool, query_id, lang')}, {_metrics_sql('plain', 'pool, query_id, lang')}
SELECT a.pool, round(a.ndcg5, 6) AS ndcg5_a, round(b.ndcg5, 6) AS ndcg5_b, round(b.ndcg5 - a.ndcg5, 6) AS delta FROM metrics_plain a JOIN metrics_ranking b USING (pool) WHERE abs(b.ndcg5 - a.ndcg5) >= 0.005""")
def run_compare(spark: SparkSession, d: str) -> DataFrame:
    both = _grid(spark, d, [("a", PLAIN), ("b", R.DEFAULT)])
    one = both.groupBy("pool").agg(*[F.max(F.when(F.col("config") == x, F.col("ndcg5"))).alias(f"ndcg5_{x}") for x in "ab"])
    c = one.withColumn("delta", F.col("ndcg5_b") - F.col("ndcg5_a")).where(F.abs("delta") >= 0.005)
    return c.select("pool", *[F.round(x, 6).alias(x) for x in ("ndcg5_a", "ndcg5_b", "delta")])


#: The joint grid of three weights.
GRID = [(a, b, c) for a in (1.0, 0.8, 0.6, 0.4, 0.2, 0.0) for b in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0) for c in (0.0, 0.2, 0.4)]
PENALTIES = [(e, p) for e in (0.0, 0.15, 0.25, 0.4, 0.6, 0.8) for p in (0.0, 0.1, 0.15, 0.3)]
FLOORS = (0.12, 0.2, 0.25, 0.3, 0.4, 0.5)


#: What the configurations of a grid need of each row.
SIGNALS = ["pool", "query_id", "lang", "first_idx", "engines", "lower", "coverage", "bm25", "authority", "tutorial", "mirror", "homepage", "host_n", "listed", "echo_share", "pool_coverage", "pool_authority", "is_gold", "junk", "aggregator", "chars"]


def _ranked_grid(spark: SparkSession, d: str, settings: list[tuple[str, R.RankConfig]]) -> DataFrame:
    """Ranked rows of all configurations in one job: the list of configurations crosses the signals, which are made once.

    What differs by pool only (the normalised fusion of each setting, the best of the pool) is made before the
    crossing, so that crossed rows are sorted once, for their rank, and never shuffled.
    """
    fusions = list(dict.fromkeys((c.rrf_k, c.engine_weighted, c.quality_power) for _, c in settings))
    rows = R.with_pool_best(flagged(L.signals(spark, d, with_bm25=any(c.w_bm25 or c.mode == "legacy" for _, c in settings), with_qualities=any(p for *_, p in fusions))))
    pool = Window.partitionBy("pool")
    for k, x in enumerate(fusions):
        rows = rows.withColumn(f"_raw{k}", R.rrf_raw(*x))
    rows = rows.select(*SIGNALS, F.array(*[F.col(f"_raw{k}") / F.greatest(F.max(f"_raw{k}").over(pool), F.lit(1e-9)) for k in range(len(fusions))]).alias("fusions"))
    table = R.configs(spark, settings).withColumn("fusion", F.lit(None).cast("int"))
    for k, (n, w, p) in enumerate(fusions):
        table = table.withColumn("fusion", F.when((F.col("rrf_k") == n) & (F.col("engine_weighted") == w) & (F.col("quality_power") == p), k).otherwise(F.col("fusion")))
    crossed = rows.crossJoin(F.broadcast(table)).withColumn("rrf", F.get("fusions", F.col("fusion")))  # as many rows as the caller lists
    column = R.RankConfig(**{f.name: F.col(f.name) for f in fields(R.RankConfig)})
    kept = crossed.where(R.above_floor(column)).withColumn("echo", R.echo_penalty(column))
    score = F.when(F.col("mode") == "legacy", R.legacy_score()).otherwise(R.fused_score(column))
    return R.ranked(kept.withColumn("final_score", score), by=["config", "pool"])


def _grid(spark: SparkSession, d: str, settings: list[tuple[str, R.RankConfig]]) -> DataFrame:
    """Metrics of each configuration and pool."""
    return E.metrics(_ranked_grid(spark, d, settings), ["config", "pool", "query_id", "lang"])


def _means(m: DataFrame) -> DataFrame:
    return m.groupBy("config").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("hit1", "mrr", "ndcg5")])


def _grid_sql(table: str, score: str, floor: str = "0.12") -> str:
    return f"""
WITH RECURSIVE {S.SIGNALS}, {table},
g AS (SELECT *, {score} AS score FROM scored_bm, cfg),
gf AS (SELECT *, max(coverage) OVER (PARTITION BY config, pool) AS best, sum((coverage >= {floor} OR authority >= 0.9)::INT) OVER (PARTITION BY config, pool) AS left_ FROM g QUALIFY best < 0.40 OR coverage >= {floor} OR authority >= 0.9 OR left_ = 0),
grid AS (SELECT *, row_number() OVER (PARTITION BY config, pool ORDER BY score DESC, first_idx) AS rank FROM gf), {_metrics_sql('grid', 'config, pool, query_id, lang')}"""


_BASE = "- 0.40 * echo + 0.18 * authority - 0.08 * tutorial - 0.18 * mirror - 0.10 * homepage"
_MEANS3 = "config, count(*) AS queries, round(avg(hit1), 4) AS hit1, round(avg(mrr), 4) AS mrr, round(avg(ndcg5), 4) AS ndcg5"


@query(_grid_sql(
    f"scored_bm AS (SELECT * FROM scored), cfg AS (SELECT * FROM (VALUES {', '.join(f'''('echo={e} lower={p}', {e}::DOUBLE, {p}::DOUBLE)''' for e, p in PENALTIES)}) t(config, e, p))",
    "rrf - p * lower_host::INT - e * echo + 0.18 * authority - 0.08 * tutorial - 0.18 * mirror - 0.10 * homepage") + f" SELECT {_MEANS3} FROM metrics_grid GROUP BY config")
def penalty_grid(spark: SparkSession, d: str) -> DataFrame:
    return _means(_grid(spark, d, [(f"echo={e} lower={p}", R.RankConfig(echo_penalty=e, lower_penalty=p)) for e, p in PENALTIES]))


@query(_grid_sql(
    f"scored_bm AS (SELECT * FROM scored), cfg AS (SELECT * FROM (VALUES {', '.join(f'''('floor={x}', {x}::DOUBLE)''' for x in FLOORS)}) t(config, cf))", f"rrf - 0.15 * lower_host::INT {_BASE}", "cf") + f" SELECT {_MEANS3} FROM metrics_grid GROUP BY config")
def floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _means(_grid(spark, d, [(f"floor={x}", R.RankConfig(cov_floor=x)) for x in FLOORS]))


def _values(rows: list[tuple], names: str) -> str:
    """A table of configurations ``cfg``: a name and numbers."""
    return f"cfg AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) if isinstance(x, str) else f'{float(x)}::DOUBLE' for x in r) + ')' for r in rows)}) t(config, {names}))"


_WITH_BM = f"{_FIELDS}, scored_bm AS (SELECT s.*, coalesce(b.bm25, 0.0) AS bm25 FROM scored s LEFT JOIN bms b USING (pool, key))"
_MEANS_OF = f" SELECT {_MEANS3} FROM metrics_grid GROUP BY config"


@query(_grid_sql(f"{_WITH_BM}, {_values([(f'rrf={a} cov={b} bm25={c}', a, b, c) for a, b, c in GRID], 'a, b, c')}", f"a * rrf + b * coverage + c * bm25 - 0.15 * lower_host::INT {_BASE}") + _MEANS_OF)
def config_grid(spark: SparkSession, d: str) -> DataFrame:
    """The joint grid of 108 points over fusion, coverage and BM25."""
    return _means(_grid(spark, d, [(f"rrf={a} cov={b} bm25={c}", R.RankConfig(w_rrf=a, w_coverage=b, w_bm25=c)) for a, b, c in GRID]))


#: The points of the other grids.
BM25_GRID = [(b, a) for b in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0) for a in (0.4, 0.6, 0.8, 1.0)]
WEIGHTS = [(a, w) for a in (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0) for w in (False, True)]
RRF_KS = (10.0, 20.0, 40.0, 60.0, 100.0)
POWERS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
RERANK_WEIGHTS = (0.0, 0.2, 0.35, 0.5, 0.7, 1.0)


@query(_grid_sql(f"{_WITH_BM}, {_values([(f'bm25={b} rrf={a}', b, a) for b, a in BM25_GRID], 'b, a')}", f"a * rrf + b * bm25 - 0.15 * lower_host::INT {_BASE}") + _MEANS_OF)
def bm25_grid(spark: SparkSession, d: str) -> DataFrame:
    """Weights of BM25 against those of the fusion."""
    return _means(_grid(spark, d, [(f"bm25={b} rrf={a}", R.RankConfig(w_bm25=b, w_rrf=a)) for b, a in BM25_GRID]))


def _fused_sql(weight: str, k: str, join: str = "") -> str:
    """Fusion by configuration in SQL: ``rrf_c`` of each row, relative to the best of its pool."""
    return f"""
scored_bm AS (
  SELECT s.*, c.*, s.raw_c / greatest(max(s.raw_c) OVER (PARTITION BY c.config, s.pool), 1e-9) AS rrf_c
  FROM (SELECT f.config AS config_, f.raw_c, t.* EXCLUDE (rrf) FROM (
          SELECT c.config, e.pool, e.key, coalesce(sum(({weight}) / ({k} + e.rank)), 0.0) AS raw_c
          FROM (SELECT pool, key, unnest(CASE WHEN len(engines) > 0 THEN engines ELSE [NULL] END, recursive := true) FROM scored) e CROSS JOIN cfg c {join} GROUP BY ALL) f JOIN scored t USING (pool, key)) s JOIN cfg c ON c.config = s.config_)"""


def _fused_grid_sql(cfg: str, weight: str, k: str, score: str, join: str = "", before: str = "") -> str:
    return _grid_sql(f"{before}{cfg}, {_fused_sql(weight, k, join)}", score).replace("FROM scored_bm, cfg", "FROM scored_bm")


@query(_fused_grid_sql(_values([(f"rrf={a} cov={round(1 - a, 2)} weighted={int(w)}", a, int(w)) for a, w in WEIGHTS], "a, w"), f"CASE WHEN c.w = 1 THEN {S.weight('e.engine')} ELSE 1.0 END", "20", "a * rrf_c + (1 - a) * coverage - 0.15 * lower_host::INT + 0.18 * authority - 0.08 * tutorial - 0.18 * mirror - 0.10 * homepage") + _MEANS_OF)
def weight_stage(spark: SparkSession, d: str) -> DataFrame:
    """First stage of the tuning: shares of fusion and coverage, with and without weights of the engines, no penalty for echoes."""
    return _means(_grid(spark, d, [_weight_point(a, w) for a, w in WEIGHTS]))


def _weight_point(a: float, w: bool) -> tuple[str, R.RankConfig]:
    return f"rrf={a} cov={round(1 - a, 2)} weighted={int(w)}", R.RankConfig(w_rrf=a, w_coverage=1 - a, engine_weighted=w, echo_penalty=0.0)


@query(_fused_grid_sql(_values([(f"k={k}", k) for k in RRF_KS], "k"), "1.0", "c.k", f"rrf_c - 0.15 * lower_host::INT {_BASE}") + _MEANS_OF)
def k_stage(spark: SparkSession, d: str) -> DataFrame:
    """Third stage of the tuning: the constant of the fusion."""
    return _means(_grid(spark, d, [(f"k={k}", R.RankConfig(rrf_k=k)) for k in RRF_KS]))


_QUALITIES = "qualities AS (SELECT pool, engine, greatest(avg(coverage), 0.01) AS quality FROM (SELECT pool, coverage, unnest(engines, recursive := true) FROM scored) GROUP BY ALL), "


@query(_fused_grid_sql(_values([(f"power={p}", p) for p in POWERS], "p"), "pow(quality, c.p)", "20", f"rrf_c - 0.15 * lower_host::INT {_BASE}", "LEFT JOIN qualities q ON q.pool = e.pool AND q.engine = e.engine", _QUALITIES) + _MEANS_OF)
def quality_power_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Engines weighted by how well their rows cover the query, to a power."""
    return _means(_grid(spark, d, [(f"power={p}", R.RankConfig(quality_power=p)) for p in POWERS]))


@query()
def tuned_config(spark: SparkSession, d: str) -> DataFrame:
    """The three stages one after another, each from the best point of the one before: ``stage``, ``config`` and its means.

    Each stage is one job; one row of it decides the next (the grids of the stages have SQL of their own).
    """
    order = [F.col("ndcg5").desc(), F.col("mrr").desc(), "config"]
    best, out = R.DEFAULT, []
    stages = [
        ("weights", lambda c: [_weight_point(a, w) for a, w in WEIGHTS]),
        ("penalties", lambda c: [(f"echo={e} lower={p}", replace(c, echo_penalty=e, lower_penalty=p)) for e, p in PENALTIES]),
        ("k", lambda c: [(f"k={k}", replace(c, rrf_k=k)) for k in RRF_KS]),
    ]
    for name, points in stages:
        settings = points(best)
        top = _means(_grid(spark, d, settings)).orderBy(*order).first()
        if top is not None:
            best = dict(settings)[top.config]
            out.append((name, *top))
    return spark.createDataFrame(out, "stage string, config string, queries bigint, hit1 double, mrr double, ndcg5 double")


@query(SQL["penalty_grid"].replace("SELECT config, count(*)", "SELECT row_number() OVER (ORDER BY round(avg(ndcg5), 4) DESC, round(avg(mrr), 4) DESC, config) AS place, config, count(*)"))
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The points of the penalty grid in order: nDCG, then MRR, then name (as many rows as the grid has points)."""
    means = penalty_grid(spark, d)
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.col("ndcg5").desc(), F.col("mrr").desc(), "config")).cast("bigint"))


_PASSAGE = "substr(coalesce(title, '') || CASE WHEN coalesce(title, '') <> '' AND coalesce(snippet, '') <> '' THEN ' — ' ELSE '' END || coalesce(snippet, ''), 1, 512)"


@query(f"""
WITH RECURSIVE {S.SIGNALS}, {_values([(f'weight={w}', w) for w in RERANK_WEIGHTS], 'weight')},
logits AS (SELECT * EXCLUDE (rank), rank AS old, CASE WHEN rank <= 15 THEN {S.coverage('terms', _PASSAGE)} END AS logit FROM ranking),
scaled AS (SELECT *, (logit - min(logit) OVER (PARTITION BY pool)) / coalesce(nullif(max(logit) OVER (PARTITION BY pool) - min(logit) OVER (PARTITION BY pool), 0), 1) AS scaled FROM logits),
blend AS (SELECT *, CASE WHEN weight > 0 THEN (1 - weight) * rrf + weight * scaled END AS combined FROM scaled, cfg),
grid AS (SELECT *, row_number() OVER (PARTITION BY config, pool ORDER BY combined DESC NULLS LAST, old) AS rank FROM blend), {_metrics_sql('grid', 'config, pool, query_id, lang')}
SELECT {_MEANS3} FROM metrics_grid GROUP BY config""")
def rerank_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of every pool reranked by a scorer of their passages at several weights (the scorer is term coverage, in place of a model's logits)."""
    rows = flagged(L.ranking(spark, d))
    rows = R.with_scaled_logit(rows.withColumn("logit", coverage(F.col("terms"), R.passage(F.col("title"), F.col("snippet")), None)))
    own = rows.select("pool", "query_id", "lang", "rank", "rrf", "scaled", "coverage", "is_gold", "junk", "aggregator", "chars")
    weights = spark.createDataFrame([(f"weight={w}", w) for w in RERANK_WEIGHTS], "config string, weight double")
    combined = F.when(F.col("weight") > 0, R.blended(F.col("weight")))
    again = own.crossJoin(F.broadcast(weights)).withColumn("combined", combined)  # as many rows as RERANK_WEIGHTS
    order = Window.partitionBy("config", "pool").orderBy(F.col("combined").desc_nulls_last(), "rank")
    return _means(E.metrics(again.withColumn("rank", F.row_number().over(order)), ["config", "pool", "query_id", "lang"]))


@query(_grid_sql(
    f"scored_bm AS (SELECT * FROM scored), cfg AS (SELECT * FROM (VALUES {', '.join(f'''('floor={x}', {x}::DOUBLE)''' for x in FLOORS)}) t(config, cf))", f"rrf - 0.15 * lower_host::INT {_BASE}", "cf") + """
SELECT lang, arg_max(config, {'n': ndcg5, 'c': config}) AS best, max(ndcg5) AS ndcg5 FROM (SELECT coalesce(lang, '(none)') AS lang, config, round(avg(ndcg5), 4) AS ndcg5 FROM metrics_grid GROUP BY ALL) GROUP BY lang""")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    m = _grid(spark, d, [(f"floor={x}", R.RankConfig(cov_floor=x)) for x in FLOORS])
    means = m.groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang"), "config").agg(F.round(F.avg("ndcg5"), 4).alias("ndcg5"))
    return means.groupBy("lang").agg(F.max_by("config", F.struct("ndcg5", "config")).alias("best"), F.max("ndcg5").alias("ndcg5"))


@query(f"""
WITH {S.KEPT}, {S.QUERIES_CLEAN}, g AS (SELECT k.pool, {_GOLD.replace('gold,', 'q.gold,')} AS is_gold FROM kept k JOIN queries_clean q USING (query_id))
SELECT pool, count(*) AS rows, count_if(is_gold) AS gold_rows, bool_or(is_gold) AS gold_in_pool FROM g GROUP BY pool""")
def pool_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    rows = L.with_query(L.kept_rows(spark, d), spark, d)
    g = rows.withColumn("is_gold", E.is_gold(F.col("domain"), F.col("gold")))
    return g.groupBy("pool").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_gold").alias("gold_rows"), F.bool_or("is_gold").alias("gold_in_pool"))


@query(f"""
WITH RECURSIVE {S.SIGNALS},
logits AS (SELECT * EXCLUDE (rank), rank AS old, CASE WHEN rank <= 15 THEN {S.coverage('terms', _PASSAGE)} END AS logit FROM ranking),
scaled AS (SELECT *, (logit - min(logit) OVER (PARTITION BY pool)) / coalesce(nullif(max(logit) OVER (PARTITION BY pool) - min(logit) OVER (PARTITION BY pool), 0), 1) AS scaled FROM logits),
blend AS (SELECT *, CASE WHEN old <= 15 THEN 0.65 * rrf + 0.35 * scaled END AS combined FROM scaled)
SELECT pool, key, round(combined, 6) AS combined, row_number() OVER (PARTITION BY pool ORDER BY combined DESC NULLS LAST, old) AS new_rank FROM blend""")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of every pool reranked by a scorer of their passages (term coverage, in place of a model's logits) at the default weight."""
    rows = L.ranking(spark, d).withColumn("logit", coverage(F.col("terms"), R.passage(F.col("title"), F.col("snippet")), None))
    return R.rerank_blend(rows).select("pool", "key", F.round("combined", 6).alias("combined"), "new_rank")
