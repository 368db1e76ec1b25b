"""Scores, ranking, the coverage floor, fusion and its variants, for whole batches of pools at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankloom.functions.constants import AGGREGATOR_HOSTS, DEFAULT_ENGINE_WEIGHT, DOC_HOST, DOC_PATH, ECHO_WORDS, ENGINE_WEIGHTS
from rankloom.functions.text import coverage, query_terms, tokens
from rankloom.functions.urls import is_homepage, path_segments


@dataclass(frozen=True)
class RankConfig:
    """Weights and thresholds of the ranking. The defaults."""

    mode: str = "rrf"
    rrf_k: float = 20.0
    w_rrf: float = 1.0
    w_coverage: float = 0.0
    w_bm25: float = 0.0
    engine_weighted: bool = False
    quality_power: float = 0.0
    lower_penalty: float = 0.15
    echo_penalty: float = 0.40
    echo_ratio: float = 0.8
    cov_floor: float = 0.12
    cov_best_gate: float = 0.40
    w_authority: float = 0.18
    w_tutorial: float = 0.08
    w_mirror: float = 0.18
    w_homepage: float = 0.10
    multi_result_bonus: float = 0.0
    homepage_cov_max: float = 0.20


DEFAULT = RankConfig()


def configs(spark, rows: list[tuple[str, RankConfig]]) -> DataFrame:  # noqa: ANN001
    """One row for each named configuration: ``config`` and its fields."""
    return spark.createDataFrame([{"config": name, **asdict(c)} for name, c in rows])


def engine_weight(engine: Column) -> Column:
    out = F.lit(DEFAULT_ENGINE_WEIGHT)
    for name, w in ENGINE_WEIGHTS.items():
        out = F.when(engine == name, w).otherwise(out)
    return out


def with_coverage(rows: DataFrame, q: str = "q") -> DataFrame:
    """Adds ``terms`` of the query and the row's ``coverage``."""
    return rows.withColumn("terms", query_terms(F.col(q))).withColumn("coverage", coverage(F.col("terms"), F.col("title"), F.col("snippet")))


def with_host_signals(rows: DataFrame, config: RankConfig = DEFAULT) -> DataFrame:
    """Adds ``authority`` (0 to 1), ``tutorial``, ``mirror``, ``homepage`` and ``host_n`` to merged rows with ``acts`` of the rules.

    Tiers of authority: a mirror has none; an authority host 1, or 0.9 if it is a ``www.`` host that isn't a
    documentation host; a host that holds a word of the query 0.6; a documentation path of two segments or
    more 0.4. The hosts come without ``www.`` from the merge, so 0.9 occurs for raw hosts only.
    """
    has = lambda a: F.array_contains("acts", F.lit(a))
    words = F.filter(F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col("q"), F.lit(""))), F.lit(r"([a-z][a-z0-9.+#\-]{2,})"), F.lit(1)), lambda w: F.regexp_replace(w, r"[.+#\-]", "")), lambda w: F.length(w) >= 3)
    flat = F.regexp_replace("domain", r"[.\-]", "")
    named = F.exists(words, lambda w: F.contains(flat, w))
    doc_path = F.col("url").rlike(DOC_PATH) & (path_segments(F.col("url")) >= 2)
    www = F.col("domain").rlike(r"^www\.") & ~F.col("domain").rlike(DOC_HOST)
    authority = F.when(has("mirror"), 0.0).when(has("authority"), F.when(www, 0.9).otherwise(1.0)).when(named, 0.6).when(doc_path, 0.4).otherwise(0.0)
    r = rows.withColumn("authority", authority).withColumn("tutorial", has("tutorial").cast("int")).withColumn("mirror", has("mirror").cast("int"))
    r = r.withColumn("homepage", (is_homepage(F.col("url")) & (F.col("coverage") <= config.homepage_cov_max)).cast("int")).drop("acts")
    return r.withColumn("host_n", F.count(F.lit(1)).over(Window.partitionBy("pool", "domain")))


def with_echo(rows: DataFrame) -> DataFrame:
    """Adds ``listed`` (a picture or video list) and ``echo_share``: how much of the query a title with catch-all words repeats, else null."""
    title = F.coalesce(F.col("title"), F.lit(""))
    share = F.when((title != "") & title.rlike(f"(?i){ECHO_WORDS}"), coverage(F.col("terms"), title, F.lit("")))
    return rows.withColumn("listed", F.col("url").rlike(f"(?i){AGGREGATOR_HOSTS}")).withColumn("echo_share", share)


def echo_penalty(config: RankConfig = DEFAULT) -> Column:
    """1 for picture and video lists, and for titles that repeat the query among catch-all words; of rows from ``with_echo``."""
    return F.when(F.col("listed") | F.coalesce(F.col("echo_share") >= config.echo_ratio, F.lit(False)), 1).otherwise(0)


def rrf_raw(k: float | Column = 20.0, weighted: bool | Column = False, power: float | Column = 0.0) -> Column:
    """Sum over the engines of w / (k + rank), of an ``engines`` array of structs.

    ``w`` is 1, or the engine's weight if ``weighted``, times the quality of the engine in the pool to the ``power``; a
    power other than 0 needs ``qualities``, a map from engine to quality. The settings may be Columns.
    """
    k, weighted = (x if isinstance(x, Column) else F.lit(x) for x in (k, weighted))

    def one(e: Column) -> Column:
        w = F.when(weighted, engine_weight(e["engine"])).otherwise(1.0)
        if isinstance(power, Column) or power:
            quality = F.greatest(F.element_at("qualities", e["engine"]), F.lit(0.01))
            w = w * F.coalesce(F.pow(quality, power if isinstance(power, Column) else F.lit(power)), F.lit(1.0))
        return w / (k + e["rank"])

    return F.aggregate("engines", F.lit(0.0), lambda acc, e: acc + one(e))


def with_qualities(rows: DataFrame) -> DataFrame:
    """Adds ``qualities``: for each engine of the pool the mean coverage of its merged rows. No shuffle for rows partitioned by pool."""
    pool = Window.partitionBy("pool")
    own = F.flatten(F.collect_list(F.transform("engines", lambda e: F.struct(e["engine"].alias("engine"), F.col("coverage").alias("coverage")))).over(pool))
    names = F.array_distinct(F.transform("_all", lambda x: x["engine"]))
    mean = lambda n: F.aggregate(F.filter("_all", lambda x: x["engine"] == n), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x["coverage"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"])
    return rows.withColumn("_all", own).withColumn("qualities", F.map_from_arrays(names, F.transform(names, mean))).drop("_all")


def with_rrf(rows: DataFrame, k: float | Column = 20.0, weighted: bool | Column = False, power: float | Column = 0.0, by: list[str] | None = None) -> DataFrame:
    """Adds ``rrf_raw`` and ``rrf``, which is relative to the best of the pool."""
    best = F.max("rrf_raw").over(Window.partitionBy(*(by or ["pool"])))
    return rows.withColumn("rrf_raw", rrf_raw(k, weighted, power)).withColumn("rrf", F.col("rrf_raw") / F.greatest(best, F.lit(1e-9)))


def with_bm25(rows: DataFrame, k1: float = 1.2, b: float = 0.7, d: float = 0.5, title_boost: float = 3.0) -> DataFrame:
    """``rows`` (unique by pool and key) with ``bm25_raw``, null for rows without a word of their query, and ``bm25``, relative to the best of the pool (0 for those).

    BM25+ over the pool's own statistics, with title and body as fields; the sum is multiplied by the number
    of different words that matched. Rows that are partitioned by pool stay so: windows, no join.
    """
    names = rows.columns
    fields = F.array(
        F.struct(F.lit("title").alias("field"), tokens(F.col("title")).alias("words"), F.lit(title_boost).alias("boost")),
        F.struct(F.lit("text").alias("field"), tokens(F.concat_ws(" ", F.coalesce("snippet", F.lit("")), "domain", "url")).alias("words"), F.lit(1.0).alias("boost")),
    )
    own = rows.select("pool", "key", F.struct(*names).alias("_row"), F.array_distinct(tokens(F.col("q"))).alias("_wanted"), F.explode(fields).alias("_f"))
    own = own.select("pool", "key", "_row", F.col("_f.field").alias("_field"), F.col("_f.boost").alias("_boost"), F.size("_f.words").alias("_n"), F.transform("_wanted", lambda w: F.struct(w.alias("word"), F.size(F.filter("_f.words", lambda x: x == w)).alias("tf"))).alias("_hits"))
    field = Window.partitionBy("pool", "_field")
    own = own.withColumn("_avg", F.avg("_n").over(field)).withColumn("_rows", F.count(F.lit(1)).over(field))
    hits = own.select("*", F.explode_outer(F.filter("_hits", lambda h: h["tf"] > 0)).alias("_hit")).drop("_hits").withColumn("_word", F.col("_hit.word"))
    hits = hits.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("pool", "_field", "_word")))
    idf = F.log(1 + (F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    tf = F.col("_hit.tf")
    part = F.col("_boost") * idf * (d + tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_avg"))))
    total = hits.groupBy("pool", "key").agg(F.first("_row").alias("_row"), (F.sum(F.when(F.col("_word").isNotNull(), part)) * F.countDistinct("_word")).alias("bm25_raw"))
    best = F.max("bm25_raw").over(Window.partitionBy("pool"))
    return total.select("_row.*", "bm25_raw").withColumn("bm25", F.coalesce(F.col("bm25_raw") / best, F.lit(0.0)))


def fused_score(config: RankConfig = DEFAULT) -> Column:
    """The linear score of rows with all signals; fields of ``config`` may be Columns of a configuration table too."""
    c = config
    return (
        c.w_rrf * F.col("rrf")
        + c.w_coverage * F.col("coverage")
        + c.w_bm25 * F.col("bm25")
        - c.lower_penalty * F.col("lower").cast("int")
        - c.echo_penalty * F.col("echo")
        + c.w_authority * F.col("authority")
        - c.w_tutorial * F.col("tutorial")
        - c.w_mirror * F.col("mirror")
        - c.w_homepage * F.col("homepage")
        + c.multi_result_bonus * F.when(F.col("host_n") >= 2, 1).otherwise(0)
    )


def legacy_score() -> Column:
    """The older score: coverage, BM25 and the weight of the best engine over the place in the pool."""
    best = F.coalesce(F.array_max(F.transform("engines", lambda e: engine_weight(e["engine"]))), F.lit(ENGINE_WEIGHTS["baidu"]))
    return 0.5 * F.col("coverage") + 0.25 * F.col("bm25") + 0.25 * best / (F.col("first_idx") + 1) - 0.3 * F.col("lower").cast("int")


def with_pool_best(rows: DataFrame) -> DataFrame:
    """Adds ``pool_coverage`` and ``pool_authority``, the best of the pool, which the floor needs whatever its settings."""
    w = Window.partitionBy("pool")
    return rows.withColumn("pool_coverage", F.max("coverage").over(w)).withColumn("pool_authority", F.max("authority").over(w))


def above_floor(config: RankConfig = DEFAULT) -> Column:
    """True for rows (``with_pool_best``) that the floor leaves: it is active if the pool's best coverage reaches the gate; authority hosts are exempt
    while their weight is above 0; a pool that would be left empty stays whole. Fields of ``config`` may be Columns."""
    c = config
    weighs = (c.w_authority if isinstance(c.w_authority, Column) else F.lit(c.w_authority)) > 0
    exempt = weighs & (F.col("authority") >= 0.9)
    emptied = (F.col("pool_coverage") < c.cov_floor) & ~(weighs & (F.col("pool_authority") >= 0.9))
    return (F.col("pool_coverage") < c.cov_best_gate) | (F.col("coverage") >= c.cov_floor) | exempt | emptied


def coverage_floor(rows: DataFrame, config: RankConfig = DEFAULT) -> DataFrame:
    """Rows left by the floor."""
    return with_pool_best(rows).where(above_floor(config)).drop("pool_coverage", "pool_authority")


def ranked(rows: DataFrame, score: str = "final_score", tie: str = "first_idx", by: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` within each pool: best score first, then the earlier row."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or ["pool"])).orderBy(F.col(score).desc(), F.col(tie))))


def top_n(rows: DataFrame, n: int, **kwargs) -> DataFrame:  # noqa: ANN003
    """The best ``n`` rows of each pool."""
    return ranked(rows, **kwargs).where(F.col("rank") <= n)


def passage(title: Column, snippet: Column, most: int = 512) -> Column:
    """The text that a scorer reads of a row: title and snippet with a dash between them where both are there, cut after ``most`` characters."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    return F.substring(F.concat(t, F.when((t != "") & (s != ""), " — ").otherwise(""), s), 1, most)


_MODELS: dict[str, Callable | None] = {}


def _model(name: str, load: Callable[[], Callable]) -> Callable | None:
    """The model of this worker process, loaded at its first use; None for good once that failed."""
    if name not in _MODELS:
        try:
            _MODELS[name] = load()
        except Exception:  # noqa: BLE001
            _MODELS[name] = None
    return _MODELS[name]


def with_logits(rows: DataFrame, name: str, load: Callable[[], Callable], head: int = 15) -> DataFrame:
    """Adds ``logit`` of the ``head`` best rows by a model: ``load()`` gives a function from lists of queries and passages to numbers.

    Each worker loads the model once, when it first has rows. Where it can't be loaded or fails on a batch the
    logits are null, and ``rerank_blend`` leaves the order as it was. Rows of the tail have a null logit. The
    rows come with ``q``, ``title``, ``snippet`` and ``rank``.
    """
    ready = rows.withColumn("_passage", F.when(F.col("rank") <= head, passage(F.col("title"), F.col("snippet"))))
    names = ready.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("_passage")).to_pylist()
            asked = batch.column(names.index("q")).to_pylist()
            at = [k for k, t in enumerate(texts) if t is not None]
            logits: list[float | None] = [None] * len(texts)
            model = _model(name, load) if at else None
            try:
                for k, x in zip(at, model([asked[k] or "" for k in at], [texts[k] for k in at]) if model else [], strict=bool(model)):
                    logits[k] = float(x)
            except Exception:  # noqa: BLE001
                logits = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logits, pa.float64())], [*names, "logit"])

    return ready.mapInArrow(run, StructType([*ready.schema.fields, StructField("logit", DoubleType())])).drop("_passage")


def with_scaled_logit(rows: DataFrame, head: int = 15) -> DataFrame:
    """Adds ``scaled``: the ``logit`` of the ``head`` best rows between the lowest and highest of them (0 where all are equal), null in the tail."""
    w = Window.partitionBy("pool")
    logit = F.when(F.col("rank") <= head, F.col("logit"))
    low, high = F.min(logit).over(w), F.max(logit).over(w)
    return rows.withColumn("scaled", (logit - low) / F.when(high - low == 0, 1.0).otherwise(high - low))


def blended(weight: float | Column) -> Column:
    """``rrf`` and the scaled logit by weight; null in the tail."""
    return (1 - weight) * F.col("rrf") + weight * F.col("scaled")


def rerank_blend(rows: DataFrame, weight: float = 0.35, head: int = 15) -> DataFrame:
    """Blends ``rrf`` of the ``head`` best rows with their min-max normalised ``logit``; the tail keeps its order.

    The weight is clamped to 0..1; at 0 the order stays. Adds ``combined`` (null in the tail) and ``new_rank``.
    """
    weight = min(1.0, max(0.0, weight))
    if weight == 0:
        return rows.withColumn("combined", F.lit(None).cast("double")).withColumn("new_rank", F.col("rank"))
    r = with_scaled_logit(rows, head).withColumn("combined", blended(weight)).drop("scaled")
    order = Window.partitionBy("pool").orderBy(F.col("combined").desc_nulls_last(), "rank")
    return r.withColumn("new_rank", F.row_number().over(order))
