"""Operators on small pools, with nulls, ties, repeats, empty tables and clashing column names."""

import datetime
import math

from pyspark.sql import functions as F

from rankloom.operators import evaluate as E
from rankloom.operators import pool as P
from rankloom.operators import rank as R
from rankloom.plans.pools import pool_id
from rankloom.plans.skew import bounded, salted_join

SCHEMA = "result_id bigint, query_id bigint, pos int, title string, url string, snippet string, source string, captured_at timestamp, ingested_at timestamp"
RULES = "rule string, kind string, action string, ord int"
T0 = datetime.datetime(2025, 1, 1, 12, 0, 5)


def rows(spark, *items):
    return pool_id(spark.createDataFrame([(k, 1, k, *x, T0, None) for k, x in enumerate(items, 1)], SCHEMA))


def rules(spark, *items):
    return spark.createDataFrame([(r, None, a, k) for k, (r, a) in enumerate(items)], RULES)


def test_filter_and_merge(spark):
    raw = rows(
        spark,
        ("Bad", "https://spam.top/x", "s", "a"),
        ("Node", "https://nodejs.org/api?b=2&a=1", "short", "a"),
        ("Node again", "http://www.nodejs.org/api/?a=1&b=2#x", "a longer one", "b+a"),
        ("Blog", "https://blog.csdn.example/1", None, "b"),
        (None, None, None, None),
        ("百度图片 x", "https://y.example", "s", "a"),
    )
    kept = P.numbered(P.kept(raw, rules(spark, (".top", "remove"), ("csdn.example", "lower"), (None, "remove"), (" ", "remove"))))
    assert [(r.result_id, r.lower) for r in kept.orderBy("idx").collect()] == [(2, False), (3, False), (4, True)]
    merged = {r.key: r for r in P.merged_by_key(kept).collect()}
    node = merged["nodejs.org|/api|a=1&b=2"]
    assert (node.title, node.snippet, node.n_rows, node.first_idx) == ("Node", "a longer one", 2, 0)
    assert [(e.engine, e["rank"]) for e in node.engines] == [("a", 1), ("b", 1)]


def test_rules_match_by_kind(spark):
    hosts = spark.createDataFrame([("a.test",), ("latest",), ("x.sub.example",), ("sub.example",), ("dom.example",), ("y.dom.example",), ("xdom.example",), ("",)], "host string")
    got = {r.host: sorted(r.actions) for r in P.match_rules(hosts, rules(spark, (".test", "lower"), ("*.sub.example", "mirror"), ("DOM.example ", "remove"), ("dom.example", "remove"))).collect()}
    assert got == {"a.test": ["lower"], "latest": ["lower"], "x.sub.example": ["mirror"], "dom.example": ["remove"], "y.dom.example": ["remove"]}


def test_rules_for_the_host_without_www(spark):
    hosts = spark.createDataFrame([("www.sub.example",), ("www.dom.example",), ("www.test",)], "host string")
    got = {r.host: (sorted(r.actions), sorted(r.bare_actions)) for r in P.match_rules(hosts, rules(spark, ("*.sub.example", "mirror"), ("dom.example", "authority"), ("www.dom.example", "lower"), ("w.test", "lower"))).collect()}
    assert got == {"www.sub.example": (["mirror"], []), "www.dom.example": (["authority", "lower"], ["authority"])}


def test_pools_of_rows_without_times(spark):
    late = datetime.datetime(2025, 1, 1, 12, 7)
    df = spark.createDataFrame([(k, 1, 1, None, None, None, None, *t) for k, t in enumerate([(T0, late), (None, late), *[(None, None)] * 300])], SCHEMA)
    sizes = pool_id(df).groupBy("pool").count().orderBy("count").collect()
    assert max(r["count"] for r in sizes) == 64 and sum(r["count"] for r in sizes) == 302
    minute = lambda t: 100_000_000 + int(t.replace(tzinfo=datetime.timezone.utc).timestamp()) // 60
    assert {minute(T0), minute(late)} <= {r.pool for r in sizes}


def test_hot_keys_are_divided(spark):
    n = 1_000
    left = spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id")).when(F.col("id") % 10 == 1, None).otherwise(-1).alias("k"))
    right = spark.createDataFrame([(-1, "hot"), (10, "cold"), (7, "none"), (None, "null")], "k bigint, v string")
    want = sorted((r.id, r.v) for r in left.join(right, "k", "left").collect())
    for most in (50, 10_000):
        assert sorted((r.id, r.v) for r in salted_join(left, right, ["k"], by="id", how="left", most=most).collect()) == want
    assert salted_join(left, right, ["k"], by="id", most=50).count() == 801
    assert salted_join(left.limit(0), right, ["k"], by="id", how="left").count() == 0


def test_small_tables_only_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(10).withColumn("x", F.lit(1))
    assert "broadcast" in plan(rows.join(bounded(spark.range(5)), "id")) and "broadcast" not in plan(rows.join(bounded(spark.range(5), 4), "id"))


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "a", "redis cache", "x", "redis cache", "h", "u"), (1, "b", "redis", "x", "redis cache", "h", "u"), (1, "c", "other", "x", "redis cache", "h", "u")], "pool bigint, key string, title string, snippet string, q string, domain string, url string")
    got = {r.key: r for r in R.with_bm25(df).collect()}
    # titles have 2, 1 and 1 words, 4/3 on average; 'redis' is in two of three titles, 'cache' in one; the body has neither
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    part = lambda n, words: 3 * idf(n) * (0.5 + 2.2 / (1 + 1.2 * (0.3 + 0.7 * words / (4 / 3))))
    assert abs(got["a"].bm25_raw - 2 * (part(2, 2) + part(1, 2))) < 1e-9  # two words matched
    assert abs(got["b"].bm25_raw - part(2, 1)) < 1e-9
    assert got["c"].bm25_raw is None and got["c"].bm25 == 0 and got["a"].bm25 == 1


def test_quality_of_engines_weighs_their_ranks(spark):
    schema = "pool bigint, key string, coverage double, engines array<struct<engine:string,rank:int>>"
    df = spark.createDataFrame([(1, "a", 1.0, [("good", 1)]), (1, "b", 0.0, [("bad", 1), ("good", 2)])], schema)
    got = {r.key: r for r in R.with_rrf(R.with_qualities(df), 20.0, power=1.0).collect()}
    assert got["a"].qualities == {"good": 0.5, "bad": 0.0}
    assert abs(got["a"].rrf_raw - 0.5 / 21) < 1e-12 and abs(got["b"].rrf_raw - (0.01 / 21 + 0.5 / 22)) < 1e-12
    plain = {r.key: r.rrf_raw for r in R.with_rrf(df, 20.0).collect()}
    assert abs(plain["b"] - (1 / 21 + 1 / 22)) < 1e-12


def test_echo(spark):
    df = spark.createDataFrame([("redis 教程大全", "https://a.example"), ("redis", "https://a.example"), (None, "https://image.baidu.com/x"), ("最新", None)], "title string, url string").withColumn("terms", F.array(F.lit("redis")))
    assert [r.e for r in R.with_echo(df).select(R.echo_penalty().alias("e")).collect()] == [1, 0, 1, 0]


def test_junk(spark):
    df = spark.createDataFrame([("a.top", None), ("b.example", ["remove"]), ("c.example", ["lower"])], "h string, acts array<string>")
    assert [r.v for r in df.select(E.is_junk(F.col("h"), F.col("acts")).alias("v")).collect()] == [True, True, False]


def test_ways_of_taking_in_rows(spark):
    from rankloom.catalog.routing import WAYS, with_ways

    own = [(k, 1, k, "redis", "https://own.example", "", "cnBing", "own.example", "redis") for k in range(1, 4)]
    api = [(4, 1, 4, "redis", "https://own.example/x", "", "tavily", "own.example", "redis"), (5, 1, 5, "other", "https://new.example", "", "bocha+officialDocs", "new.example", "redis")]
    df = spark.createDataFrame(own + api, "result_id bigint, pool bigint, pos int, title string, url string, snippet string, source string, host string, q string")
    got = {}
    for r in with_ways(df).collect():
        got.setdefault(WAYS[r.way], set()).add(r.result_id)
    assert got == {"prod": {1, 2, 3}, "append": {1, 2, 3, 4, 5}, "gate020": {1, 2, 3, 4}, "gate040": {1, 2, 3, 4}, "new_domain": {1, 2, 3, 5}, **{w: {1, 2, 3, 4, 5} for w in ("max5", "single", "rescue8", "rescue12", "single_or_rescue8")}}


def test_title_merge_is_greedy_and_not_transitive(spark):
    words = [f"w{k}" for k in range(20)]
    a, b, c = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:-2] + ["x", "y"])
    raw = rows(spark, (a, "https://a.example/1", "s", "e"), (b, "https://a.example/2", "longer", "f"), (c, "https://a.example/3", "s", "g"))
    got = P.merged_by_title(P.merged_by_key(P.numbered(P.kept(raw, rules(spark, ("z.example", "lower"))))))
    # b is like a (19 of 21), c is like b but not like a (18 of 22), and b is gone by then
    assert sorted((r.title, r.snippet, r.n_rows) for r in got.collect()) == sorted([(a, "longer", 2), (c, "s", 1)])


def test_floor(spark):
    make = lambda *x: spark.createDataFrame([(1, k, c, a) for k, (c, a) in enumerate(x)], "pool bigint, first_idx int, coverage double, authority double")
    left = lambda df, **kw: sorted(r.first_idx for r in R.coverage_floor(df, R.RankConfig(**kw)).collect())
    assert left(make((0.8, 0.0), (0.0, 1.0), (0.0, 0.6))) == [0, 1]
    assert left(make((0.8, 0.0), (0.0, 1.0)), w_authority=0.0) == [0]
    assert left(make((0.3, 0.0), (0.0, 0.0))) == [0, 1]
    assert left(make((0.5, 0.0), (0.45, 0.0)), cov_floor=0.9) == [0, 1]


def test_metrics(spark):
    flags = lambda *gold: spark.createDataFrame([("p", k, g, False, False, 50, 0.5) for k, g in enumerate(gold, 1)], "q string, rank int, is_gold boolean, junk boolean, aggregator boolean, chars int, coverage double")
    m = E.metrics(flags(False, True, True), ["q"]).first()
    assert (m.hit1, m.hit3, m.hit5, m.mrr, round(m.p5, 6)) == (0, 1, 1, 0.5, 0.666667)
    assert round(m.ndcg5, 6) == round((1 / 1.5849625007211562 + 0.5) / (1 + 1 / 1.5849625007211562), 6)
    assert E.metrics(flags(False), ["q"]).first().ndcg5 == 0.0


def test_gold_of_null(spark):
    df = spark.createDataFrame([("a.x.example", ["x.example"]), ("x.example", None), ("y.example", []), ("nx.example", ["x.example"])], "h string, g array<string>")
    assert [r.v for r in df.select(E.is_gold(F.col("h"), F.col("g")).alias("v")).collect()] == [True, False, False, False]


def test_rerank(spark):
    df = spark.createDataFrame([(1, k, 1 / k, x) for k, x in enumerate((0.0, 5.0, 5.0, 1.0), 1)], "pool bigint, rank int, rrf double, logit double")
    got = {r["rank"]: r.new_rank for r in R.rerank_blend(df, weight=1.0, head=3).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 4: 4}
    assert [r.new_rank for r in R.rerank_blend(df, weight=0).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_model_is_loaded_late_and_may_fail(spark):
    df = spark.createDataFrame([(1, k, 1 / k, "redis", t, None) for k, t in enumerate(("x", "redis", None, "redis"), 1)], "pool bigint, rank int, rrf double, q string, title string, snippet string")

    def fine():
        return lambda qs, ps: [float(q in p) for q, p in zip(qs, ps, strict=True)]

    def missing():
        raise OSError("no model")

    def broken():
        return lambda qs, ps: [1.0]

    got = {r["rank"]: r.logit for r in R.with_logits(df, "fine", fine, head=3).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0, 4: None}
    assert [r.new_rank for r in R.rerank_blend(R.with_logits(df, "fine", fine, head=3), 1.0, head=3).orderBy("rank").collect()] == [2, 1, 3, 4]
    for name, load in (("missing", missing), ("broken", broken)):
        same = R.rerank_blend(R.with_logits(df.coalesce(1), name, load), 0.35).orderBy("rank").collect()
        assert [r.new_rank for r in same] == [1, 2, 3, 4] and all(r.logit is None for r in same)


def test_rescue_floor():
    from rankloom.catalog.ranking import rescue_floor

    assert [rescue_floor(x) for x in (None, "", "0", "-3", "x", "7", " 9 ")] == [12, 12, 12, 12, 12, 7, 9]


def test_empty_tables(spark):
    empty = pool_id(spark.createDataFrame([], SCHEMA))
    no_rules = spark.createDataFrame([], RULES)
    merged = P.merged_by_title(P.merged_by_key(P.numbered(P.kept(empty, no_rules))))
    assert merged.count() == 0
    assert R.with_rrf(merged).count() == 0


def test_extra_columns_with_clashing_names(spark):
    raw = rows(spark, ("A", "https://a.example/1", "s", "e")).withColumn("rank", F.lit(9)).withColumn("key2", F.lit("x"))
    got = P.merged_by_key(P.numbered(P.kept(raw, rules(spark, ("z.example", "lower")))))
    assert got.count() == 1
