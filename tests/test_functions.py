"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import urls as U
from rankloom.operators import official as O
from rankloom.operators import rank as R


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://Example.com/path?a=1&utm_source=x&b=2", "http://www.example.com/path?b=2&a=1#frag", True),
        ("https://a.example/x/", "https://a.example/x", True),
        ("https://a.example", "https://a.example/", True),
        ("https://a.example/x?id=1", "https://a.example/x?id=2", False),
        ("https://a.example:8080/x", "https://a.example/x", True),
        ("https://a.example/X", "https://a.example/x", False),
        ("https://a.example/x?FROM=feed", "https://a.example/x", True),
    ],
)
def test_url_key(spark, a, b, same):
    assert (one(spark, U.url_key(F.col("u")), u=a) == one(spark, U.url_key(F.col("u")), u=b)) is same


def test_url_key_of_bad_addresses(spark):
    df = spark.createDataFrame([(None,), ("",), ("not a url",), ("ftp://x.example/a",)], "u string")
    assert [r.k for r in df.select(U.url_key(F.col("u")).alias("k")).collect()] == [None, "", "not a url", "ftp://x.example/a"]
    assert [r.k for r in df.select(U.is_valid_url(F.col("u")).alias("k")).collect()] == [False] * 4


@pytest.mark.parametrize(
    ("q", "clean", "lang"),
    [(" 微信  小程序。", "微信 小程序", "cn"), ("foo !", "foo ", "en"), ("site:x.example  a", "site:x.example a", "en"), (None, "", "en"), ("a 中 b", "a 中 b", "en")],
)
def test_clean_and_language(spark, q, clean, lang):
    assert one(spark, T.clean_query(F.col("q")), q=q) == clean
    assert one(spark, T.query_language(F.col("q")), q=q) == lang


def test_terms_and_coverage(spark):
    assert one(spark, T.query_terms(F.col("q")), q="微信小程序 API 2024 a café") == ["api", "caf", "微信", "信小", "小程", "程序"]
    terms = T.query_terms(F.col("q"))
    assert one(spark, T.coverage(terms, F.col("t"), F.col("s")), q="redis cache", t="Redis docs", s=None) == 0.5
    assert one(spark, T.coverage(terms, F.col("t"), F.col("s")), q="?!", t="x", s="y") == 1.0
    assert one(spark, T.tokens(F.col("q")), q="A_b 好 你好吗") == ["a_b", "好", "你好", "好吗"]


def test_hosts(spark):
    assert one(spark, U.host_suffixes(F.col("h")), h="a.b.c") == ["a.b.c", "b.c", "c"]
    assert one(spark, U.host_suffixes(F.col("h")), h="") == []
    assert one(spark, U.normalize_domain(F.col("h")), h=" https://WWW.Redis.io/docs ") == "redis.io"
    assert one(spark, U.normalize_domain(F.col("h")), h="redis") == "redis.com"


@pytest.mark.parametrize(("u", "target"), [("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9ub2RlanMub3JnLw", "https://nodejs.org/"), ("https://x.example/?q=1", None), ("https://x.example/?u=%%%", None)])
def test_redirect(spark, u, target):
    assert one(spark, U.decode_bing_redirect(F.col("u")), u=u) == (target or u)


@pytest.mark.parametrize(("stem", "label", "score"), [("redis", "redis", 4), ("vue", "vuejs", 1), ("vuej", "vuejs", 3), ("nodejs", "node", 3), ("tgres", "postgresql", 2), ("pythan", "python", 1), ("setup", "svelte", 0)])
def test_label_score(spark, stem, label, score):
    assert one(spark, O.label_score(F.col("a"), F.col("b")), a=stem, b=label) == score


def test_alias_and_docs_query(spark):
    assert one(spark, O.alias(F.col("q")), q="Golang 微信支付") == "go.dev"
    assert one(spark, O.alias(F.col("q")), q="微信支付 v3") == "pay.weixin.qq.com"
    assert one(spark, O.docs_query(F.col("q"), F.col("d")), q="mysql 索引", d="mysql.com") == "mysql reference guide documentation"
    assert one(spark, O.docs_query(F.col("q"), F.col("d")), q="索引", d="mysql.com") == "索引"


def test_rrf_rewards_agreement(spark):
    rows = spark.createDataFrame([(1, "one", [("a", 1)]), (1, "four", [("a", 3), ("b", 3), ("c", 3), ("d", 3)])], "pool bigint, key string, engines array<struct<engine:string,rank:int>>")
    got = {r.key: r.rrf for r in R.with_rrf(rows).collect()}
    assert got["four"] == 1.0
    assert got["one"] < 0.5


def test_characters_and_rounding(spark):
    assert [one(spark, T.has_cjk(F.col("t")), t=t) for t in ("a", "中", "の", "한", "é")] == [False, True, True, True, False]
    assert one(spark, T.round_half_up(F.col("x"), 4), x=0.12345) == 0.1235 and one(spark, T.round_half_up(F.col("x"), 0), x=-0.5) == 0.0


def test_passages(spark):
    got = lambda t, s: one(spark, R.passage(F.col("t"), F.col("s")), t=t, s=s)
    assert [got("a", "b"), got("a", None), got(None, "b"), got("", ""), len(got("a" * 600, "b"))] == ["a — b", "a", "b", "", 512]
