"""Page parsing, sources and streaming."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from rankloom.functions.constants import LOWERED, SHORTENERS
from rankloom.operators import extract as X
from rankloom.plans import durable
from rankloom.sources import engines as N
from rankloom.streaming import state as S

PAGE = """<html><head><title>Guide</title><script>var x=1</script></head><body><header><nav><ul><li><a href="/a">Home</a><li><a href="/b">Docs</a></ul></nav></header>
<main><article><h1>Guide</h1><p>The first paragraph tells, at length, what the <b>guide</b> is about, and why.<p>The second one has a <a href="b.html">link</a>, some <code>code</code>, and more text.
<h2>Steps</h2><ul><li>one<li>two</ul><pre>x = 1\ny = 2</pre><table><tr><th>k<th>v<tr><td>a<td>1</table></article></main><footer>© 2024</footer></body></html>"""


def test_extract():
    title, text, md, via = X.extract(PAGE, "https://x.example/d/a.html")
    assert (title, via) == ("Guide", "readability")
    assert "Home" not in text and "©" not in text and "var x" not in text
    for part in ("# Guide", "**guide**", "[link](https://x.example/d/b.html)", "`code`", "## Steps", "- one\n- two", "```\nx = 1\ny = 2\n```", "| k | v |\n| --- | --- |\n| a | 1 |"):
        assert part in md, part


def test_extract_of_little():
    assert X.extract(None, None) == ("", "", "", "body")
    assert X.extract("", None)[3] == "body"
    assert X.extract("<p>hi", None)[1:] == ("hi", "hi", "body")
    # the content is the whole body, whatever the largest block is
    assert X.extract("<p>a</p><div class='content'>b</div><p>c</p>", None)[1:] == ("a\n\nb\n\nc", "a\n\nb\n\nc", "fallback-largest")
    assert X.extract("<div>" + "word " * 4000, None)[3] == "body"
    assert X.decode_body("中文页面".encode("gbk") * 10, "gbk") == "中文页面" * 10
    assert X.decode_body("é".encode(), "no-such") == "é"
    assert X.decode_body(None, "gbk") == ""


def test_columns(spark):
    df = spark.createDataFrame([("# [Redis](https://r.example) — Docs | Redis caching guide", "text/html", "x" * 20)], "t string, c string, b string")
    r = df.select(X.normal_heading(F.col("t")).alias("h"), X.routed(F.lit("image/png"), F.col("b")).alias("r"), X.truncated(F.col("b"), 5).alias("t"), X.squeezed(F.lit(" a 　b \n\n\n\n c ")).alias("s")).first()
    assert (r.h, r.r, r.t, r.s) == ("redis caching guide", "[image/png] Binary content", "xxxxx\n\n[...truncated at 5 characters]", "a b\n\nc")


def test_known_places_keep_their_links():
    text = "word " * 60
    md = X.extract(f"<div id='js_content'>{text}<a href='/x'>y</a></div>", "https://mp.weixin.qq.com/s")[2:]
    assert "[y](/x)" in md[0] and md[1] == "site-selector"


@pytest.mark.parametrize("html", ["<b>" * 3000 + "deep", "<div>" * 3000 + "deep", "<ul><li>" * 800 + "deep", "<blockquote>" * 1200 + "deep", "<table><tr><td>" * 700 + "deep", "<h1>" + "<span>" * 2000 + "deep"])
def test_pages_of_any_depth(html):
    _, text, md, _ = X.extract(html, None)
    assert text == "deep" and "deep" in md


def test_markdown_of_blocks():
    _, _, md, _ = X.extract("<h2>A <a href='#'>#</a></h2><ol><li>one<ul><li>in</ul><li>two</ol><blockquote><p>q<p>r</blockquote><hr><p>a<br>b [c] <a href='x'></a><img src='i.png'><img src='i.png' alt='pic'></p><td>lost</td>", "https://x.example/d/")
    assert md == "## A [#](#)\n\n1. one\n  - in\n2. two\n\n> q\n> \n> r\n\n---\n\na  \nb \\[c\\] ![pic](https://x.example/d/i.png)\n\nlost"


def test_titles_dropped(spark):
    rows = [("# [#](#a) Guide to caches\n\n\ntext", "Guide to caches | Site", "text"), ("# Other\ntext", "Guide", "# Other\ntext"), ("## Guide\ntext", "Guide", "## Guide\ntext"), ("# Guide", "Guide", "# Guide"), ("text", None, "text"), ("# \nx", "", "# \nx")]
    df = spark.createDataFrame(rows, "c string, t string, w string")
    assert [r.g for r in df.select(X.without_title(F.col("c"), F.col("t")).alias("g")).collect()] == [r[2] for r in rows]
    notes = spark.createDataFrame([("", "body"), (None, None), ("x", "body")], "c string, v string").select(X.answer(F.col("c"), F.col("v")).alias("a")).collect()
    assert ["way taken: body" in notes[0].a, "way taken: none" in notes[1].a, notes[2].a] == [True, True, "x"]


BING = '<li class="b_algo"><h2><a href="https://a.example/1">One</a></h2><div class="b_caption"><p>first</p></div></li><li class="b_algo"><h2><a href="/ck">Rel</a></h2></li><li class="b_algo"><h2><a href="https://a.example/2">One</a></h2></li>'
BAIDU = '<div class="result c-container" mu="https://b.example/1"><h3><a href="https://l.example/x">B1</a></h3><span class="summary_x">text</span></div><div class="result c-container" mu="null"><h3><a href="https://b.example/2">B2</a></h3></div><div class="result c-container" data-tuiguang="1" mu="https://ad.example"><h3>Ad</h3></div>'


def test_saved_pages(spark, tmp_path):
    (tmp_path / "cnBing--7.html").write_text(BING)
    (tmp_path / "baidu--7.html").write_text(BAIDU)
    (tmp_path / "baidu--8.html").write_text("<title>百度安全验证</title>")
    spark.dataSource.register(N.SavedPages)
    got = spark.read.format("saved_pages").option("fixture_dir", str(tmp_path)).load().collect()
    assert sorted((r.query_id, r.source, r.pos, r.title, r.url, r.snippet) for r in got if r.error is None) == [
        (7, "baidu", 1, "B1", "https://b.example/1", "text"),
        (7, "baidu", 2, "B2", "https://b.example/2", ""),
        (7, "cnBing", 1, "One", "https://a.example/1", "first"),
    ]
    assert [r.query_id for r in got if r.error] == [8]


def test_answers_of_providers(spark):
    bad = [(1, "tavily", '{"code": 401, "error": "x"}'), (2, "bocha", '{"code": "500"}'), (3, "zhipu", None), (4, "zhipu", "{broken"), (5, "tavily", '{"results": [{"title": "t", "url": "https://a.example", "content": "c"}, {"title": "u", "url": "nope"}]}')]
    df = spark.createDataFrame(bad, "ref bigint, source string, body string")
    assert [(r.ref, r.url) for r in N.parsed(df).collect()] == [(5, "https://a.example")]
    assert {r.ref: r.error for r in N.failures(df).collect()} == {1: "auth", 2: "contract", 3: "contract", 4: "contract"}
    assert N.provider_of({"zhipu": "k", "bocha": "_x", "tavily": " "}) == "zhipu"


def test_blocklists(spark, monkeypatch):
    hosts = ["# c", "0.0.0.0 ads.example", "127.0.0.1 ads.example # x", "0.0.0.0 localhost", "0.0.0.0 1.2.3.4", "", None, "0.0.0.0 Zeta.example", "0.0.0.0 alpha.example"]
    abp = ["! abp", "[Adblock]", "||bad.example^$third-party", "||notld^", "||*.sub.example^", "@@||ok.example^"]
    tlds = ["||*.gone^", "||mov^$denyallow=a.mov", "||fine^$denyallow=b.fine", "||*.x^"]
    lines = [(k, k, n, v) for k, own in (("hosts", hosts), ("abp", abp), ("abp-tlds", tlds)) for n, v in enumerate(own)]
    monkeypatch.setattr(N, "LIST_LIMITS", {"hosts": 3, "abp": 10})
    got = {(r.action, r.rule) for r in N.parse_blocklists(spark.createDataFrame(lines, "list string, kind string, n int, value string")).collect()}
    built_in = {("remove", "." + t) for t in N.NOTORIOUS_TLDS} | {("lower", h) for h in LOWERED} | {("remove", h) for h in SHORTENERS if h != "shortest.link"}
    # repeats count towards the limit, and the order is that of the list
    assert got - built_in == {("remove", x) for x in ("ads.example", "zeta.example", "bad.example", ".gone")}
    assert built_in <= got
    assert N.parse_blocklists(spark.createDataFrame([], "list string, kind string, n int, value string")).count() == len(built_in)


def test_rule_fallback(spark):
    make = lambda *x: spark.createDataFrame(list(x), "rule string, action string")
    rules_of = lambda df, a: {r.rule for r in N.with_fallback(df).where(F.col("action") == a).collect()}
    own = make(("x.example", "remove"), ("y.example", "mirror"), (" ", "lower"))
    assert rules_of(own, "remove") == {"x.example"} and rules_of(own, "lower") == set(LOWERED) and rules_of(own, "mirror") == {"y.example"}
    assert ".top" in rules_of(make(), "remove") and "bit.ly" in rules_of(make(), "remove")


def test_redirects(spark):
    rows = spark.createDataFrame([(1, "https://b.example/link?url=x"), (2, "https://c.example"), (3, None)], "result_id bigint, url string")
    known = spark.createDataFrame([("https://b.example/link?url=x", "https://t.example")], "address string, target string")
    assert {r.result_id: r.url for r in N.resolve_redirects(rows, known).collect()} == {1: "https://t.example", 2: "https://c.example", 3: None}


def test_keys():
    assert N.keys_of({"tavily": " ", "zhipu": "_x", "_note": "k"}, None, {"tavily": " file ", "bocha": "b"}, {"tavily": "last"}) == {"tavily": "file", "bocha": "b"}
    assert N.provider_of({"zhipu": "k", "tavily": "t"}, "zhipu") == "zhipu" and N.provider_of({}) is None
    with pytest.raises(ValueError, match="no key of bocha"):
        N.provider_of({"tavily": "t"}, "bocha")


MOBILE = """<div tpl="a" data-log='{"mu": "https://zhidao.baidu.com/q"}'><h3>Kept</h3><p class="c-abstract">abs</p></div><div tpl="b" data-log='{"mu": "https://baike.baidu.com/x"}'><h3>Entry</h3></div>
<div class="c-result" data-log='{broken'><a href="https://out.example/1">x</a><div class="c-title">Out</div></div><div tpl="d" data-log='{"mu": "https://z.example"}'><h3>大家还在搜</h3></div>"""
WEIXIN = '<ul class="news-list"><li><h3><a href="/link?url=1">Pay</a></h3><p class="txt-info">fees and limits</p><div class="s-p"><a>Account</a>document.write(1)</div></li><li><h3>no link</h3></li></ul>'


def test_engines_pages():
    assert N.parse_page("baiduMobile", MOBILE) == [("Kept", "https://zhidao.baidu.com/q", "abs"), ("Out", "https://out.example/1", "")]
    assert N.parse_page("sogouWeixin", WEIXIN) == [("Pay", "https://weixin.sogou.com/link?url=1", "【Account】fees and limits")]
    assert N.parse_page("intlBing", '<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9ub2RlanMub3JnLw">Node</a></h2></li>') == [("Node", "https://nodejs.org/", "")]
    assert N.parse_page("so360", '<ul><li class="res-list"><h3><a data-mdurl="https://x.so.com/a" href="/l">A</a></h3><li class="res-list"><h3><a data-mdurl="https://b.example" href="/l">B</a></h3><p>about b</p></ul>') == [("B", "https://b.example", "about b")]
    # the first place of the snippet that has text counts, in the order of the places
    assert N.parse_page("baidu", '<div class="result" mu="https://a.example"><h3>A</h3><p class="c-abstract">second</p><p class="x-summary"> </p></div>' + " " * 3000) == [("A", "https://a.example", "second")]
    with pytest.raises(ValueError, match="verification"):
        N.parse_page("baidu", "<p>short</p>")
    assert N.parse_page("cnBing", "<p>short</p>") == []
    assert N.bing_target("https://x.example/?u=a1%%%") == "https://x.example/?u=a1%%%"


def test_metasearch_answers(spark, tmp_path):
    (tmp_path / "ddgs--3.json").write_text('[{"title": " T ", "href": "https://a.example", "body": "b"}, {"title": "", "href": "https://b.example"}, 5]')
    (tmp_path / "ddgs--4.json").write_text("not json")
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(N.SavedPages)
    got = spark.read.format("saved_pages").option("fixture_dir", f"file://{tmp_path}").load().collect()
    assert [(r.query_id, r.source, r.title, r.url, r.snippet) for r in got] == [(3, "ddgs", "T", "https://a.example", "b")]


def test_tools(spark):
    from rankloom import tools
    from rankloom.__main__ import main

    d = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{d}/queries.parquet").join(spark.read.parquet(f"{d}/search_results.parquet").select("query_id").distinct(), "query_id").where("q is not null").orderBy("query_id").first().q
    assert [r["rank"] for r in tools.search(spark, d, text, 3).collect()] == [1, 2, 3]
    assert tools.search(spark, d, text, 99).count() <= 10
    with pytest.raises(ValueError, match="empty"):
        tools.search(spark, d, " ?! ".replace("?!", ""))
    page = spark.read.parquet(f"{d}/extractions.parquet").where("html is not null and url like 'http%'").orderBy("extract_id").first()
    answer = tools.fetch(spark, d, page.url, 40).first().answer
    assert answer.startswith("# ") and f"URL: {page.url}" in answer
    host = spark.read.parquet(f"{d}/search_results.parquet").where("query_id = 1 and url like 'http%'").first()
    q1 = spark.read.parquet(f"{d}/queries.parquet").where("query_id = 1").first().q
    assert tools.site(spark, d, host.url.split("/")[2], q1, 2).count() in (1, 2)
    assert [tools.clamped(n, 1, 10, 5) for n in (None, 0, 7, 99)] == [5, 1, 7, 10]
    assert main([]) == main(["search", d]) == main(["search", d, "q", "x"]) == 2


def test_tables_in_the_shared_folder(spark):
    df = spark.range(5).withColumn("s", F.array(F.lit("a")))
    kept = durable.cut(df)
    assert kept.dtypes == df.dtypes and kept.count() == 5
    assert durable.cut(df.limit(0)).count() == 0
    assert durable.release(spark) >= 2


def test_memory_cache_is_first_in_first_out(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2025, 1, 1)
    events = [(rng.choice("pq"), k, start + datetime.timedelta(seconds=40 * k), f"h{rng.randrange(300)}", rng.choice(["ask", "write"])) for k in range(1_500)] + [("r", 2_000 + k, start + datetime.timedelta(milliseconds=k), f"h{k % 205}", "write" if k < 205 else "ask") for k in range(410)]
    want, held = {}, {}
    for process, k, ts, key, kind in sorted(events, key=lambda x: (x[2], x[1])):
        own, now = held.setdefault(process, []), ts.timestamp()
        at = next((i for i, (n, _) in enumerate(own) if n == key), None)
        if kind == "write":
            if at is None:
                own.append((key, now + 600))
                del own[: max(0, len(own) - 200)]
            else:
                own[at] = (key, now + 600)
        else:
            want[k] = at is not None and own[at][1] > now
            if at is not None and not want[k]:
                del own[at]
    assert 100 < sum(want.values()) < len(want) and not want[2_205] and want[2_210]
    schema = "process string, event_id bigint, ts timestamp, query_hash string, kind string"
    for part in range(2):  # state goes on from one batch to the next
        spark.createDataFrame([e for e in events if (e[1] % 2_000 >= 700) == bool(part)], schema).coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}
    try:
        for part in range(2):
            (tmp_path / "in").mkdir(exist_ok=True)
            for f in (tmp_path / f"part{part}").glob("*.parquet"):
                shutil.copy(f, tmp_path / "in" / f"{part}-{f.name}")
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = S.memory_cache(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: got.update({r.event_id: r.hit for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want


def test_sessions_and_cache_sink(spark, tmp_path):
    e = spark.createDataFrame([(1, datetime.datetime(2025, 1, 1, 0, m)) for m in (0, 10, 50)] + [(2, datetime.datetime(2025, 1, 1, 0, 5))], "user_id bigint, ts timestamp")
    assert sorted((r.user_id, r.n) for r in S.sessions(e).collect()) == [(1, 1), (1, 2), (2, 1)]
    batch = spark.createDataFrame([("h", "old", "e", datetime.datetime(2025, 1, 1)), ("h", "new", "f", datetime.datetime(2025, 1, 2)), ("g", None, None, datetime.datetime(2025, 1, 1))], "query_hash string, results string, engine string, created_at timestamp")
    S.latest_by_key(batch, str(tmp_path / "cache"))
    assert sorted((r.query_hash, r.results) for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [("g", None), ("h", "new")]


def test_streaming_windows_match_batch(spark, tmp_path):
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "e.parquet")
    events = spark.read.parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    q = S.engine_windows(stream).writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) n, sum(errors) e from win").first() == events.selectExpr("count(*) n", "count_if(event_type = 'error') e").first()


def test_streaming_negative_cache_matches_batch(spark, tmp_path):
    from rankloom.catalog.state import negative_cache

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "e.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
        q = S.negative_cache(stream).writeStream.outputMode("append").format("memory").queryName("refused").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.event_id: r.refused for r in spark.table("refused").collect()}
    assert got == {r.event_id: r.refused for r in negative_cache(spark, "/root/testdata/sf0.001").collect()}
