"""Problems 2, 6 and 7 against brute force and exact round trips."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import p2_format_duplicates as p2
from rankloom.llm import p7_containers as p7
from rankloom.llm import tokenizer as tk

RESULTS = "result_id bigint, query_id bigint, title string, url string, extra string"


def results(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], RESULTS).withColumn("h", F.lit(1)).withColumn("title_key", F.lit("clash"))


def test_copies(spark):
    df = results(
        spark,
        (1, 1, "A: b | Site", "https://X.example/p/?b=2&a=1&utm_source=q#f"),
        (2, 1, "site – a  B!", "http://www.x.example/p?A=1&B=2 "),
        (3, 1, "A: b | Site", "https://x.example/p?b=2&a=1"),
        (4, 2, "A: b | Site", "https://x.example/p?b=2&a=1"),
        (5, 1, "A: c | Site", "https://x.example/p?b=2&a=1"),
        (6, 1, "A: b | Site", "ftp://x.example/p?b=2&a=1"),
        (7, 1, None, "https://x.example/p"),
        (8, 1, "  ", "https://x.example/p"),
        (9, 1, "t", None),
        (10, 1, "...", "https://x.example/q"),
        (11, 1, "…", "https://x.example/q"),
        (12, None, "t", "https://x.example/q"),
        (13, None, "t", "https://x.example/q"),
    )
    assert sorted(map(tuple, p2.copies(df).collect())) == [(1, 2), (1, 3)]
    got = {r.first_id: r.copies for r in p2.collapsed(df).collect()}
    assert got == {1: 3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1}


def test_copies_of_nothing_and_of_one_hot_group(spark, monkeypatch):
    assert p2.copies(results(spark).limit(0)).count() == 0
    monkeypatch.setattr(p2, "HOT_COPIES", 10)
    df = results(spark, *[(k, 1, "Same " + "!" * (k % 3), "https://x.example/p") for k in range(1, 60)], *[(k, 1, f"t{k}", "https://x.example/p") for k in range(60, 90)])
    assert sorted(map(tuple, p2.copies(df).collect())) == [(1, k) for k in range(2, 60)]


def test_filter_misses_no_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    parts = [np.concatenate((h[:9_000], h[:50])), h[8_900:], h[100:110]]
    segments = p2.segments_for(len(h))
    blobs = [b for p in parts for b in p2._partition_filters(segments)(iter([pa.RecordBatch.from_pydict({"h": p})]))]
    again = {r["segment"]: np.frombuffer(r["again"], np.uint8) for b in p2._merge(iter(blobs)) for r in b.to_pylist()}
    segment, places = p2._places(h, segments)
    held = np.array([p2._held(again[s], places[:, [k]])[0] for k, s in enumerate(segment)])
    assert held[:50].all() and held[8_900:9_000].all() and held[100:110].all()
    assert held.mean() < 0.05


def test_sparse_and_dense_parts_give_the_same_filter():
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 60_000)
    sparse = [b for p in np.array_split(h, 60) for b in p2._partition_filters(1)(iter([pa.RecordBatch.from_pydict({"h": p})]))]
    dense = list(p2._partition_filters(1)(iter([pa.RecordBatch.from_pydict({"h": h})])))
    assert all(b.to_pylist()[0]["hashes"] is not None for b in sparse) and dense[0].to_pylist()[0]["hashes"] is None
    a, b = (next(iter(p2._merge(iter(x)))).to_pylist()[0]["again"] for x in (sparse, dense))
    assert a == b


def test_many_filters_shuffle_no_more_and_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, 1, f"title {rng.randrange(5_000)}", "https://x.example/p") for k in range(6_000)]
    df = results(spark, *rows).repartition(3)
    want, most = sorted(map(tuple, p2.copies(df).collect())), p2.split_by_filter(df)[0].count()
    first = {}
    for k, _, t, _ in rows:
        first.setdefault(t, k)
    assert want == sorted((first[t], k) for k, _, t, _ in rows if first[t] != k)
    monkeypatch.setattr(p2, "RECORDS_A_SEGMENT", 200)
    monkeypatch.setattr(p2, "SEGMENTS_AT_ONCE", 8)
    assert p2.segments_for(6_000) == 30
    assert sorted(map(tuple, p2.copies(df).collect())) == want
    assert p2.split_by_filter(df)[0].count() <= 1.02 * most


TEXTS = ["", None, "Hello  world's end.\n\n x", "naïve café 中文字符 🚀🚀", "<|endoftext|> x", " \t \n", "a" * 20_000, "中文" * 9_000, "ab1-" * 6_000, ("word " * 9_000).strip(), " " * 9_000 + "x"]


def plain(text):
    return tk.encoding().encode_ordinary(text) if text else []


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_encode_equals_plain_encoding(k):
    ids = tk.encode(TEXTS[k]).tolist()
    assert ids == plain(TEXTS[k])
    assert tk.encoding().decode(ids) == (TEXTS[k] or "")


@given(st.text(alphabet=st.sampled_from("ab' 1-\n中é"), max_size=300), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_cuts_and_runs_are_exact(text, size):
    assert "".join(tk.cuts(text, size)) == text
    assert [i for part in tk.cuts(text, size) for i in plain(part)] == plain(text)
    enc = tk.run_encoding()
    assert tk.encode_run(enc, text, 3) == enc.encode_ordinary(text)


def test_trees_of_long_runs():
    rng = random.Random(3)
    enc = tk.run_encoding()
    for alphabet in ("a", "ab", "abcde", "中文字é", " ", "-=", "🚀é"):
        run = "".join(rng.choice(alphabet) for _ in range(30_000))
        assert tk.encode_run(enc, run, 500, tk._threads().map) == enc.encode_ordinary(run)


def test_long_texts_by_parts(monkeypatch):
    monkeypatch.setattr(tk, "LONG_TEXT", 1_000)
    monkeypatch.setattr(tk, "LONG_PIECE", 100)
    rng = random.Random(1)
    long = ["x" * 5_000, "".join(rng.choice("abc") for _ in range(7_000)), " ".join(rng.choice(["one", "two's", "3", "四"]) for _ in range(2_000)), "中" * 4_000 + " mixed text " * 300, "a b " * 300 + "-" * 900 + " c d" * 300]
    for text in long:
        assert tk.encode(text).tolist() == plain(text)


def test_one_scan_without_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 40_000), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    plan = tk.token_ids(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def test_long_texts_in_parallel(spark):
    rng = random.Random(1)
    long = ["x" * 500_000, "y z" * 100_000, "".join(rng.choice("abc") for _ in range(7_000)), " ".join(rng.choice(["one", "two's", "3", "四"]) for _ in range(2_000)), "中" * 4_000 + " mixed text " * 300]
    df = spark.createDataFrame(list(enumerate([*TEXTS[:6], *long])), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.id: r.ids for r in tk.token_ids(df, "doc_id", "text").collect()}
    assert got == {r.doc_id: plain(r.text) for r in df.collect()}
    assert {r.id: r.ids for r in tk.token_ids(df, "doc_id", "text", counts=True).collect()} == {k: len(v) for k, v in got.items()}


def best_fill(window, counts):
    sums = {0}
    for s, n in counts.items():
        sums |= {x + s * k for x in sums for k in range(n + 1) if x + s * k <= window}
    return max(sums)


@given(st.integers(0, 60), st.dictionaries(st.integers(1, 30), st.integers(0, 5), max_size=6))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best(window, counts):
    found = p7.fill(window, counts)
    assert all(0 < n <= counts[s] for s, n in found.items())
    assert sum(s * n for s, n in found.items()) == best_fill(window, counts)


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), max_size=8))
@settings(max_examples=100, deadline=None)
def test_plan_places_each_item_once(counts):
    load, placed = Counter(), Counter()
    for s, first, last, each, container in p7.plan(counts, 20):
        for k in range(first, last + 1):
            load[container + (k - first) // each] += s
            placed[s, k] += 1
    assert placed == Counter({(s, k): 1 for s, n in counts.items() for k in range(n)})
    assert max(load.values(), default=0) <= 20
    assert len(load) <= 1 + sum(s * n for s, n in counts.items()) // 10


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(p7, "NUMBERED_AT_ONCE", 50)
    rng = random.Random(2)
    sized = [(k, rng.choice([0, 3, 7, 7, 7, 12, 25, 64, 130])) for k in range(400)]
    df = spark.createDataFrame(sized, "doc_id bigint, n_tokens int")
    kinds = spark.createDataFrame([("s", 32), ("s", 32), ("m", 64), (None, 16), ("bad", None), ("zero", 0)], "container_kind string, capacity_tokens int").where("container_kind is not null")
    rows = p7.packed(df, kinds).collect()
    load, parts = Counter(), defaultdict(list)
    for r in rows:
        parts[r.container_kind, r.doc_id].append((r.first_token, r.n_tokens))
        assert (r.container_no is None) == (r.n_tokens == 0)
        if r.n_tokens:
            load[r.container_kind, r.container_no] += r.n_tokens
    assert {k for k, _ in parts} == {"s", "m"} and len(parts) == 800
    for (kind, doc), own in parts.items():
        n, cap = dict(sized)[doc], {"s": 32, "m": 64}[kind]
        assert sum(x for _, x in own) == n and len(own) == max(1, -(-n // cap))
        assert sorted(own)[0][0] == 0
    assert all(x <= {"s": 32, "m": 64}[k] for (k, _), x in load.items())
    total = sum(n for _, n in sized)
    assert len([1 for k, _ in load if k == "m"]) <= total // 64 + 3
    assert p7.packed(df.limit(0), kinds).count() == 0
