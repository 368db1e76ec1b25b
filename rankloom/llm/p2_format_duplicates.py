"""Problem 2: records that differ only in formatting.

Two records are copies if they have the same query, the same canonical address and the same canonical
title. The canonical hash of every record goes into Bloom filters that each partition builds for itself,
one of hashes seen and one of hashes seen again, and that are merged segment by segment. Only records
whose hash the merged "again" filter holds are shuffled for exact grouping; all others are singletons
without a shuffle. A false positive of the filter only costs a shuffled record, and a repeat can't be
missed, so the result is exact at any filter size.

The filter grows with the records, a segment for each RECORDS_A_SEGMENT of them, so its false positives stay
as rare at any size. A partition hands on a segment as bits or, where it has few records for it, as their
hashes, whichever is smaller: never more than eight bytes a record, however many partitions there are. The
merged segments are a table; they are probed in groups of SEGMENTS_AT_ONCE, one broadcast each, by the records
whose hashes lie in the group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.constants import SPACE, TRACKING_PARAMS
from rankloom.plans.durable import cut

#: Bits of a segment, records for which there is one (16 bits each), and segments that are probed at once (64 MB).
SEGMENT_BITS, RECORDS_A_SEGMENT, SEGMENTS_AT_ONCE = 1 << 20, 1 << 16, 512
PROBES = 4
#: A group of more copies than this is joined by broadcast instead of being shuffled to one task.
HOT_COPIES = 1_000_000
_FILTERS = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("again", pa.binary()), ("hashes", pa.binary())])


#: White space and controls around an address.
_OUTER = "".join(map(chr, [*range(0x21), 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_VALID = r"^https?://(?:[^/?#@\s]*@)?[^/?#:\s]"


def with_keys(df: DataFrame) -> DataFrame:
    """``df`` with ``url_key`` and ``title_key``, made of its ``url`` and ``title``.

    The key of an address has no letter case, outer blanks, scheme, ``www.``, closing slash, fragment,
    tracking parameters or parameter order; it is null for an address that is null or not http or https.
    The key of a title has no letter case, white space, invisible characters or punctuation, and the parts
    that a bar, middle dot or dash between blanks divides are in order; a title of nothing but punctuation
    stays as it is, and a null or blank one has a null key. Each step is a projection of its own, so that
    no expression is evaluated twice.
    """
    u, t = F.col("_u"), F.col("_t")
    gone = F.array(*[F.lit(x) for x in TRACKING_PARAMS])
    d = df.withColumn("_u", F.lower(F.btrim("url", F.lit(_OUTER)))).withColumn("_t", F.regexp_replace(F.lower("title"), r"[\p{Cf}\p{Cc}&&[^\t\n\r]]|[\ufe00-\ufe0f\u034f\u115f\u1160\u3164]", ""))
    d = d.withColumn("_u", F.when(u.rlike(_VALID), F.substring_index(F.regexp_replace(u, r"^https?://(?:www\.)?", ""), "#", 1)))
    d = d.withColumn("_way", F.substring_index(u, "?", 1)).withColumn("_query", F.when(F.contains(u, F.lit("?")), F.substring(u, F.length(F.col("_way")) + 2, F.length(u))))
    kept = F.filter(F.split("_query", "&"), lambda p: (p != "") & ~F.array_contains(gone, F.substring_index(p, "=", 1)))
    pairs = F.array_join(F.array_sort(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")
    way = F.when(F.endswith("_way", F.lit("/")), F.substring(F.col("_way"), F.lit(1), F.length("_way") - 1)).otherwise(F.col("_way"))
    d = d.withColumn("url_key", F.concat(way, F.lit("?"), F.when(F.col("_query").isNull(), "").otherwise(pairs)))
    marks, bar = rf"[\p{{P}}|`~^｜]|{SPACE}", rf"{SPACE}+[|｜·•\-‐‑‒–—―]+{SPACE}+"
    several = F.array_join(F.array_sort(F.transform(F.split(t, bar), lambda p: F.regexp_replace(p, marks, ""))), "")
    d = d.withColumn("_joined", F.when(t.rlike(bar), several).otherwise(F.regexp_replace(t, marks, "")))
    d = d.withColumn("title_key", F.when(F.col("_joined") != "", F.col("_joined")).otherwise(F.nullif(F.regexp_replace(t, SPACE, ""), F.lit(""))))
    return d.drop("_u", "_t", "_way", "_query", "_joined")


def keyed(results: DataFrame) -> DataFrame:
    """``result_id``, ``query_id``, both keys and the canonical hash ``h``, null for records without copies; written to the shared folder."""
    k = with_keys(results.select("result_id", "query_id", "url", "title")).drop("url", "title")
    whole = F.col("query_id").isNotNull() & F.col("url_key").isNotNull() & F.col("title_key").isNotNull()
    return cut(k.withColumn("h", F.when(whole, F.xxhash64("query_id", "url_key", "title_key"))))


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each hash; its bits there, in PROBES rows)."""
    u = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # the segment takes the upper bits of the hash itself
    a, b = u >> np.uint64(42), (u >> np.uint64(20)) & np.uint64(0x3FFFFF) | np.uint64(1)
    return _segment(h, segments), np.stack([(a + np.uint64(i) * b + np.uint64(i * i)) % np.uint64(SEGMENT_BITS) for i in range(PROBES)]).astype(np.int64)


def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places.ravel() >> 3, (1 << (places.ravel() & 7)).astype(np.uint8))


def _held(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _bits(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(once, again) of the different hashes ``h`` of one segment, seen ``n`` times."""
    once, again = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
    places = _places(h, 1)[1]
    _put(once, places)
    _put(again, places[:, n > 1])
    return once, again


#: Different hashes that a partition holds before it hands their segments on.
_AT_ONCE = 4_000_000


def _partition_filters(segments: int):
    def parts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        segment = _segment(h, segments)
        order = np.argsort(segment, kind="stable")
        h, n, segment = h[order], n[order], segment[order]
        names, starts = np.unique(segment, return_index=True)
        for s, own, times in zip(names.tolist(), np.split(h, starts[1:]), np.split(n, starts[1:]), strict=True):
            if 8 * len(own) < 2 * SEGMENT_BITS // 8:  # a repeated hash is handed on twice
                row = {"segment": [s], "once": [None], "again": [None], "hashes": [np.repeat(own, np.minimum(times, 2)).tobytes()]}
            else:
                once, again = _bits(own, times)
                row = {"segment": [s], "once": [once.tobytes()], "again": [again.tobytes()], "hashes": [None]}
            yield pa.RecordBatch.from_pydict(row, schema=_FILTERS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(held[-1])
            if size >= _AT_ONCE:
                yield from parts(held)
                held, size = [], 0
        if size:
            yield from parts(held)

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of a segment into one, with the partition sorted by segment: a bit that two parts set once is set again."""
    at, once, again, few = -1, None, None, []

    def add(o: np.ndarray, g: np.ndarray) -> None:
        nonlocal once, again
        once, again = (o, g) if once is None else (once | o, again | g | (once & o))

    def done() -> pa.RecordBatch:
        if few:
            add(*_bits(*np.unique(np.concatenate(few), return_counts=True)))
        return pa.RecordBatch.from_pydict({"segment": [at], "again": [again.tobytes()]}, schema=pa.schema([("segment", pa.int32()), ("again", pa.binary())]))

    for batch in batches:
        for s, o, g, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != at and at >= 0:
                yield done()
                once, again, few = None, None, []
            at = s
            if hashes is None:
                add(np.frombuffer(o, np.uint8), np.frombuffer(g, np.uint8))
            else:
                few.append(np.frombuffer(hashes, np.int64))
    if at >= 0:
        yield done()


def segments_for(records: int) -> int:
    """Segments of the filter for so many records."""
    return max(1, -(-records // RECORDS_A_SEGMENT))


def repeat_filter(hashes: DataFrame, segments: int) -> DataFrame:
    """``segment``, ``again`` of the only column of ``hashes``: bits of the hashes that may occur more than once; written to the shared folder."""
    parts = hashes.mapInArrow(_partition_filters(segments), "segment int, once binary, again binary, hashes binary")
    merged = parts.repartition(max(1, min(segments, 4_096)), "segment").sortWithinPartitions("segment")
    return cut(merged.mapInArrow(_merge, "segment int, again binary"))


def _maybe_repeated(spark: SparkSession, segments: int, first: int, bitmap: np.ndarray):
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def probe(h):  # noqa: ANN001, ANN202
        import pandas as pd

        segment, places = _places(h.to_numpy(), segments)
        return pd.Series(_held(shared.value, places + (segment - first) * SEGMENT_BITS))

    return probe


def split_by_filter(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(possible repeats with their keys; certain singletons)."""
    spark = results.sparkSession
    k = keyed(results)
    whole = k.where("h is not null")
    segments = segments_for(k.count())  # of a written table: read from its footers
    filters = repeat_filter(whole.select("h"), segments)
    segment_of = F.pmod(F.shiftrightunsigned("h", 33), F.lit(segments))
    maybe, single = [], k.where("h is null").select("result_id", "query_id")
    for first in range(0, segments, SEGMENTS_AT_ONCE):
        bitmap = np.zeros(min(SEGMENTS_AT_ONCE, segments - first) * SEGMENT_BITS // 8, np.uint8)
        for row in filters.where(F.col("segment").between(first, first + SEGMENTS_AT_ONCE - 1)).toLocalIterator():  # 64 MB at most
            at = (row.segment - first) * SEGMENT_BITS // 8
            bitmap[at : at + SEGMENT_BITS // 8] = np.frombuffer(bytes(row.again), np.uint8)
        own = whole if segments <= SEGMENTS_AT_ONCE else whole.where(segment_of.between(first, first + SEGMENTS_AT_ONCE - 1))
        probed = own.withColumn("maybe", _maybe_repeated(spark, segments, first, bitmap)("h"))
        maybe.append(probed.where("maybe").select("result_id", "query_id", "url_key", "title_key"))
        single = single.unionByName(probed.where("not maybe").select("result_id", "query_id"))
    return cut(functools.reduce(DataFrame.unionByName, maybe)), single


def collapsed(results: DataFrame) -> DataFrame:
    """One row for each record and its formatting copies: ``first_id``, ``query_id``, ``copies``.

    ``first_id`` is the smallest result_id, ``copies`` the number of records including it. Records with a
    null query, an address that is null, empty or not http(s), or a null or blank title have no copies:
    each is a row of its own. Repeated rows under different ids count. An empty table gives no rows.
    """
    maybe, single = split_by_filter(results)
    groups = maybe.groupBy("query_id", "url_key", "title_key").agg(F.min("result_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).select("first_id", "query_id", "copies")
    return groups.unionByName(single.select(F.col("result_id").alias("first_id"), "query_id", F.lit(1).cast("bigint").alias("copies")))


def copies(results: DataFrame) -> DataFrame:
    """``first_id``, ``copy_id``: each copy with the smallest result_id of its set."""
    maybe, _ = split_by_filter(results)
    keys = ["query_id", "url_key", "title_key"]
    groups = cut(maybe.groupBy(*keys).agg(F.min("result_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = F.broadcast(groups.where(F.col("n") > HOT_COPIES))  # at most one row for every HOT_COPIES records
    hot_rows = maybe.join(hot, keys)
    cold_rows = maybe.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("n") <= HOT_COPIES), keys)
    pairs = hot_rows.unionByName(cold_rows).where("result_id <> first_id")
    return pairs.select("first_id", F.col("result_id").alias("copy_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/search_results.parquet"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(spark.read.parquet(f"{sf_dir}/search_results.parquet"))
