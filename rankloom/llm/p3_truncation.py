"""Problem 3: text cut off by field limits.

A backward character n-gram model counts, for contexts read from their last character back, how often a
text ends after them and how often it goes on. For the final context of each text the two likelihoods are
interpolated from short contexts to long ones (without the text's own end) and compared with the rate at
which texts of that language end; a text whose log-odds are below the threshold of its language and column
was cut, unless it ends with a sentence's stop and so not inside a sentence. A text cut in transfer may end
inside a character, an entity or an element; then nothing is left to estimate. Continuations are only counted for contexts that some text ends with;
counts are exact and stay distributed, and the driver only holds bits of a fixed number, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.durable import cut
from rankloom.plans.skew import salted_join


#: Lengths of the contexts in characters, and slots of the bits that tell which may be an end.
ORDERS = (2, 4, 6, 9, 13, 18, 24)
SLOT_BITS = 24
#: Counts that a task holds before it hands them on.
HELD = 4_000_000
#: Weight of the shorter context in the estimate by the next longer one.
BACKOFF = 4.0
#: Log-odds below which a text counts as cut, plain ones and those with a mark of omission, of languages and columns too small for a distribution of their own.
THRESHOLD, MARKED_THRESHOLD = 0.7, 2.0
#: Texts that end from which a group's own distribution sets its threshold, how far that may be from the value above, the width of a bin, and the share of the highest that is few.
GROUP, REACH, BIN, SPARSE = 1000, 1.25, 0.25, 0.1
#: Marks of omission at the end of a text.
MARKS = r"(?:\s*(?:…|\.{3,}|\.(?: \.){2,}|。{3,}|\[(?:…|\.{3})\]|\((?:…|\.{3})\)|&hellip;))+\s*$"
#: A stop that ends a sentence, with what may close after it; after a digit it may be a decimal point.
CLOSED = r"(?:[。！？]|[^0-9\s][.!?])[\"'”’)）」』】]*\s*(?:[(（][^()（）]{1,30}[)）])?[^\p{L}\p{N}\p{P}]*$"
#: Entities that a text may be cut in.
_ENTITIES = "amp lt gt quot apos nbsp hellip mdash ndash lsquo rsquo ldquo rdquo laquo raquo middot copy".split()
#: An end inside an entity, in a tag, or in an element that stresses words.
BROKEN = rf"&(?:#[0-9A-Za-z]{{0,6}}|{'|'.join(sorted({n[:k] for n in _ENTITIES for k in range(2, len(n) + 1)}))})?$|</?[A-Za-z][^<>]*$|<(?:em|b|i|strong|mark)>[^<>]*$"
_TAG = "</?[A-Za-z][^<>]*>"
_SEP, _START = "\x00", "\x01"
_MASK = (1 << 64) - 1
_BASE, _MIX, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), 0xD6E8FEB86659FD93


def marked(text: Column) -> Column:
    """True for a text that ends with a mark of omission."""
    return F.substring(text, -40, 40).rlike(MARKS)


def normal(text: Column) -> Column:
    """Text with white space collapsed, tags dropped, numbers masked and marks of omission at its end dropped."""
    t = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, _TAG, "")).otherwise(text)
    t = F.translate(F.regexp_replace(t, r"[\s\u00a0\u3000]+", " "), "\x00\x01", "")
    t = F.when(marked(text), F.regexp_replace(t, MARKS, "")).otherwise(t)
    return F.btrim(F.regexp_replace(t, r"[0-9]+", "#"), F.lit(" "))


#: Scripts by which languages are told apart, the first that a text has letters of (two in a row, but for kana, which mix); any other text is 'latin'.
SCRIPTS = {"kana": "[ぁ-ヿ]", "han": "[㐀-鿿]{2}", "hangul": "[가-힯]{2}", "cyrillic": "[Ѐ-ӿ]{2}", "arabic": "[؀-ۿ]{2}", "greek": "[Ͱ-Ͽ]{2}", "devanagari": "[ऀ-ॿ]{2}", "thai": "[฀-๿]{2}"}


def language(text: Column) -> Column:
    """The script of a text, of SCRIPTS; 'latin' where it has none of them."""
    out = F.lit("latin")
    for name, letters in reversed(SCRIPTS.items()):
        out = F.when(text.rlike(letters), name).otherwise(out)
    return F.when(text.rlike("[^\x00-\u024f]"), out).otherwise("latin")


def broken(text: Column) -> Column:
    """True for an end inside a character (of a text that is sound before it), an entity or an element."""
    t = F.rtrim(text)
    has = lambda sign: F.contains(text, F.lit(sign))
    return ((has("&") | has("<")) & t.rlike(BROKEN)) | (has("\ufffd") & t.rlike("^[^\ufffd]*\ufffd{1,3}$"))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer((_SEP + "".join(f"{_START}{t}{_SEP}" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _contexts(codes: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, keys) for the k-th order: contexts that end at the positions and lie within a text.

    With ``known``, only contexts whose bit is set there; a longer one whose shorter one isn't can't be an end either.
    """
    h, power, done = np.zeros(len(at), np.uint64), 1, 0
    for k, order in enumerate(ORDERS):
        inside = np.ones(len(at), bool)
        for back in range(done, order):
            x = codes[np.maximum(at - back, 0)]
            inside &= x != 0
            h = h + (x + np.uint64(7)) * np.uint64(power)
            power = power * _BASE & _MASK
        done = order
        at, h = at[inside], h[inside]
        mixed = h + np.uint64((k + 1) * _STEP & _MASK)
        keys = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        if known is not None:
            slots = keys >> np.uint64(59 - known.shape[1].bit_length())  # 64 slots a word
            is_set = (known[k][slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
            at, h, keys = at[is_set], h[is_set], keys[is_set]
        yield k, at, keys.view(np.int64)


def _of_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tail_id, k, key, n`` of the final contexts of ``tail_id, tail, n``."""
    for batch in batches:
        codes = _codes(batch.column(1).to_pylist())
        last = np.flatnonzero(codes == 0)[1:] - 1
        for k, at, keys in _contexts(codes, last):
            rows = batch.take(pa.array(np.searchsorted(last, at)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(at), k, np.int32)), pa.array(keys), rows.column(2)], ["tail_id", "k", "key", "n"])


def _count_on(spark: SparkSession, words: np.ndarray):
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, size = shared.value.reshape(len(ORDERS), -1), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in kept])).astype(np.int64)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 2000):
                codes = _codes(texts[i : i + 2000])
                at = np.flatnonzero((codes[:-1] > 1) & (codes[1:] != 0))
                for _, _, keys in _contexts(codes, at, known):
                    kept.append(np.unique(keys, return_counts=True))
                    size += len(kept[-1][0])
            if size > HELD:
                kept = [merged()]
                if (size := len(kept[0][0])) > HELD // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, kept[0])), ["key", "n"])
                    kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), ["key", "n"])

    return run


def _words(ends: DataFrame) -> np.ndarray:
    """A bit for the slot of each end; at most len(ORDERS) << SLOT_BITS - 6 rows come to the driver, whatever the corpus."""
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    word = F.shiftright(slot, 6) + F.col("k").cast("bigint") * (1 << SLOT_BITS - 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    got = ends.select(word.alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(len(ORDERS) << SLOT_BITS - 6, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def counts(texts: DataFrame) -> DataFrame:
    """``tail_id``, ``k``, ``ends``, ``on`` of the final contexts of each distinct ``tail``, from ``text`` (normal), ``address``, ``tail``, ``tail_id``.

    Copies of a text at one address count as one end. Counts are kept by the context's 64-bit hash; the bits only
    spare counting contexts that no text ends with, and what passes them by chance finds no end to join.
    """
    # a tail shorter than the longest context is the whole text
    tails = texts.select("tail_id", "tail", "address").distinct().groupBy("tail_id", "tail").agg(F.count(F.lit(1)).alias("n"))
    contexts = cut(tails.select("tail_id", "tail", "n").mapInArrow(_of_tails, "tail_id bigint, k int, key bigint, n bigint"))
    ends = cut(contexts.groupBy("key", "k").agg(F.sum("n").alias("ends"), F.count(F.lit(1)).alias("_n")))
    on = texts.select("text").mapInArrow(_count_on(texts.sparkSession, _words(ends)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("on"))
    model = ends.join(on, "key", "left").select("key", "ends", F.coalesce("on", F.lit(0)).alias("on"))
    # short contexts are few and frequent
    return salted_join(contexts.select("tail_id", "k", "key"), model, ["key"], by="tail_id", counts=ends.select("key", "_n")).select("tail_id", "k", "ends", "on")


def rates(counted: DataFrame) -> DataFrame:
    """``tail_id``, ``fixed``, ``slope``: the rate at which texts end after the tail is fixed + slope * the rate without context."""
    step = lambda r, x: F.struct(
        ((F.greatest(x.ends - 1, F.lit(0)) + BACKOFF * r.fixed) / (F.greatest(x.ends - 1, F.lit(0)) + x.on + BACKOFF)).alias("fixed"),
        (BACKOFF * r.slope / (F.greatest(x.ends - 1, F.lit(0)) + x.on + BACKOFF)).alias("slope"),
    )
    chain = F.sort_array(F.collect_list(F.struct("k", "ends", "on")))
    r = counted.groupBy("tail_id").agg(chain.alias("chain")).withColumn("r", F.aggregate("chain", F.struct(F.lit(0.0).alias("fixed"), F.lit(1.0).alias("slope")), step))
    return r.select("tail_id", "r.fixed", "r.slope")


def base_rates(texts: DataFrame) -> dict[str, float]:
    """The rate at which the texts of each ``language`` end, of ``language``, ``text``."""
    sizes = texts.groupBy("language").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).collect()
    return {r.language: min(0.5, max(1e-9, r.n / max(1, r.chars))) for r in sizes}


def valley(histogram: dict[int, int], start: float) -> float:
    """Log-odds where a group's texts, counted by bin, stop getting fewer down from the many that end; ``start`` if few of them end."""
    if sum(n for b, n in histogram.items() if b * BIN >= start) < GROUP:
        return start
    smooth = lambda b: sum(w * histogram.get(b + d, 0) for d, w in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)))
    b = max((b for b in histogram if b * BIN >= start), key=smooth)
    peak = smooth(b)
    while b * BIN > start - REACH and (smooth(b - 1) < smooth(b) or smooth(b) > SPARSE * peak):
        b -= 1
    return min(start + REACH, max(start - REACH, (b + 0.5) * BIN))


def scored(results: DataFrame) -> DataFrame:
    """``result_id``, ``source``, ``language``, ``marked``, ``log_odds``, ``cut`` of each snippet that isn't null or blank."""
    raw = results.select("result_id", "source", "snippet", F.xxhash64(F.regexp_replace(F.lower(F.substring_index(F.regexp_replace("url", "[?#].*$", ""), "://", -1)), r"^www\.|/\s*$", "")).alias("address"))
    # normal text is made once and kept for the passes of the model
    texts = cut(raw.withColumn("marked", marked(F.col("snippet"))).withColumn("broken", broken(F.col("snippet"))).withColumn("text", normal(F.col("snippet"))).drop("snippet")).where("text <> '' or marked")
    texts = texts.withColumn("language", language(F.col("text"))).withColumn("tail", F.substring("text", -40, 40)).withColumn("tail_id", F.xxhash64("tail"))
    rate_of = base_rates(texts)
    base = F.element_at(F.create_map(*(F.lit(x) for pair in (rate_of or {"": 0.5}).items() for x in pair)), F.col("language"))
    t = texts.select("result_id", "source", "marked", "broken", "language", "tail_id", (F.col("tail").rlike(CLOSED) & ~F.col("marked")).alias("closed"))
    rate = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.coalesce("fixed", F.lit(0.0)) + F.coalesce("slope", F.lit(1.0)) * base))
    t = salted_join(t, rates(counts(texts)), ["tail_id"], by="result_id", how="left")  # a tail may be very frequent
    t = t.withColumn("log_odds", F.log(rate / (1 - rate)) - F.log(base / (1 - base))).drop("tail_id", "fixed", "slope")
    t = cut(t)
    # the texts that the threshold decides on set it
    histograms: dict[tuple[str, bool], dict[int, int]] = {}
    for r in t.where("not closed and not broken").groupBy("language", "marked", F.floor(F.col("log_odds") / BIN).alias("bin")).count().collect():  # a bounded number of bins for each of a few scripts
        histograms.setdefault((r.language, r.marked), {})[r.bin] = r["count"]
    bound = F.when(F.col("marked"), MARKED_THRESHOLD).otherwise(THRESHOLD)
    for (lang, mark), own in histograms.items():
        bound = F.when((F.col("language") == lang) & (F.col("marked") == mark), valley(own, MARKED_THRESHOLD if mark else THRESHOLD)).otherwise(bound)
    return t.withColumn("cut", F.col("broken") | (F.col("log_odds") < bound) & ~F.col("closed")).drop("closed", "broken")


def truncated(results: DataFrame) -> DataFrame:
    """``result_id`` of each snippet that was cut.

    Null, empty and blank snippets are never cases; repeated rows are cases each. A snippet that consists
    of marks of omission only counts as cut. Empty tables give no rows.
    """
    return scored(results).where("cut").select("result_id")


def truncation_by_source(results: DataFrame) -> DataFrame:
    """``source`` (each engine of a joined one), ``snippets``, ``cut``, ``share``; rows without a source count under null."""
    s = scored(results).withColumn("source", F.explode_outer(F.split("source", r"\+")))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("snippets"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(spark.read.parquet(f"{sf_dir}/search_results.parquet"))


def p3_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(spark.read.parquet(f"{sf_dir}/search_results.parquet"))
