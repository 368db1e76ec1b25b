"""Problem 8: subject areas of documents.

A text is the average of the embeddings of its words and of their subwords (hashed character 5-grams), with
an independent logistic output for each subject. Words in brackets or between asterisks, as interjections
stand there, have embeddings of their own, so training tells what they count for. The embeddings and outputs
are trained on the hand labels: in every step each partition computes the gradient over its blocks of
documents for the same model, the driver adds the gradients and takes one Adam step, so the result doesn't
depend on how the rows are divided. Then every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.durable import cut

#: The model is fitted on at most this many labelled documents, taken by the hash of their ids.
LABELLED_DOCUMENTS = 8_000
STEPS, RATE = 60, 0.05
#: Documents of a block; a block is a partition of the training.
BLOCK = 1_000
BITS, WIDTH, SUBWORD = 18, 24, 5
#: Probability from which on a text has a subject; the likeliest one it has in any case.
LIKELY = 0.25
#: A subject stands alone if the labels never have it beside another one though they would be expected to so often.
EXPECTED_TOGETHER = 5

#: Passages in brackets or between asterisks.
_ASIDE = re.compile(r"(\([^()]*\)|\[[^\[\]]*\]|\*[^*\n]*\*)")
_HYPHENATED = re.compile(r"(\w)-[ \t]*\r?\n\s*(\w)")
_WORD = re.compile(r"[^\W\d_]+")


class Features:
    """Hashed features of a text: each word and, of longer ones, its subwords; words of asides by themselves."""

    def __init__(self) -> None:
        self.of: dict[str, list[int]] = {}

    def _word(self, w: str, aside: int) -> list[int]:
        padded = f"<{w}>"
        parts = [w, *(padded[k : k + SUBWORD] for k in range(len(padded) - SUBWORD + 1))] if len(w) > 4 and not aside else [w]
        return [zlib.crc32(p.encode(), aside) >> (32 - BITS) for p in parts]

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        text = _HYPHENATED.sub(r"\1\2", text).lower()
        for aside, passage in enumerate(_ASIDE.split(text)):
            aside %= 2
            for w in _WORD.findall(passage):
                key = "*" + w if aside else w
                f = self.of.get(key)
                if f is None:
                    f = self._word(w, aside)
                    if len(self.of) < 200_000:
                        self.of[key] = f
                out += f
        return out


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different features of each text and the share of its features that each is."""
    make = Features()
    for batch in batches:
        x, w = [], []
        for t in batch.column(1).to_pylist():
            at, n = np.unique(np.array(make(t), np.int32), return_counts=True)
            x.append(at)
            w.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float32())), batch.column(2)], ["doc_id", "x", "w", "y"])


#: A block: features in the order of the documents, with their weights; where each document begins; the same features in their own order, and where each begins.
_BLOCK = {"at": np.int32, "w": np.float32, "begins": np.int32, "doc": np.int32, "order": np.int32, "touched": np.int32, "starts": np.int32, "y": np.float32}


def _blocks(known, subjects: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        rows = [r for r in rows if r[0]]  # a text without words teaches nothing
        if not rows:
            return
        y = np.zeros((len(rows), subjects), np.float32)
        for k, r in enumerate(rows):
            y[k, r[2]] = 1
        at = np.searchsorted(known.value, np.concatenate([np.array(r[0], np.int32) for r in rows])).astype(np.int32)
        sizes = np.array([len(r[0]) for r in rows])
        order = np.argsort(at, kind="stable")
        touched, starts = np.unique(at[order], return_index=True)
        own = {"at": at, "w": np.concatenate([np.array(r[1], np.float32) for r in rows]), "begins": np.cumsum(sizes) - sizes, "doc": np.repeat(np.arange(len(rows)), sizes), "order": order, "touched": touched, "starts": starts, "y": y}
        yield pa.RecordBatch.from_pydict({k: [np.ascontiguousarray(own[k], kind).tobytes()] for k, kind in _BLOCK.items()}, schema=pa.schema([(k, pa.binary()) for k in _BLOCK]))

    return run


def _gradient(shared):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, bias = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                b = {k: np.frombuffer(row[k], kind) for k, kind in _BLOCK.items()}
                y = b["y"].reshape(-1, len(bias))
                h = np.add.reduceat(table[b["at"]] * b["w"][:, None], b["begins"], axis=0)
                g = 1 / (1 + np.exp(-(h @ weights + bias))) - y
                back = (g @ weights.T).astype(np.float32)
                of_feature = np.add.reduceat(back[b["doc"][b["order"]]] * b["w"][b["order"]][:, None], b["starts"], axis=0)
                out = {"touched": row["touched"], "table": of_feature.astype(np.float32).tobytes(), "weights": (h.T @ g).astype(np.float32).tobytes(), "bias": g.sum(axis=0).astype(np.float32).tobytes()}
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in out.items()}, schema=pa.schema([(k, pa.binary()) for k in out]))

    return run


def alone(y: list[list[int]], subjects: int) -> list[bool]:
    """For each subject: do the labels never have it beside another, though by chance EXPECTED_TOGETHER documents would?"""
    several = sum(len(own) > 1 for own in y) / max(1, len(y))
    count = np.bincount(np.array([s for own in y for s in own], np.int64), minlength=subjects)
    beside = np.bincount(np.array([s for own in y if len(own) > 1 for s in own], np.int64), minlength=subjects)
    return [bool(b == 0 and n * several >= EXPECTED_TOGETHER) for n, b in zip(count, beside, strict=True)]


def train(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """(known features, their embeddings, output weights, biases, which subjects stand alone)."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    index = F.create_map(*[x for k, s in enumerate(subjects) for x in (F.lit(s), F.lit(k))]) if subjects else F.lit(None)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.array_sort(F.collect_set(index[F.col("subject")])).alias("y"))
    own = cut(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_DOCUMENTS))
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(own), "doc_id")  # the bound above
    rows = cut(texts.mapInArrow(_featurize, "doc_id bigint, x array<int>, w array<float>, y array<int>"))
    known = rows.select(F.explode("x").alias("f")).distinct().orderBy("f").toArrow().column("f").to_numpy().astype(np.int32)
    rng = np.random.default_rng(0)
    model = [rng.normal(0, 0.1, (len(known), WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, len(subjects))).astype(np.float32), np.full(len(subjects), -2, np.float32)]
    total = rows.count()
    if len(known):
        names = sc.broadcast(known)
        divided = rows.repartition(-(-total // BLOCK), "doc_id")
        # a file for each block: the steps read them without a shuffle
        blocks = cut(divided.mapInArrow(_blocks(names, len(subjects)), ", ".join(f"{k} binary" for k in _BLOCK)))
        first, second = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
        for step in range(1, STEPS + 1):
            shared = sc.broadcast(tuple(model))
            grads = [np.zeros_like(p) for p in model]
            for r in blocks.mapInArrow(_gradient(shared), "touched binary, table binary, weights binary, bias binary").collect():  # at most LABELLED_DOCUMENTS / BLOCK rows
                grads[0][np.frombuffer(r.touched, np.int32)] += np.frombuffer(r.table, np.float32).reshape(-1, WIDTH)
                grads[1] += np.frombuffer(r.weights, np.float32).reshape(grads[1].shape)
                grads[2] += np.frombuffer(r.bias, np.float32)
            for p, g, m, v in zip(model, grads, first, second, strict=True):
                g /= total
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            shared.destroy()
    return known, *model, alone([r.y for r in own.select("y").collect()], len(subjects))  # the bound above


def _scorer(shared, subjects: list[str]):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, weights, bias, single = shared.value
        place = np.full(1 << BITS, -1, np.int32)
        place[known] = np.arange(len(known))
        make = Features()
        for batch in batches:
            out_id, out_subject, out_p = [], [], []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = place[np.array(make(text), np.int64)]
                at = at[at >= 0]
                h = table[at].mean(axis=0) if len(at) else np.zeros(table.shape[1], np.float32)
                own = 1 / (1 + np.exp(-(h @ weights + bias)))
                best = int(own.argmax())
                keep = [best] if single[best] else [s for s in range(len(subjects)) if s == best or own[s] >= LIKELY and not single[s]]
                for s in keep:
                    out_id.append(i)
                    out_subject.append(subjects[s])
                    out_p.append(float(own[s]))
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_subject, pa.string()), pa.array(out_p, pa.float64())], ["doc_id", "subject", "probability"])

    return run


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``doc_id``, ``subject``, ``probability``: one row for each subject of a text, the likeliest one at least.

    Null, empty and blank texts give no row. A text without any known word gets the subject that is most
    usual. Labels of unknown subjects or documents don't count. Repeated texts are scored each. Without
    subjects there are no rows; without labels the choice carries no information.
    """
    spark = documents.sparkSession
    subjects = [r.subject for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]  # a fixed table of 13 rows
    texts = documents.where(F.coalesce(F.regexp_replace("text", r"[\s\p{Z}\p{Cf}]", ""), F.lit("")) != "").select("doc_id", "text")
    if not subjects:
        return texts.limit(0).select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("probability"))
    shared = spark.sparkContext.broadcast(train(documents, labels, subjects))
    return texts.mapInArrow(_scorer(shared, subjects), "doc_id bigint, subject string, probability double")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "doc_subjects", "subject_areas")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "subject")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each subject in the corpus; a text of n subjects counts 1/n for each."""
    per = _found(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.collect_set("subject").alias("subjects"))
    each = per.select(F.explode("subjects").alias("subject"), (1 / F.col("k")).alias("w"))
    total = each.agg(F.sum("w").alias("total"))
    return each.groupBy("subject").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("documents")).crossJoin(F.broadcast(total)).select("subject", "documents", F.round(F.col("w") / F.col("total"), 6).alias("share"))
