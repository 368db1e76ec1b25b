"""Problem 7: texts into containers of fixed capacity.

The number of texts of each size is all that the plan depends on, and it has at most ``capacity`` rows
whatever the size of the corpus. The driver fills container after container by minimum bin slack on that
histogram: the largest remaining size opens a container, and a subset-sum dynamic programme over a bitset
finds the multiset of remaining sizes that fills the rest of it (the window) closest to the capacity; the
counts are traced back and the pattern is used as often as they allow. The texts are then numbered within
their size, in salted groups, and look their container up in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.tokenizer import VOCABULARY, token_ids
from rankloom.plans.durable import cut
from rankloom.plans.skew import bounded

#: Texts of one size are numbered in groups of about this many.
NUMBERED_AT_ONCE = 500_000
#: Kinds of containers that are broadcast; more are joined without.
MOST_KINDS = 1_000


def fill(window: int, counts: Mapping[int, int]) -> dict[int, int]:
    """Multiset of sizes, within ``counts``, whose sum comes closest to ``window`` from below."""
    bits, whole, steps = 1, (1 << (window + 1)) - 1, []
    for size in sorted((s for s, n in counts.items() if n > 0 and s <= window), reverse=True):
        left, chunk = min(counts[size], window // size), 1
        while left:  # chunks of 1, 2, 4, ... copies make every number of copies
            n = min(chunk, left)
            steps.append((size, n, bits))
            bits |= (bits << (size * n)) & whole
            left -= n
            chunk *= 2
        if bits >> window & 1:
            break
    target, found = bits.bit_length() - 1, {}
    for size, n, before in reversed(steps):
        if not before >> target & 1:
            target -= size * n
            found[size] = found.get(size, 0) + n
    return found


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first, last, each, container): items ``first`` to ``last`` of a size, ``each`` to a container, from ``container`` on."""
    left = {s: n for s, n in counts.items() if n > 0}
    given: dict[int, int] = dict.fromkeys(left, 0)
    rows, container = [], 0
    while left:
        largest = max(left)
        left[largest] -= 1
        pattern = fill(capacity - largest, left)
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            rows.append((s, given[s], given[s] + n * times - 1, n, container))
            given[s] += n * times
            left[s] -= n * times
            if not left[s]:
                del left[s]
        container += times
    return rows


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` of each text; 0 for an empty and for a null text."""
    return token_ids(documents, "doc_id", "text", vocabulary, counts=True).select(F.col("id").alias("doc_id"), F.col("ids").alias("n_tokens"))


def packed(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_kind``, ``container_no``, ``doc_id``, ``part_no``, ``first_token``, ``n_tokens``.

    Every text is assigned once for each kind. Only a text larger than the capacity is split: into full
    containers, and its rest is an item like any other. A text without tokens needs no room: its
    ``container_no`` is null. Kinds with a null capacity or one below 1 hold nothing and give no rows; a
    kind that is listed twice counts once. Empty tables give no rows.
    """
    spark = sized.sparkSession
    kinds = containers.where(F.col("capacity_tokens") >= 1).groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    each = sized.crossJoin(bounded(kinds, MOST_KINDS))  # a fixed table of three rows
    n, c = F.col("n_tokens"), F.col("capacity")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, c)).otherwise(F.array(F.lit(0)))
    items = each.select("container_kind", "capacity", "doc_id", "n_tokens", F.posexplode(starts).alias("part_no", "first_token"))
    items = items.withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("first_token"))).drop("n_tokens", "capacity")
    salt_of = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(max(1, sized.count() // NUMBERED_AT_ONCE)))
    items = items.withColumn("salt", salt_of.cast("int"))
    tally = cut(items.where("size > 0").groupBy("container_kind", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = tally.select("container_kind", "size", "salt", (F.sum("n").over(Window.partitionBy("container_kind", "size").orderBy("salt")) - F.col("n")).alias("before"))
    capacity = {r.container_kind: r.capacity for r in kinds.collect()}
    counts: dict[str, dict[int, int]] = {k: {} for k in capacity}
    for r in tally.groupBy("container_kind", "size").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        counts[r.container_kind][r["size"]] = r.n
    lookup = {}
    for kind, own in counts.items():
        by_size: dict[int, list] = {}
        for s, first, last, per, container in plan(own, capacity[kind]):
            by_size.setdefault(s, []).append((first, per, container))
        lookup.update({(kind, s): tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in by_size.items()})
    shared = spark.sparkContext.broadcast(lookup)  # as many rows as the plan has, which the capacity bounds

    @F.pandas_udf("bigint")
    def container_of(kind, size, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.empty(len(size), np.int64)
        frame = pd.DataFrame({"k": kind, "s": size, "r": rank}).reset_index(drop=True)
        for (k, s), own in frame.groupby(["k", "s"]):
            first, per, container = shared.value[k, s]
            r = own["r"].to_numpy(np.int64)
            at = np.searchsorted(first, r, side="right") - 1
            out[own.index] = container[at] + (r - first[at]) // per[at]
        return pd.Series(out)

    local = F.row_number().over(Window.partitionBy("container_kind", "size", "salt").orderBy("doc_id", "part_no")) - 1
    ranked = items.where("size > 0").withColumn("local", local).join(before, ["container_kind", "size", "salt"])
    placed = ranked.withColumn("container_no", container_of("container_kind", "size", F.col("before") + F.col("local")))
    columns = ["container_kind", "container_no", "doc_id", "part_no", "first_token", F.col("size").alias("n_tokens")]
    return placed.select(*columns).unionByName(items.where("size = 0").withColumn("container_no", F.lit(None).cast("bigint")).select(*columns))


def p7_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return packed(sized, spark.read.parquet(f"{sf_dir}/containers.parquet"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used by each kind, the tokens in them and the share of room used."""
    capacity = spark.read.parquet(f"{sf_dir}/containers.parquet").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    used = p7_assign(spark, sf_dir).groupBy("container_kind").agg((F.max("container_no") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(capacity), "container_kind").select("container_kind", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("share_used"))
