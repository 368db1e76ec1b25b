"""Joins that a hot key can't slow down, and broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to one part.
ROWS_A_PART = 1_000_000
#: Rows that a table may have to be broadcast.
BROADCAST_ROWS = 200_000


def bounded(table: DataFrame, most: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """``table`` marked for broadcast if it has ``most`` rows or fewer; else as it is, and Spark shuffles both sides.

    With ``of``, a table that has at least as many rows is counted instead, such as the stored one it was made of.
    """
    rows = table.limit(most + 1).count() if of is None else of.count()
    return F.broadcast(table) if rows <= most else table


def salted_join(rows: DataFrame, dimension: DataFrame, keys: list[str], by: str, how: str = "inner", most: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to a smaller table on ``keys``; a key of more than ``most`` (ROWS_A_PART) rows is spread over parts by the hash of ``by``.

    Keys are counted first, in a job of its own with map-side combination, unless the caller has ``counts`` of
    them (``keys`` and ``_n``). The hot ones are at most one for every ``most`` rows; where there are any, they are
    broadcast, and their rows of the smaller table are repeated, once for each part. ``how`` is 'inner', 'left' or
    'left_semi'. Null keys match nothing.
    """
    most = most or ROWS_A_PART
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    found = hot.collect()  # at most a row for every `most` rows
    if not found:
        return rows.join(dimension, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = dimension.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
