"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.session import configure

#: Fixed by the query contracts: a word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


class Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def prepared(df: DataFrame) -> DataFrame:
    """Session settings for a frame whose session the caller made: the workers'
    import path, the shared checkpoint folder, batches for Python workers small
    enough for very long texts, and the removal of an execution's shuffle files
    at its end (what outlives it is in the checkpoint folder)."""
    configure(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return df


def fingerprint(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of ``cols`` as columns ``k1`` and ``k2``:
    one 128-bit key that is never null. Rows equal in ``cols`` share it."""
    return [F.xxhash64(F.lit(1), *cols).alias("k1"), F.xxhash64(F.lit(2), *cols).alias("k2")]


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """The whole input row as one struct ``row`` beside ``extra``, so that the
    caller's column names can't clash with an operator's own."""
    return docs.select(F.struct("*").alias("row"), *extra)


def hash_sample(rows: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows: those with the least hashes of ``cols``, which should
    tell rows apart. A first cut at a hash below which about twice as many lie
    leaves few rows to order, however many partitions there are."""
    total = rows.count()
    h = F.xxhash64(F.lit(11), *cols)
    if total > 4 * n:
        rows = rows.filter(F.shiftrightunsigned(h, 11) < int(2 * n / total * (1 << 53)))
    return rows.orderBy(h, *cols).limit(n)


def global_prefix(rows: DataFrame, order: list[str], measures: list[str]) -> DataFrame:
    """``rows`` plus, for each measure m, ``p_m``: the sum of m over all rows
    before this one in ``order`` (which must be a total order up to rows that
    are interchangeable).

    Range partitioning by ``order`` gives contiguous, even partitions whatever
    the keys; the partitions are written to the shared checkpoint folder so that
    totals and running sums see the same ones. Only one row of totals per
    partition meets in one task."""
    parts = rows.repartitionByRange(*order).withColumn("pid__", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("pid__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("pid__").agg(*[F.sum(m).alias(f"t_{m}") for m in measures])
               .select("pid__", *[F.coalesce(F.sum(f"t_{m}").over(before), F.lit(0)).alias(f"o_{m}")
                                  for m in measures]))
    running = Window.partitionBy("pid__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition: its size is bounded by the number of partitions
    return (parts.select("*", *[F.sum(m).over(running).alias(f"r_{m}") for m in measures])
            .join(F.broadcast(offsets), "pid__")
            .select(*rows.columns,
                    *[(F.col(f"o_{m}") + F.col(f"r_{m}") - F.col(m)).alias(f"p_{m}") for m in measures]))
