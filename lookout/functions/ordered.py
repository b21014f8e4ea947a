"""Ordered-window building blocks that do not put a whole key into one task.

A plain ``Window.partitionBy(host).orderBy(ts)`` sends every row of a host
to one task; with a host holding a third of the data that task is the job.
``ordered_parts`` range-partitions rows by (key, order) instead: even
partitions whatever the keys hold, each a contiguous stretch of the global
order. Windows then run within a partition, and what a key needs from the
partition before is carried over its edge through a table of one row per
partition:

* ``prefix_sums``   running sums per key;
* ``lag_values``    previous row's values per key;
* ``rows_frame``    last ``n`` rows per key as an array;
* ``exact_quantile`` a quantile of all rows;
* ``count_in_range`` count of rows of the same key in ``(t - w, t]`` up to the
                    current row (ties broken by id), over buckets of width w.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__part"


def ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by (keys, order), with the number of each row's
    partition as ``PART``; written to the checkpoint folder, so that edges and
    rows see the same partitions. A frame that has ``PART`` already, from an
    earlier step over the same keys and order, is used as it is."""
    if PART in df.columns:
        return df
    return df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()).checkpoint()


def _same(keys: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}.{k}")) for k in keys])


def _with_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` has one row per partition, whatever the data: broadcast."""
    return parts.join(F.broadcast(edges), PART, "left")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                keep_parts: bool = False) -> DataFrame:
    """Add running (inclusive) sums per key in ``order``. ``keep_parts`` keeps
    ``PART`` for a next step over the same keys and order."""
    keys = list(keys)
    parts = ordered_parts(df, keys, order)
    key = F.struct(*keys)
    totals = parts.groupBy(PART, *keys).agg(F.struct(*[F.sum(e).alias(n) for n, e in sums.items()]).alias("__t"))
    ends = totals.groupBy(PART).agg(F.min(key).alias("__head"), F.max(key).alias("__tail"),
                                    F.max_by("__t", key).alias("__t"))
    so_far = Window.partitionBy("__tail").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(PART)
    ends = ends.withColumn("__t", F.struct(*[F.sum(f"__t.{n}").over(so_far).alias(n) for n in sums]))
    offsets = ends.select(PART, "__head", F.when(F.col("__head").eqNullSafe(F.lag("__tail").over(before)),
                                                 F.lag("__t").over(before)).alias("__o"))
    w = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_edges(parts, offsets).select(*parts.columns, *[
        (F.sum(e).over(w) + F.when(_same(keys, "__head"), F.coalesce(f"__o.{n}", F.lit(0))).otherwise(F.lit(0))).alias(n)
        for n, e in sums.items()])
    return out if keep_parts else out.drop(PART)


def lag_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the key's previous row in ``order``."""
    keys, cols = list(keys), list(cols)
    parts = ordered_parts(df, keys, order)
    last = parts.groupBy(PART).agg(F.max_by(F.struct(F.struct(*keys).alias("key"), F.struct(*cols).alias("row")),
                                            F.struct(*keys, *order)).alias("__last"))
    carried = last.select(PART, F.lag("__last").over(Window.orderBy(PART)).alias("__carry"))
    w = Window.partitionBy(PART, *keys).orderBy(*order)
    prev = F.coalesce(F.lag(F.struct(*cols)).over(w), F.when(_same(keys, "__carry.key"), F.col("__carry.row")))
    return (_with_edges(parts, carried).withColumn("__prev", prev)
            .select(*[c for c in parts.columns if c != PART], *[F.col(f"__prev.{c}").alias(prefix + c) for c in cols]))


def rows_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, value: Column, out: str) -> DataFrame:
    """Add ``out`` = array of ``value`` over the key's last ``n`` rows up to the row
    itself, oldest first."""
    keys = list(keys)
    parts = ordered_parts(df, keys, order)
    w = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(1 - n, 0)
    framed = parts.withColumn("__own", F.collect_list(value).over(w))
    key = F.struct(*keys)
    ends = framed.groupBy(PART).agg(F.min(key).alias("__head"), F.max(key).alias("__tail"),
                                    F.max_by("__own", F.struct(*keys, *order)).alias("__own"))
    # every partition of a key has a row of it, so n of them hold its last n rows
    so_far = Window.partitionBy("__tail").orderBy(PART).rowsBetween(1 - n, 0)
    before = Window.orderBy(PART)
    ends = ends.withColumn("__own", F.flatten(F.collect_list("__own").over(so_far)))
    carried = ends.select(PART, "__head", F.when(F.col("__head").eqNullSafe(F.lag("__tail").over(before)),
                                                 F.lag("__own").over(before)).alias("__carry"))
    whole = F.concat(F.when(_same(keys, "__head"), F.coalesce("__carry", F.array())).otherwise(F.array()), F.col("__own"))
    newest = F.slice(whole, F.greatest(F.lit(1), F.size(whole) - (n - 1)), n)
    return _with_edges(framed, carried).select(
        *[c for c in parts.columns if c != PART],
        F.when(F.size("__own") == n, F.col("__own")).otherwise(newest).alias(out))


def count_in_range(df: DataFrame, keys: Sequence[str], t: str, tie: str, width: int | Column,
                   out: str, idle: int | None = None) -> DataFrame:
    """Add ``out`` = number of rows of the same key with time in
    ``(t - width, t]`` ordered at or before the current row by ``(t, tie)``.
    ``t`` is a long; ``width``, in its unit, may be a column that is the same in
    all rows of a key (not above 0: NULL). With ``idle`` a row that follows the
    key's last one by ``idle`` or more starts the count anew.

    One pass over the input and one shuffle, whatever the number of widths: a key
    is cut into buckets as wide as its width. A row is an event of its own bucket;
    to the next bucket it sends a copy, which counts there, and at t + width its
    expiry. The running numbers of rows and of expiries give the count."""
    keys = list(keys)
    width = F.lit(width) if isinstance(width, int) else width
    d = df.select(F.struct("*").alias("__row"), *keys, F.col(t).alias("__at"), F.col(tie).alias("__tie"),
                  width.cast("long").alias("__w"))
    counted = F.col("__w") > 0
    b = F.floor(F.col("__at") / F.when(counted, F.col("__w")).otherwise(3_600_000_000)).cast("long")

    def event(row: Column, bucket: Column, at: Column, kind: int) -> Column:
        # kind: an expiry (0) comes before the rows (1: copy, 2: own) of its time
        return F.struct(row.alias("row"), bucket.alias("b"), at.alias("at"), F.lit(kind).alias("kind"))

    nothing = F.lit(None).cast(d.schema["__row"].dataType)
    own = event(F.col("__row"), b, F.col("__at"), 2)
    sent = [event(nothing, b + 1, F.col("__at"), 1), event(nothing, b + 1, F.col("__at") + F.col("__w"), 0)]
    d = d.select(*keys, "__tie", "__w", F.explode(F.when(counted, F.array(own, *sent)).otherwise(F.array(own))).alias("e"))
    w = Window.partitionBy(*keys, "e.b").orderBy("e.at", F.least("e.kind", F.lit(1)), "__tie")
    is_row = F.col("e.kind") > 0
    d = d.withColumn("__upto", F.sum(is_row.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
         .withColumn("__old", F.sum((~is_row).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if idle is not None:
        last = F.last(F.when(is_row, F.col("e.at")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("__fresh", F.when(is_row & (F.col("e.at") - last >= idle), F.col("__upto") - 1)) \
             .withColumn("__old", F.greatest("__old", F.max("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return d.filter("e.kind = 2").select(
        "e.row.*", F.when(F.col("__w") > 0, F.col("__upto") - F.col("__old")).alias(out))


def exact_quantile(df: DataFrame, col: str, share: float) -> float | None:
    """The ``share`` quantile of ``col`` with linear interpolation, nulls left out.

    Equal values are counted first, so a common one is one row; running counts
    over even range partitions then tell which values have the two ranks."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n")) \
        .withColumn("__all", F.lit(0))
    parts = ordered_parts(counts, ["__all"], [col])
    total = parts.agg(F.sum("__n")).first()[0]
    if not total:
        return None
    at = share * (total - 1)
    low = int(at)
    ranked = prefix_sums(parts, ["__all"], [col], {"__upto": F.col("__n")})
    below, above = ranked.agg(*[F.min(F.when(F.col("__upto") > k, F.col(col)))
                                for k in (low, min(low + 1, total - 1))]).first()
    return below + (above - below) * (at - low)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    bucket: Column, rank_col: str = "rank") -> DataFrame:
    """Exact top ``k`` rows per key by ``order`` (descending columns allowed).

    Two phases so a hot key is not ranked in one task: each (key, bucket)
    keeps its own top ``k`` first (any global top-k row is in its bucket's
    top-k), then the survivors - at most k per bucket - are ranked per key."""
    keys = list(keys)
    w1 = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k).drop("__r1")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return local.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
