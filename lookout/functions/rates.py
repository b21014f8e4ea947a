"""Exact rate limits for keys of any size, in three passes over time buckets.

A row is allowed when fewer than ``budget`` *allowed* rows of its key lie in
``(t - window, t]``. Number the rows of a bucket in time order and let f(i) be
the first row at or after t_i + window. The allowed rows a_1 < a_2 < ... follow

    a_k = max(a_(k-1) + 1, f(a_(k-budget)))

and the state a bucket is entered with only fixes the first ``budget`` of them:
a_j = max(a_(j-1) + 1, p_j), p_j being the first row at or after the time the
j-th of the last allowed rows leaves the window. f is monotone, so every a_k is
the greatest of ``budget`` functions of one p_j each, and these functions can be
tabulated without knowing the entry:

1. per (key, bucket), in parallel: if so few rows precede some row that all of
   them must have been allowed, the state there is known and with it the exit,
   whatever the entry. Otherwise the functions are tabulated over the rows of
   the bucket's first window (an entry can't reach further) for the last
   2 * ``budget`` allowed rows: entries differ by at most ``budget`` of them;
2. per key, over these summaries in bucket order: the entry picks one row of the
   table per allowed time and so gives the exit, the next bucket's entry;
3. per (key, bucket), in parallel again: the fold from the true entry.

A target that is asked for without a gap is thus spread over tasks as well. The
summaries hold one row per row of a bucket's first window, 1 / ``factor`` of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .periods import _groups, _n_parts

NEVER = np.iinfo(np.int64).max


def allowed_rows(times: np.ndarray, before: list[int], budget: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Which of the sorted ``times`` are allowed after the allowed times ``before``,
    and the last ``budget`` allowed times then. The loop runs once per allowed row."""
    allowed = np.zeros(len(times), dtype=bool)
    hist = list(before)
    i = 0
    while i < len(times):
        if len(hist) >= budget:
            # refused until the budget-th newest allowed row leaves the window
            j = int(np.searchsorted(times, hist[-budget] + window, side="left"))
            if j > i:
                i = j
                continue
        allowed[i] = True
        hist = [*hist, int(times[i])][-budget:]
        i += 1
    return allowed, hist


def known_exit(times: np.ndarray, start: int, budget: int, window: int) -> list[int] | None:
    """The last allowed times of a bucket that begins at ``start``, if they don't
    depend on what came before it; else None."""
    before = np.arange(len(times)) - np.searchsorted(times, times - 2 * window, side="right")
    cuts = np.flatnonzero((before < budget) & (times >= start + 2 * window))
    if not len(cuts):
        return None
    at = int(cuts[-1])
    last = times[np.searchsorted(times, times[at] - window, side="right"):at]
    return allowed_rows(times[at:], last.tolist(), budget, window)[1]


def exit_table(times: np.ndarray, start: int, budget: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, table): for each place p that an entry's allowed time may leave
    the window at, its row's time (``NEVER`` behind the last row) and, flattened,
    the times of the last 2 * ``budget`` allowed rows by the functions of
    p_1 ... p_budget (``NEVER``: not in this bucket)."""
    n = len(times)
    first = int(np.searchsorted(times, start + window, side="left"))
    jump = np.append(np.searchsorted(times, times + window, side="left"), n)
    places = np.arange(first + 1)
    # -1: no bound yet (the place before the first row)
    seq: list[np.ndarray] = []
    for k in range(budget):
        seq.append(np.stack([np.minimum(places + k - j, n) if j <= k else np.full(first + 1, -1)
                             for j in range(budget)]))
    while seq[-1][:, 0].max() < n:  # the entry that allows most still goes on
        back, prev = seq[-budget], seq[-1]
        step = np.where(back >= 0, jump[back], -1)
        seq.append(np.maximum(step, np.where(prev >= 0, np.minimum(prev + 1, n), -1)))
        del seq[:-2 * budget - 1]
    last = seq[-2 * budget - 1:-1] if len(seq) > 2 * budget else seq[:-1]
    stamped = np.concatenate((times, [NEVER, np.iinfo(np.int64).min]))  # row n: never, -1: no bound
    table = np.full((2 * budget, budget, first + 1), NEVER)
    for k, rows in enumerate(last):
        table[k] = stamped[rows]
    entries = np.append(times, NEVER)[:first + 1]
    return entries, table.transpose(2, 0, 1).reshape(first + 1, -1)


def rate_limit(df: DataFrame, keys: list[str], t: str, tie: str, budget: int, window: int,
               factor: int = 256) -> DataFrame:
    """Returns ``(keys, tie, allowed)``; ``t`` is a long, ``window`` in its unit. A
    bucket is ``factor`` windows long; its times are held in a task's memory
    (8 bytes a row)."""
    keys = list(keys)
    width = int(window) * int(factor)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*keys, t, tie).withColumn("__b", F.floor(F.col(t) / width).cast("long"))
    gk = keys + ["__b"]
    key_fields = [T.StructField(k, types[k]) for k in keys] + [T.StructField("__b", T.LongType())]
    longs = T.ArrayType(T.LongType())
    n = _n_parts(df)

    summary = T.StructType(key_fields + [T.StructField("__at", T.LongType()), T.StructField("__table", longs)])

    def summed(group: tuple, chunks: list[np.ndarray]) -> pd.DataFrame:
        times = np.concatenate(chunks)
        start = int(group[-1]) * width
        known = known_exit(times, start, budget, window)
        if known is not None:  # one row that any entry meets: no place, the exit itself
            at, table = [None], [known]
        else:
            entries, values = exit_table(times, start, budget, window)
            at, table = entries.tolist(), values.tolist()
        out = pd.DataFrame({"__at": pd.array(at, "Int64"), "__table": table})
        for k, v in reversed(list(zip(gk, group))):
            out.insert(0, k, v)
        return out

    def pass1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, chunks = None, []
        for pdf in batches:
            if pdf.empty:
                continue
            cols = [pdf[c].to_numpy() for c in gk]
            times = pdf[t].to_numpy(np.int64)
            for s, e in _groups(pdf, gk):
                g = tuple(c[s] for c in cols)
                if group is not None and g != group:
                    yield summed(group, chunks)
                    chunks = []
                group = g
                chunks.append(times[s:e])
        if chunks:
            yield summed(group, chunks)

    dealt = rows.repartition(n, *gk).sortWithinPartitions(*gk, t, tie)
    summaries = dealt.mapInPandas(pass1, summary)

    entry = T.StructType(key_fields + [T.StructField("__entry", longs)])

    def pass2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a bucket's table may span batches: ``open_`` are the entry's times still
        # without their place in it
        key, bucket, hist, open_, rows_of = None, None, [], [], []
        out = []

        def closed() -> list[int]:
            if not rows_of:
                return hist
            if len(rows_of) == 1 and not isinstance(rows_of[0], tuple):
                return list(rows_of[0])
            # slot j's place picks its own column of the table
            values = [max(row[k * budget + j] for j, row in rows_of) for k in range(2 * budget)]
            return (hist + sorted(v for v in values if v != NEVER))[-budget:]

        for pdf in batches:
            if pdf.empty:
                continue
            cols = [pdf[c].to_numpy() for c in keys]
            buckets = pdf["__b"].to_numpy(np.int64)
            at_all = pdf["__at"].tolist()
            tables = pdf["__table"].tolist()
            for s, e in _groups(pdf, gk):
                k = tuple(c[s] for c in cols)
                if (k, int(buckets[s])) != (key, bucket):
                    hist = closed()
                    if k != key:
                        hist = []
                    key, bucket, rows_of = k, int(buckets[s]), []
                    out.append((*k, bucket, hist))
                    leaves = [None] * (budget - len(hist)) + [x + window for x in hist]
                    open_ = list(enumerate(leaves))
                if pd.isna(at_all[s]):
                    rows_of, open_ = [tables[s]], []
                    continue
                for i in range(s, e):
                    while open_ and (open_[0][1] is None or open_[0][1] <= at_all[i]):
                        rows_of.append((open_.pop(0)[0], tables[i]))
                    if not open_:
                        break
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in entry.fields])

    entries = summaries.repartition(n, *keys).sortWithinPartitions(*keys, "__b", "__at") \
        .mapInPandas(pass2, entry)

    result = T.StructType(key_fields[:-1] + [T.StructField(tie, types[tie]), T.StructField("allowed", T.BooleanType())])

    def pass3(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist: list[int] = []
        for pdf in batches:
            if pdf.empty:
                continue
            times = pdf[t].to_numpy(np.int64)
            given = pdf["__entry"].to_numpy()
            heads = [i for i, x in enumerate(given) if x is not None]
            allowed = np.zeros(len(pdf), dtype=bool)
            first = heads[0] if heads else len(pdf)  # rows of the bucket that the last batch began
            allowed[:first], hist = allowed_rows(times[:first], hist, budget, window)
            for s, e in zip(heads, [*heads[1:], len(pdf)]):
                allowed[s + 1:e], hist = allowed_rows(times[s + 1:e], given[s].tolist(), budget, window)
            yield pdf[keys + [tie]].assign(allowed=allowed).drop(index=heads)

    # a bucket's entry travels as the row before its first, so rows are shuffled once
    heads = entries.select(*keys, F.lit(np.iinfo(np.int64).min).alias(t), F.lit("0").cast(types[tie]).alias(tie),
                           "__b", "__entry")
    return (rows.withColumn("__entry", F.lit(None).cast(longs)).unionByName(heads)
            .repartition(n, *gk).sortWithinPartitions(*gk, t, tie)
            .mapInPandas(pass3, result).checkpoint(eager=True))
