"""Exact greedy periods for keys of any size, by a tree of time buckets.

A row opens a period when ``t >= start + period`` (the first row opens the
first). The answer depends on earlier answers, so a plain window function
cannot express it, and a key with continuous traffic has no gap at which
to split it. Instead each key is cut into time buckets of
``levels[0]`` periods, these into groups of ``levels[1]`` buckets, and so on:

1. per (key, bucket), in parallel: every possible entry state of the bucket
   reduces to *which row opens the bucket's first period*. That is a row of
   the bucket's first ``period`` (or the first row after it). All these
   candidate chains are run at once over the bucket in time order (a heap of
   live chains; chains that open at the same row merge). Each candidate's
   exit (the last start in the bucket) is recorded: about 1 / ``levels[0]`` of
   the rows;
2. up the tree, per (key, group) in parallel: the candidates of a group are the
   rows that open its first period; their exits are followed from bucket to
   bucket through the buckets' candidates. At the top, per key in order: the
   entry picks a candidate and so the exit, the next entry. Down the tree, in
   parallel again: a group's entry gives that of each bucket in it;
3. per (key, bucket), in parallel: the fold is re-run from the true entry.

A task sees one bucket's rows, or one group's candidates (the rows of a period
for each bucket in it); what remains for one task per key shrinks by each level.
All passes are sorted streaming ``mapInPandas`` scans.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _groups(pdf: pd.DataFrame, cols: list[str]):
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in cols:
        a = pdf[c].to_numpy()
        change[1:] |= a[1:] != a[:-1]
    starts = np.flatnonzero(change).tolist()
    return list(zip(starts, starts[1:] + [n]))


def _n_parts(df: DataFrame) -> int:
    from ..session import task_parallelism
    return task_parallelism(df.sparkSession)


NONE = np.iinfo(np.int64).min  # no entry: the next row opens a period


def _sections(batches: Iterator[pd.DataFrame], by: list[str], values: list[str]):
    """(key, arrays) for each run of rows that are equal in ``by``, put together
    where it spans batches."""
    key, held = None, []
    for pdf in batches:
        if pdf.empty:
            continue
        cols = [pdf[c].to_numpy() for c in by]
        arrays = [pdf[c].to_numpy(np.int64) for c in values]
        for s, e in _groups(pdf, by):
            k = tuple(c[s] for c in cols)
            if held and k != key:
                yield key, [np.concatenate(x) for x in zip(*held)]
                held = []
            key = k
            held.append([x[s:e] for x in arrays])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held)]


def period_starts(df: DataFrame, keys: list[str], t: str, tie: str, period: int,
                  levels: tuple[int, ...] = (64, 64)) -> DataFrame:
    """Returns ``(keys, tie, period_start, opens)``; ``t`` is a long, ``period`` > 0."""
    keys = list(keys)
    width = int(period) * int(levels[0])
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*keys, t, tie).withColumn("__b", F.floor(F.col(t) / width).cast("long"))
    gk = keys + ["__b"]

    # ---- pass 1: candidate chains per (key, bucket) -> (cand_t, exit_t)
    summ_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField("__b", T.LongType()), T.StructField("__cand", T.LongType()),
        T.StructField("__exit", T.LongType())])

    def pass1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None  # (group key tuple, state)
        out = []

        def flush(g, st):
            parent, exit_of, cands = st["parent"], st["L"], st["cands"]

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x
            for cid, ct in cands:
                out.append((*g, ct, exit_of[find(cid)]))

        for pdf in batches:
            if pdf.empty:
                continue
            gcols = [pdf[c].to_numpy() for c in gk]
            tv_all = pdf[t].to_numpy(np.int64)
            for s, e in _groups(pdf, gk):
                g = tuple(a[s] for a in gcols)
                if cur is None or cur[0] != g:
                    if cur is not None:
                        flush(*cur)
                    bstart = g[-1] * width
                    cur = (g, {"heap": [], "parent": [], "L": [], "cands": [],
                               "entry_end": bstart + period, "sentinel": False})
                st = cur[1]
                heap, parent, L = st["heap"], st["parent"], st["L"]
                tv = tv_all[s:e]
                n_seg, i = e - s, 0
                # rows up to the first one past the entry zone may start chains: per row
                while i < n_seg and not st["sentinel"]:
                    x = int(tv[i])
                    firing = []
                    while heap and heap[0][0] + period <= x:
                        firing.append(heapq.heappop(heap)[1])
                    if x >= st["entry_end"]:
                        st["sentinel"] = True
                    cid = len(parent)
                    parent.append(cid)
                    L.append(x)
                    st["cands"].append((cid, x))
                    firing.append(cid)
                    root = firing[0]
                    for other in firing[1:]:
                        parent[other] = root
                    L[root] = x
                    heapq.heappush(heap, (x, root))
                    i += 1
                # afterwards only chains fire: jump to the row where the earliest one fires
                while heap and i < n_seg:
                    j = max(i, int(np.searchsorted(tv, heap[0][0] + period, side="left")))
                    if j >= n_seg:
                        break
                    x = int(tv[j])
                    firing = []
                    while heap and heap[0][0] + period <= x:
                        firing.append(heapq.heappop(heap)[1])
                    root = firing[0]
                    for other in firing[1:]:
                        parent[other] = root
                    L[root] = x
                    heapq.heappush(heap, (x, root))
                    i = j + 1
        if cur is not None:
            flush(*cur)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in summ_schema.fields])

    n = _n_parts(df)
    summ = rows.repartition(n, *gk).sortWithinPartitions(*gk, t, tie) \
        .mapInPandas(pass1, summ_schema)

    # ---- pass 2: up and down the tree of buckets, over summaries only
    entry_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField("__b", T.LongType()), T.StructField("__entry", T.LongType())])
    places = keys + ["__g", "__b"]

    def grouped(summary: DataFrame, grow: int) -> DataFrame:
        return summary.withColumn("__g", F.floor(F.col("__b") / grow).cast("long"))

    def climb(group_width: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            group, cands, exits, open_ = None, [], np.empty(0, np.int64), False

            def summed() -> pd.DataFrame:
                out = pd.DataFrame({"__cand": np.concatenate(cands), "__exit": exits})
                for name, value in reversed(list(zip([*keys, "__b"], group))):
                    out.insert(0, name, value)
                return out

            for (*place, _), (cand, exit_) in _sections(batches, places, ["__cand", "__exit"]):
                if place != group:
                    if group is not None:
                        yield summed()
                    group, cands, exits, open_ = place, [], np.empty(0, np.int64), True
                at = np.searchsorted(cand, exits + period)
                exits = np.where(at < len(cand), exit_[np.minimum(at, len(cand) - 1)], exits)
                if open_:  # an entry may still reach this bucket: up to a period, then the first row
                    k = int(np.searchsorted(cand, group[-1] * group_width + period))
                    cands.append(cand[:k + 1])
                    exits = np.concatenate((exits, exit_[:k + 1]))
                    open_ = k == len(cand)
            if group is not None:
                yield summed()
        return run

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a group's entry, if there is one, is the row before its first bucket
        group, last, out = None, NONE, []
        for (*place, b), (cand, exit_) in _sections(batches, places, ["__cand", "__exit"]):
            if place != group:
                group, last = place, NONE
            if b == NONE:
                last = int(exit_[0])
                continue
            out.append((*place[:-1], b, last))
            at = 0 if last == NONE else int(np.searchsorted(cand, last + period))
            if at < len(cand):
                last = int(exit_[at])
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in entry_schema.fields])

    def sorted_by(frame: DataFrame, *by: str) -> DataFrame:
        return frame.repartition(n, *by).sortWithinPartitions(*places, "__cand")

    tree, group_width = [summ], width
    for grow in levels[1:]:
        tree[-1] = tree[-1].checkpoint()  # read on the way up and on the way down
        group_width *= int(grow)
        tree.append(sorted_by(grouped(tree[-1], grow), *keys, "__g").mapInPandas(climb(group_width), summ_schema))
    entries = sorted_by(tree.pop().withColumn("__g", F.lit(0).cast("long")), *keys).mapInPandas(descend, entry_schema)
    for grow in reversed(levels[1:]):
        heads = entries.select(*keys, F.lit(NONE).alias("__b"), F.lit(NONE).alias("__cand"),
                               F.col("__entry").alias("__exit"), F.col("__b").alias("__g"))
        entries = sorted_by(grouped(tree.pop(), grow).unionByName(heads), *keys, "__g").mapInPandas(descend, entry_schema)

    # ---- pass 3: the fold per (key, bucket) from its true entry
    out_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField(tie, types[tie]), T.StructField("period_start", T.LongType()),
        T.StructField("opens", T.BooleanType())])

    def pass3(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = NONE
        for pdf in batches:
            if pdf.empty:
                continue
            times = pdf[t].to_numpy(np.int64)
            entry = pdf["__entry"].to_numpy()
            starts = np.empty(len(pdf), dtype=np.int64)
            opens = np.zeros(len(pdf), dtype=bool)
            heads = np.flatnonzero(times == NONE)  # a bucket's entry, as the row before its first
            for s, e in zip([-1, *heads], [*heads, len(pdf)]):
                if s >= 0:
                    state = int(entry[s])
                i = s + 1
                while i < e:
                    opens[i] = state == NONE or times[i] >= state + period
                    state = int(times[i]) if opens[i] else state
                    j = max(i + 1, i + int(np.searchsorted(times[i:e], state + period, side="left")))
                    starts[i:j] = state
                    i = j
            res = pdf[keys + [tie]].assign(period_start=starts, opens=opens)
            yield res.drop(index=heads)

    # the entries travel with the rows, so these are shuffled once
    heads = entries.select(*keys, F.lit(NONE).alias(t), F.lit("0").cast(types[tie]).alias(tie), "__b", "__entry")
    return (rows.withColumn("__entry", F.lit(NONE)).unionByName(heads)
            .repartition(n, *gk).sortWithinPartitions(*gk, t, tie)
            .mapInPandas(pass3, out_schema).checkpoint(eager=True))
