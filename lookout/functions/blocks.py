"""Exact block/unblock state for keys of any size, in three parallel-friendly passes.

Per key in time order: a block while blocked is ``already_blocked``,
otherwise ``blocked`` until its own end time; an unblock ends a block
(``unblocked``) or does nothing (``not_blocked``). The structure is that of
``functions.periods`` with a per-row duration, plus one simplification: an
unblock leaves the state empty whatever came before, so after a bucket's
first unblock every possible entry has converged.

1. per (key, bucket): an entry state (a block end ``u < start + D``, D the
   longest duration) only decides which block row before the first unblock
   opens the bucket's first block. All such candidates are run at once (a
   heap of live chains by end time; chains opening the same row merge; an
   unblock merges everything), giving each candidate's exit state;
2. per key, over the summaries in bucket order: the true entry picks its
   candidate, whose exit is the next bucket's entry;
3. per (key, bucket): the fold from the true entry gives every row's outcome.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .periods import _groups, _n_parts

INF = np.iinfo(np.int64).max


def block_fold(tv: np.ndarray, is_block: np.ndarray, untils: np.ndarray, cur):
    """Sequential block state over sorted rows, jumping between state changes:
    returns (outcome array, blocked_until array, final state)."""
    n = len(tv)
    idx = np.arange(n)
    nb = np.minimum.accumulate(np.where(is_block, idx, n)[::-1])[::-1] if n else idx
    nu = np.minimum.accumulate(np.where(~is_block, idx, n)[::-1])[::-1] if n else idx
    outcome = np.empty(n, dtype=object)
    bu = np.empty(n, dtype=object)
    i = 0
    while i < n:
        if cur is None or tv[i] >= cur:
            cur = None
            j = int(nb[i])                      # unblocks until the next block are no-ops
            outcome[i:j] = "not_blocked"
            bu[i:j] = None
            if j >= n:
                break
            cur = int(untils[j])
            outcome[j], bu[j] = "blocked", cur
            i = j + 1
        else:
            end = int(np.searchsorted(tv, cur, side="left"))   # first row past the block
            u = int(nu[i])
            stop = min(end, u, n)
            outcome[i:stop] = "already_blocked"
            bu[i:stop] = cur
            if stop == u and u < end:
                outcome[u], bu[u] = "unblocked", None
                cur, i = None, u + 1
            elif stop >= n:
                break                                  # still blocked past this slice
            else:
                cur, i = None, stop                    # the block expired at row ``stop``
    return outcome, bu, cur


def block_state(df: DataFrame, keys: list[str], t: str, tie: str, action: str, until: str,
                max_duration: int, factor: int = 64) -> DataFrame:
    """Returns ``(keys, tie, outcome, blocked_until)``; rows whose ``action`` is
    ``block_ip`` block until ``until``, any other row unblocks."""
    keys = list(keys)
    D = max(1, int(max_duration))
    width = D * int(factor)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*keys, t, tie, (F.col(action) == "block_ip").alias("__blk"), until) \
        .withColumn("__b", F.floor(F.col(t) / width).cast("long"))
    gk = keys + ["__b"]
    n = _n_parts(df)

    # ---- pass 1: candidate chains -> (cand_t, exit); exit NULL = entry passes through
    summ_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField("__b", T.LongType()), T.StructField("__cand", T.LongType()),
        T.StructField("__exit", T.LongType()), T.StructField("__pass", T.BooleanType())])

    def pass1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None
        out = []

        def flush(g, st):
            parent = st["parent"]

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x
            if st["reset"] is not None:       # an unblock happened: all entries converge
                single = st["single"]
                for cid, ct in st["cands"]:
                    out.append((*g, ct, single, False))
                out.append((*g, INF, single, False))
            else:
                for cid, ct in st["cands"]:
                    out.append((*g, ct, st["cur"][find(cid)], False))
                out.append((*g, INF, None, True))   # nothing opened: the entry passes through

        for pdf in batches:
            if pdf.empty:
                continue
            gcols = [pdf[c].to_numpy() for c in gk]
            tv_all = pdf[t].to_numpy(np.int64)
            blk_all = pdf["__blk"].to_numpy()
            u_all = pdf[until].to_numpy(np.int64)
            for s, e in _groups(pdf, gk):
                g = tuple(a[s] for a in gcols)
                if cur is None or cur[0] != g:
                    if cur is not None:
                        flush(*cur)
                    cur = (g, {"heap": [], "parent": [], "cur": [], "cands": [],
                               "entry_end": g[-1] * width + D, "sentinel": False,
                               "reset": None, "single": None})
                st = cur[1]
                for i in range(s, e):
                    if st["reset"] is not None:       # one converged chain: plain fold
                        _, _, st["single"] = block_fold(tv_all[i:e], blk_all[i:e].astype(bool),
                                                        u_all[i:e], st["single"])
                        break
                    x, blk, u = int(tv_all[i]), bool(blk_all[i]), int(u_all[i])
                    if not blk:                       # first unblock: every entry converges
                        st["reset"] = x
                        st["single"] = None
                        continue
                    heap, parent, curs = st["heap"], st["parent"], st["cur"]
                    opening = []
                    while heap and heap[0][0] <= x:
                        opening.append(heapq.heappop(heap)[1])
                    if not st["sentinel"]:
                        if x >= st["entry_end"]:
                            st["sentinel"] = True
                        cid = len(parent)
                        parent.append(cid)
                        curs.append(u)
                        st["cands"].append((cid, x))
                        opening.append(cid)
                    if opening:
                        root = opening[0]
                        for other in opening[1:]:
                            parent[other] = root
                        curs[root] = u
                        heapq.heappush(heap, (u, root))
        if cur is not None:
            flush(*cur)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in summ_schema.fields])

    summ = rows.repartition(n, *gk).sortWithinPartitions(*gk, t, tie).mapInPandas(pass1, summ_schema)

    # ---- pass 2: true entry per bucket
    entry_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField("__b", T.LongType()), T.StructField("__entry", T.LongType())])

    def pass2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the entry is emitted at a bucket's first chunk; the candidate search
        # continues across batches (the pass-through sentinel is always last)
        prev_key, state, cur_b, pending, thr = None, None, None, False, None
        out = []
        for pdf in batches:
            if pdf.empty:
                continue
            kcols = [pdf[c].to_numpy() for c in keys]
            b_all = pdf["__b"].to_numpy(np.int64)
            cand_all = pdf["__cand"].to_numpy(np.int64)
            exit_all = pdf["__exit"].to_numpy()
            pass_all = pdf["__pass"].to_numpy()
            for s, e in _groups(pdf, gk):
                kk = tuple(a[s] for a in kcols)
                b = int(b_all[s])
                if (kk, b) != cur_b:
                    if kk != prev_key:
                        prev_key, state = kk, None
                    cur_b = (kk, b)
                    out.append((*kk, b, state))
                    start = b * width
                    thr = state if (state is not None and state > start) else -INF
                    pending = True
                if not pending:
                    continue
                j = int(np.searchsorted(cand_all[s:e], thr, side="left"))
                if j < e - s:
                    pending = False
                    if not pass_all[s + j]:
                        ex = exit_all[s + j]
                        state = None if pd.isna(ex) else int(ex)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in entry_schema.fields])

    entries = summ.repartition(n, *keys).sortWithinPartitions(*keys, "__b", "__cand") \
        .mapInPandas(pass2, entry_schema)

    # ---- pass 3: outcomes per (key, bucket) from the true entry
    out_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField(tie, types[tie]), T.StructField("outcome", T.StringType()),
        T.StructField("blocked_until", T.LongType())])

    def pass3(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            if pdf.empty:
                continue
            times = pdf[t].to_numpy(np.int64)
            block = pdf["__blk"].to_numpy().astype(bool)
            ends = pdf[until].to_numpy(np.int64)
            outcome = np.empty(len(pdf), dtype=object)
            blocked = np.empty(len(pdf), dtype=object)
            heads = np.flatnonzero(times == -INF)  # a bucket's entry, as the row before its first
            for s, e in zip([-1, *heads], [*heads, len(pdf)]):
                if s >= 0:
                    state = None if ends[s] == -INF else int(ends[s])
                s += 1
                outcome[s:e], blocked[s:e], state = block_fold(times[s:e], block[s:e], ends[s:e], state)
            res = pdf[keys + [tie]].assign(outcome=outcome, blocked_until=pd.array(list(blocked), dtype="Int64"))
            yield res.drop(index=heads)

    # the entries travel with the rows, so these are shuffled once
    heads = entries.select(*keys, F.lit(-INF).alias(t), F.lit("0").cast(types[tie]).alias(tie),
                           F.lit(False).alias("__blk"), F.coalesce("__entry", F.lit(-INF)).alias(until), "__b")
    return rows.unionByName(heads).repartition(n, *gk).sortWithinPartitions(*gk, t, tie) \
        .mapInPandas(pass3, out_schema).checkpoint(eager=True)
