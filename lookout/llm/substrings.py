"""Operator 4: exact substring dedup with suffix arrays built shard by shard.

A byte string of the given length is a window. Windows that are equal have the
same least hash of the shorter grams inside them, so neighbouring windows that
share their least gram (a segment) go to the shard of its hash, and all copies of a
window meet in one shard. There a suffix array and the common prefixes of
neighbouring suffixes tell which windows occur twice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import fingerprint, powers, prepared
from lookout.llm.suffixes import common_prefixes, suffix_array

_U = np.uint64
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)


@dataclass(frozen=True)
class Settings:
    """``window``: bytes of a string that must not occur twice. ``grams``: bytes
    of the grams whose least hash names a segment; a hash under which more than
    ``crowd`` different segments stand is refined by the next longer gram, the
    last being the window itself (of a passage that many documents share, only
    the windows over its ends go on, fewer each time). ``shard_bytes``: text in
    one suffix array."""
    window: int = 400
    grams: tuple[int, ...] = (48, 160, 260, 330, 370, 390, 400)
    crowd: int = 1000
    shard_bytes: int = 1_000_000


def _least(values: np.ndarray, wide: int) -> np.ndarray:
    """Least of every ``wide`` values running: the values of a block up to a place
    and those of the block before from a place on are running minima."""
    m = len(values)
    blocks = np.full(-(-m // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    blocks[:m] = values
    blocks = blocks.reshape(-1, wide)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(back[:m - wide + 1], forth[wide - 1:m])


def window_hashes(data: bytes, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``data``, the least hash of the grams inside it, and
    the hash of its first gram."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw + _U(1)) * powers(_B_INV, n), out=sums[1:])
    hashed = (sums[gram:] - sums[:n + 1 - gram]) * powers(_B, n + 1 - gram)
    hashed = (hashed ^ (hashed >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> _U(32)
    least = _least(hashed, window - gram + 1) if gram < window else hashed
    return least, hashed[:len(least)]


def segments(data: bytes, gram: int, s: Settings, ranges=None) -> tuple[np.ndarray, ...]:
    """(key, hash, start, windows, times) of the segments of a text, or of the
    ranges (first window, windows) of it: the windows whose leftmost least gram is
    the same one. Segments that follow each other and are equal, as in a text that
    repeats itself, are one row."""
    parts = []
    for first, count in ranges if ranges is not None else [(0, len(data) - s.window + 1)]:
        if count < 1:
            continue
        least, own = window_hashes(data[first:first + count + s.window - 1], gram, s.window)
        # a window that begins with its least gram is the last one to hold it
        start = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (own[:-1] == least[:-1])))
        parts.append((least[start], start + first, np.diff(np.append(start, len(least)))))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
    key, start, count = (np.concatenate(p) for p in zip(*parts))
    extra = s.window - 1
    hashed = np.frombuffer(b"".join(hashlib.blake2b(data[a:a + c + extra], digest_size=8).digest()
                                    for a, c in zip(start.tolist(), count.tolist())), np.int64)
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (hashed[1:] != hashed[:-1])
                                   | (count[1:] != count[:-1]) | (start[1:] != start[:-1] + count[:-1])))
    times = np.diff(np.append(new, len(key)))
    return (key[new].view(np.int64), hashed[new], start[new].astype(np.int32), count[new].astype(np.int32),
            times.astype(np.int32))


_SEGMENTS = "key array<bigint>, hash array<bigint>, start array<int>, windows array<int>, times array<int>"


def _segment_udf(gram: int, s: Settings):
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segments(t.encode("utf-8", "surrogatepass"), gram, s) for t in texts],
                            columns=["key", "hash", "start", "windows", "times"], dtype=object)
    return F.pandas_udf(cut, _SEGMENTS)


def _range_udf(gram: int, s: Settings):
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segments(t.encode("utf-8", "surrogatepass"), gram, s,
                                      [(r["start"], r["windows"]) for r in rs]) for t, rs in zip(texts, ranges)],
                            columns=["key", "hash", "start", "windows", "times"], dtype=object)
    return F.pandas_udf(cut, _SEGMENTS)


def repeated_windows(segs: list[bytes], window: int) -> list[np.ndarray]:
    """For each of the different segments, which of its windows occur twice or
    more in all of them."""
    lengths = np.array([len(x) + 1 for x in segs])
    text = np.frombuffer(b"".join(x + b"\0" for x in segs), np.uint8).astype(np.uint16) + 2
    starts = np.cumsum(lengths) - lengths
    text[starts + lengths - 1] = 1  # between segments; no window reaches over it
    text = np.append(text, 0).astype(np.uint16)
    # the symbols that occur, in order, without gaps
    used = np.zeros(258, bool)
    used[text] = True
    text = (np.cumsum(used) - 1)[text].astype(np.uint16)
    before, shared = common_prefixes(text, suffix_array(text, int(used.sum())), window)
    long = shared >= window
    twice = long.copy()
    twice[before[long]] = True
    return [twice[a:a + n - window] for a, n in zip(starts, lengths)]


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def _shard_fn(window: int):
    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(b) for b in pdf["bytes"]], window)
        rows = [(level, k, h, a, b) for level, k, h, marks in zip(pdf["level"], pdf["key"], pdf["hash"], found)
                for a, b in _runs(marks)]
        return pd.DataFrame(rows, columns=["level", "key", "hash", "lo", "hi"])
    return shard


def _cut_udf(window: int):
    """(text, wanted segments) -> the segments with their bytes."""
    def cut(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(texts, wanted):
            data = t.encode("utf-8", "surrogatepass")
            out.append([(r["level"], r["key"], r["hash"], data[r["start"]:r["start"] + r["windows"] + window - 1])
                        for r in rows])
        return pd.Series(out, dtype=object)
    return F.pandas_udf(cut, "array<struct<level: int, key: bigint, hash: bigint, bytes: binary>>")


def _remove_udf(window: int):
    """(text, runs of repeated windows) -> what is left, and counts."""
    def remove(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found in zip(texts, runs):
            if t is None or found is None:
                rows.append((0, 0, b""))
                continue
            data = t.encode("utf-8", "surrogatepass")
            kept, at, n_spans, last = [], 0, 0, -1
            for a, b in sorted((r["lo"], r["hi"] + window - 1) for r in found):
                if a > last:  # runs that touch are one
                    n_spans += 1
                    kept.append(data[at:a])
                at = last = max(last, b)
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((len(data) - len(rest), n_spans, rest))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])
    return F.pandas_udf(remove, "n_removed long, n_spans long, kept binary")


def _with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` (k1, k2, ...) with the text of each; rows equal in id and text count once."""
    return docs.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"])


def _repeated_keys(found: DataFrame) -> DataFrame:
    """The segments whose key occurs twice or more; the others hold no copies."""
    often = found.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key")
    return found.join(often, "key")


def _each(frame: DataFrame, of: Column) -> DataFrame:
    return (frame.select("k1", "k2", of.alias("s"))
            .select("k1", "k2", F.explode(F.arrays_zip("s.key", "s.hash", "s.start", "s.windows", "s.times")).alias("e"))
            .select("k1", "k2", "e.*"))


def copies(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, key, hash, start, windows, times, level): the segments that may hold
    copied windows, from the shortest grams under which no crowd of different
    segments stands; and the rows of ``docs`` (k1, k2, text) that have some."""
    text = docs.filter(F.octet_length("text") >= s.window)
    found = _repeated_keys(_each(text, _segment_udf(s.grams[0], s)("text")).checkpoint()).checkpoint()
    texts = _with_text(docs, found.select("k1", "k2").distinct()).checkpoint()
    ready, crowded = None, texts
    for level, gram in enumerate(s.grams):
        if level + 1 < len(s.grams):
            crowds = (found.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
                      .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > s.crowd).select("key")).checkpoint()
            few = found.join(crowds, "key", "left_anti")
        else:
            crowds, few = None, found
        few = few.withColumn("level", F.lit(level))
        ready = few if ready is None else ready.unionByName(few)
        if crowds is None or crowds.isEmpty():
            break
        # copies stand in the ranges of the crowded segments only
        ranges = (found.join(crowds, "key", "left_semi").groupBy("k1", "k2")
                  .agg(F.sort_array(F.collect_list(F.struct("start", (F.col("windows") * F.col("times")).alias("windows"))))
                       .alias("ranges")))
        crowded = _with_text(crowded.select("k1", "k2", "text"), ranges).checkpoint()
        found = _repeated_keys(_each(crowded, _range_udf(s.grams[level + 1], s)("text", "ranges")).checkpoint()).checkpoint()
    return ready, texts


def repeated_runs(docs: DataFrame, s: Settings) -> DataFrame:
    """(k1, k2, lo, hi): runs [lo, hi) of windows that start elsewhere too.
    ``docs``: (k1, k2, text).

    Segments that are equal as a whole are counted, and one of each goes on: in
    those that occur several times every window starts elsewhere. The others may
    share windows with a different segment of their key; the suffix arrays of the shards tell. Shards hold whole keys, of which each has a
    bounded number of segments, and about ``shard_bytes``."""
    ready, texts = copies(docs, s)
    ready = ready.checkpoint()
    same = ["level", "key", "hash"]
    first = ready.groupBy(same).agg(F.sum("times").alias("times"),
                                    F.min(F.struct("k1", "k2", "start", "windows")).alias("at")).checkpoint()
    keys = first.groupBy("level", "key").agg(F.count(F.lit(1)).alias("different"))
    sorted_here = first.join(keys, ["level", "key"]).filter("different > 1").checkpoint()
    size = sorted_here.agg(F.sum(F.col("at.windows") + s.window).alias("n")).first().n or 0
    shards = max(1, -(-int(size) // s.shard_bytes))
    wanted = (sorted_here.select("at.k1", "at.k2", F.struct(
        *same, F.col("at.start").alias("start"), F.col("at.windows").alias("windows")).alias("w"))
        .groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")))
    pieces = (_with_text(texts, wanted).select(F.explode(_cut_udf(s.window)("text", "wanted")).alias("p")).select("p.*")
              .withColumn("shard", F.pmod(F.xxhash64("level", "key"), F.lit(shards))))
    runs = pieces.groupBy("shard").applyInPandas(
        _shard_fn(s.window), "level int, key long, hash long, lo int, hi int").checkpoint()
    # in a row of several equal segments all windows repeat; it has no runs of its own
    whole = first.filter("times > 1").select(*same)
    all_of_it = ready.join(whole, same).select("k1", "k2", F.col("start").alias("lo"), (
        F.col("start") + F.col("windows") * F.col("times")).alias("hi"))
    some_of_it = (ready.join(runs.join(whole, same, "left_anti"), same)
                  .select("k1", "k2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))
    return all_of_it.unionByName(some_of_it)


def dedup_substrings(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for each input row.

    A byte goes if a string of ``window`` bytes that covers it also starts
    anywhere else in the texts (as UTF-8 bytes), the same one included; strings
    don't cross documents. ``n_spans``: the runs of bytes that go; ``kept``: the
    others, joined.

    Null texts count as empty. Repeated rows are copies of each other, so their
    windows go. An empty table gives no rows. Other columns aren't read."""
    prepared(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *fingerprint(F.col("doc_id"), F.col("text")))
    runs = (repeated_runs(rows.drop("doc_id"), s).groupBy("k1", "k2")
            .agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))).checkpoint()
    size = F.octet_length("text").cast("long").alias("n_bytes")
    # texts without runs stay whole and don't go through Python
    cut = _remove_udf(s.window)(F.when(F.col("runs").isNotNull(), F.col("text")), "runs")
    return (rows.join(runs, ["k1", "k2"], "left")
            .select("doc_id", "text", "runs", cut.alias("r"))
            .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "r.n_removed", "r.n_spans",
                    F.when(F.col("runs").isNull(), F.encode("text", "UTF-8")).otherwise(F.col("r.kept")).alias("kept")))


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``dedup_substrings`` with a hash of the kept bytes in their place."""
    return dedup_substrings(docs, s).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
