"""Operator 3: near-duplicates by order MinHash, verified by banded alignment.

A sketch of a text is made of the few least hashes of its occurrence-labelled
word shingles, kept in text order; texts that share a sketch are candidates, and
an alignment within a band decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.llm.common import WORD_RE, fingerprint, packed, powers, prepared
from lookout.llm.components import components
from lookout.llm.tables import Tables

_U = np.uint64
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_BLOCK = 1 << 16  # shingles that are ranked at once
_FEW_EDITS = 16  # are found by diagonals, more of them by bit vectors
_BIT_WORDS = 1 << 14  # of longer sequences the words' bit vectors take too much memory
_KNOWN_CHARS = 1 << 21  # a task keeps the words of texts of about so many characters
_MORE_PIVOTS = 8  # times as many each round
_TRIALS = 512  # pairs to try for each text: if buckets hold fewer, all are tried at once
_FEW_TEXTS = 64  # buckets of no more are done in few rounds of pivots
_TASK_TEXTS = 1 << 9  # texts of a bucket that a task compares to the others

@dataclass(frozen=True)
class Settings:
    """``words``: words of a shingle; ``sketches`` of ``picks`` shingles each, of
    which the first ``leading`` are compared first; ``similarity``: least share of
    words that an alignment leaves unedited. ``bins``: words are counted by hash in
    so many classes, whose counts bound an alignment from below; those of ``fine``
    classes, up to 255 each, bound it closer."""
    words: int = 5
    sketches: int = 32
    picks: int = 3
    leading: int = 8
    bins: int = 32
    fine: int = 256
    similarity: float = 0.8
    seed: int = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _constants(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    raw = _mix(np.arange(1, 2 * s.sketches + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(s.seed))
    return raw[:s.sketches, None], raw[s.sketches:, None] | _U(1)


def words_of(text: str | None) -> list[str]:
    return WORD_RE.findall((text or "").lower())


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each of ``words_of``, from running sums over the bytes of
    the whole text: the sum over a word, scaled by where it begins."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    np.greater((raw - np.uint8(9)), 4, out=inside[1:-1])  # bytes 9 to 13 and 32 are blanks
    inside[1:-1] &= raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + _U(1)) * powers(_B_INV, len(raw)), out=sums[1:])
    return _mix((sums[end] - sums[start]) * powers(_B, len(raw) + 1)[start])


def sketch(text: str | None, s: Settings = Settings()) -> np.ndarray | None:
    """The ``s.sketches`` order-MinHash values of a text; None without words. A
    text of fewer than ``s.words`` words is one shingle."""
    return _sketch(word_hashes(text), s)


def _sketch(hashed: np.ndarray, s: Settings) -> np.ndarray | None:
    if not len(hashed):
        return None
    n = max(1, len(hashed) - s.words + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(min(s.words, len(hashed))):
        shingles = shingles * _U(0x9E3779B97F4A7C15) + hashed[k:k + n]
    # the k-th occurrence of a shingle is a shingle of its own
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if not new.all():
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        shingles = shingles + nth * _U(0xD6E8FEB86659FD93)
    shingles = _mix(shingles)
    least = _least(shingles, s)
    least.sort(axis=1)  # text order
    out = np.zeros(s.sketches, np.uint64)
    for k in range(least.shape[1]):
        out = _mix(out * _U(3) + shingles[least[:, k]])
    return out


def _least(shingles: np.ndarray, s: Settings) -> np.ndarray:
    """Of each sketch, the places of the ``s.picks`` shingles that it ranks lowest,
    lowest first. The ranks are made block by block, whatever the text's length."""
    xor, times = _constants(s)
    each = np.arange(s.sketches)
    best = np.empty((s.sketches, 0), np.uint64)
    places = np.empty((s.sketches, 0), np.int64)
    for lo in range(0, len(shingles), _BLOCK):
        ranks = (shingles[None, lo:lo + _BLOCK] ^ xor) * times
        for _ in range(min(s.picks, ranks.shape[1])):  # the least, the least of the others, and so on
            at = ranks.argmin(axis=1)
            best = np.column_stack([best, ranks[each, at]])
            places = np.column_stack([places, at + lo])
            ranks[each, at] = np.iinfo(np.uint64).max
        order = np.argsort(best, axis=1, kind="stable")[:, :s.picks]
        best, places = np.take_along_axis(best, order, 1), np.take_along_axis(places, order, 1)
    return places


def aligned_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences by furthest reaching points on the diagonals
    of a band of width ``most`` to both sides, and beyond a few edits by bit vectors;
    None if it is above ``most``."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    # words that the other side lacks can't be matched
    if max(n, m) - sum((Counter(a) & Counter(b)).values()) > most:
        return None
    by_bits = min(n, m) <= _BIT_WORDS
    goal = m - n
    reach = {}  # diagonal (position in b - position in a) -> furthest position in a
    for edits in range((min(most, _FEW_EDITS) if by_bits else most) + 1):
        room = most - edits  # edits that are left bound how far the goal may be
        new = {}
        for d in range(max(-edits, goal - room), min(edits, goal + room) + 1):
            if edits == 0:
                x = 0
            else:
                x = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
                if x < 0:
                    continue
            x = min(x, n, m - d)
            if x < 0 or x + d < 0:
                continue
            while x < n and x + d < m and a[x] == b[x + d]:
                x += 1
            new[d] = x
        if new.get(goal, -1) >= n:
            return edits
        reach = new
    return _bit_distance(a, b, most) if by_bits and most > _FEW_EDITS else None


def _bit_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance by the columns' differences as bit vectors (Myers, Hyyro); None
    once it must end above ``most``."""
    a, b = sorted((a, b), key=len)
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict = {}  # word -> its places in a
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    up, down, distance = whole, 0, len(a)
    for left, word in zip(range(len(b) - 1, -1, -1), b):
        same = at.get(word, 0)
        flat = (((same & up) + up) ^ up) | same
        more, less = down | whole & ~(flat | up), up & flat
        distance += (more & last > 0) - (less & last > 0)
        if distance - left > most:
            return None
        steep = same | down
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | whole & ~(steep | more), more & steep
    return distance if distance <= most else None


def similar(a: str, b: str, s: Settings = Settings()) -> bool:
    x, y = words_of(a), words_of(b)
    return _alike(x, Counter(x), y, Counter(y), s)


def _alike(x: list[str], x_counts: Counter, y: list[str], y_counts: Counter, s: Settings) -> bool:
    longer = max(len(x), len(y))
    most = int((1 - s.similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > most or longer - (x_counts & y_counts).total() > most:
        return False  # words that the other side lacks can't be matched
    return aligned_distance(x, y, most) is not None


def _sketch_udf(s: Settings):
    """text -> its sketch (null without words), its words, and these by class and by
    fine class."""
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashed = word_hashes(text)
            v = _sketch(hashed, s)
            bag = np.bincount((hashed % _U(s.bins)).astype(np.int64), minlength=s.bins).astype(np.int32)
            fine = np.bincount((hashed % _U(s.fine)).astype(np.int64), minlength=s.fine).clip(max=255)
            rows.append((None if v is None else v.view(np.int64), len(hashed), bag, fine.astype(np.int16)))
        return pd.DataFrame(rows, columns=["sketch", "n", "bag", "fine"])
    return F.pandas_udf(sketched, "sketch array<bigint>, n int, bag array<int>, fine array<smallint>")


def _fine_udf(s: Settings):
    """Whether two texts may be similar by their words (n) of each fine class."""
    def counts(fine: pd.Series) -> np.ndarray:
        return np.concatenate([*fine, np.empty(0, np.int16)]).reshape(len(fine), s.fine)

    def may(n_a: pd.Series, fine_a: pd.Series, n_b: pd.Series, fine_b: pd.Series) -> pd.Series:
        more = counts(fine_a) - counts(fine_b)
        edits = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        return pd.Series(edits <= np.floor((1 - s.similarity) * np.maximum(n_a, n_b).to_numpy() + 1e-9))
    return F.pandas_udf(may, "boolean")


def _similar_udf(s: Settings):
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str, tuple[list[str], Counter]] = {}  # a text stands in many pairs
        chars = 0
        same = []
        for pair in zip(a, b):
            if chars > _KNOWN_CHARS:
                known.clear()
                chars = 0
            for text in pair:
                if text not in known:
                    words = words_of(text)
                    known[text] = words, Counter(words)
                    chars += len(text)
            same.append(_alike(*known[pair[0]], *known[pair[1]], s))
        return pd.Series(same, dtype=bool)
    return F.pandas_udf(verified, "boolean")


def _node(text):
    """A text's 128-bit digest: equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _stars(buckets: DataFrame) -> DataFrame:
    """(bucket, node) -> distinct (a, b): each node with the least of its bucket."""
    least = (buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    return (buckets.join(least, "bucket").filter("node != a")
            .select("a", F.col("node").alias("b")).distinct())


def _may_be_similar(s: Settings, counts: str = "bag"):
    """Of a member (n, ``counts``) and a pivot (p_n, p_``counts``): false only if the words
    that either has more of, class by class, are edits enough to tell them apart."""
    if counts == "bag":  # tried most often: one compiled sum
        more = reduce(add, [F.greatest(F.get("bag", F.lit(i)) - F.get("p_bag", F.lit(i)), F.lit(0)) for i in range(s.bins)])
    else:
        more = F.aggregate(F.zip_with(counts, f"p_{counts}", lambda m, p: F.greatest(m - p, F.lit(0))), F.lit(0), add)
    most = F.floor((1 - s.similarity) * F.greatest("n", "p_n") + 1e-9)
    return (F.abs(F.col("n") - F.col("p_n")) <= most) & (more + F.greatest(F.col("p_n") - F.col("n"), F.lit(0)) <= most)


def _length_class(s: Settings):
    """Similar texts are of the same class of lengths or of neighbouring ones."""
    step = -math.log(min(1.0, max(s.similarity, 1e-9))) + 1e-6
    return F.floor(F.log(F.greatest("n", F.lit(1))) / step)


def _standing(left: DataFrame, good: DataFrame, roots: DataFrame, words: DataFrame, tables: Tables) -> DataFrame:
    """Of ``left`` (bucket, node), the buckets in which different components meet, as
    one row for each text: its ``buckets``, ``root``, the number of its links, and its
    columns of ``words``."""
    linked = good.select(F.col("a").alias("node")).unionAll(good.select(F.col("b").alias("node")))
    linked = roots.join(linked.groupBy("node").agg(F.count(F.lit(1)).alias("linked")), "node", "left")
    labelled = tables.put("labelled", left.join(linked, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")))
    mixed = (labelled.select("bucket", F.xxhash64("root").alias("r")).groupBy("bucket")
             .agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo != hi").select("bucket"))
    # joined by text, not by text and bucket
    standing = (labelled.join(mixed, "bucket", "left_semi").groupBy("node")
                .agg(F.first("root").alias("root"), F.first("linked").alias("linked"),
                     F.collect_list("bucket").alias("buckets")))
    return tables.put("members", standing.join(words, "node"))


def _verified(edges: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return (edges.join(left, "a").join(right, "b")
            .select("a", "b", _similar_udf(s)("text_a", "text_b").alias("same")).filter("same").select("a", "b"))


def _near(pairs: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs`` (a, b) whose words by fine class don't tell them apart: these
    need their texts."""
    left = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a"))
    right = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(_fine_udf(s)("n_a", "fine_a", "n_b", "fine_b")).select("a", "b"))


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One shuffle of the texts by digest, whatever their number, serves the join and
    the removal of copies."""
    return (docs.select(_node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
            .join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))


def _merged(roots: DataFrame, found: DataFrame, tables: Tables) -> DataFrame:
    """``roots`` after the links ``found``: only components that these touch meet."""
    of = roots.select("node", F.col("root").alias("r"))
    ends = tables.put("ends", found.join(of.withColumnsRenamed({"node": "a", "r": "ra"}), "a", "left")
                      .join(of.withColumnsRenamed({"node": "b", "r": "rb"}), "b", "left")
                      .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    joined = components(ends, tables)
    # what ``joined`` shares with ``roots`` are roots, each its own there
    every = roots.unionByName(joined.select("node", F.col("node").alias("root"))).distinct()
    return tables.put("roots", every.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
                      .select("node", F.coalesce("new", "root").alias("root")))


@contextmanager
def _splits(spark: SparkSession, on: bool) -> Iterator[None]:
    """Without ``on``, joins whose rows are dealt in bounded parts are not split again by
    their bytes: that makes many small tasks."""
    name = "spark.sql.adaptive.skewJoin.enabled"
    old = spark.conf.get(name)
    if not on:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _pivot_pairs(each: DataFrame, pivots: DataFrame, s: Settings) -> DataFrame:
    """(a, b): the pairs of a pivot and a text of its bucket that lengths and word
    counts don't tell apart."""
    others = pivots.select("bucket", *[F.col(c).alias(f"p_{c}") for c in ("node", "root", "n", "bag")],
                           F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"))
    return (each.alias("m").join(others.alias("p"), (
                F.col("m.bucket") == F.col("p.bucket")) & (F.col("m.class") == F.col("p.class"))
                & (F.col("root") != F.col("p_root")) & _may_be_similar(s))
            .select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct())


def _all_pairs(each: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """(a, b): all pairs of a bucket that lengths and word counts, also by fine class, don't
    tell apart, once each: in the least bucket that both stand in. The texts of a (bucket,
    class) are dealt into parts of about ``_TASK_TEXTS``, and each part meets the others."""
    parts = sizes.select("bucket", "class", F.ceil(F.col("texts") / _TASK_TEXTS).alias("parts"))
    one = (each.join(parts, ["bucket", "class"])
           .select("bucket", "class", F.pmod(F.xxhash64("node"), "parts").alias("part"),
                   "node", "root", "n", "bag", "fine", "buckets"))
    other = (each.select("bucket", *[F.col(c).alias(f"p_{c}") for c in ("node", "root", "n", "bag", "fine", "buckets", "class")],
                         F.explode(F.array("class", F.col("class") - 1)).alias("class"))
             .join(parts, ["bucket", "class"])
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts"))
    m, p = one.alias("m"), other.alias("p")
    here = [F.col(f"m.{c}") == F.col(f"p.{c}") for c in ("bucket", "class", "part")]
    return (m.join(p, here[0] & here[1] & here[2]
                   & ((F.col("p_class") > F.col("m.class")) | (F.col("node") < F.col("p_node")))
                   & (F.col("root") != F.col("p_root")) & _may_be_similar(s)
                   & (F.array_min(F.array_intersect("buckets", "p_buckets")) == F.col("m.bucket"))
                   & _may_be_similar(s, "fine"))
            .select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")))


def links(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): pairs of different texts (by digest) that alignment found similar.

    Texts that share a sketch meet in a bucket. By the leading sketches every text
    is compared to the least one of its bucket. Then, as long as a bucket holds
    different components, some of its texts are pivots: all others of other
    components are compared to them, but for those whose lengths or word counts rule
    it out, and the pivots leave the bucket. Texts with the most links come first, so an
    original to which many unlike copies belong is a pivot soon; the number of
    pivots, drawn by hash, grows eightfold each round. Few new links wait for more before
    components merge by them. If large buckets are left once a round finds few, or the buckets then
    hold few pairs for the number of texts, all pairs that are left are tried at once. In the end each pair
    that shares a bucket has been verified, is in one component, or can't be similar."""
    return _linked(docs, s, Tables(docs.sparkSession))[0]


def _linked(docs: DataFrame, s: Settings, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``links`` and (node, root) of the components that they make."""
    sketched = tables.put("sketched", docs.select(_node(F.col("text")).alias("node"), "text")
                          .select("node", _sketch_udf(s)("text").alias("s")).filter("s.sketch IS NOT NULL")
                          .groupBy("node").agg(F.first("s").alias("s")).select("node", "s.*"))
    each = sketched.select("node", F.posexplode("sketch").alias("band", "value"))
    each = each.select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    # a text that is alone in its bucket meets no other
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = tables.put("buckets", each.join(shared, "bucket", "left_semi"))

    # the texts are fetched once: whatever is verified later stands in a shared bucket
    texts = tables.put("texts", _texts_of(docs, buckets.select("node").distinct()))

    tried = tables.put("tried", _stars(buckets.filter(F.col("band") < s.leading)))
    good = tables.put("good", _verified(tried, texts, s))
    roots = tables.put("roots", components(good, tables))

    words = sketched.select("node", "n", "bag", "fine", _length_class(s).alias("class"))
    members = _standing(buckets.select("bucket", "node"), good, roots, words, tables)
    n_texts = sketched.count()
    tables.drop("sketched", "buckets")
    pivots_each, rounds, waiting, few = 1, 0, None, False
    while not members.isEmpty():
        each = members.withColumn("bucket", F.explode("buckets"))
        sizes = tables.put("sizes", each.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("texts")))
        most, pairs = sizes.agg(F.max("texts"), F.sum(F.col("texts") * F.col("texts"))).first()
        # not before a round of pivots: its links keep pairs of large groups from being tried
        last = rounds > 0 and most > _FEW_TEXTS and (few or pairs <= _TRIALS * n_texts)
        if last:
            fresh = _all_pairs(each, sizes, s)
        else:
            salt = F.pmod(F.xxhash64("node", F.lit(pivots_each)), F.lit(pivots_each))
            pivots = tables.put("pivots", each.groupBy("bucket", salt.alias("salt"))
                                .agg(F.min(F.struct((-F.col("linked")).alias("l"), "node", "root", "n", "bag", "class"))
                                     .alias("p"))
                                .select("bucket", "p.node", "p.root", "p.n", "p.bag", "p.class"))
            fresh = _pivot_pairs(each, pivots, s)
        with _splits(docs.sparkSession, not last):
            fresh = tables.put(f"tried{rounds}", fresh.join(tried, ["a", "b"], "left_anti"))
        found = tables.put(f"good{rounds}", _verified(fresh if last else _near(fresh, members, s), texts, s))
        good = good.unionByName(found)
        waiting = waiting.unionByName(found) if waiting else found
        if last:
            break
        tried = tried.unionByName(fresh)
        few = 20 * waiting.count() <= members.count()
        if not few:
            roots, waiting = _merged(roots, waiting, tables), None
        left = each.join(pivots, ["bucket", "node"], "left_anti").select("bucket", "node")
        members = _standing(left, good, roots, members.select(*words.columns), tables)
        pivots_each *= _MORE_PIVOTS
        rounds += 1
    if waiting and not waiting.isEmpty():
        roots = _merged(roots, waiting, tables)
    return good, roots


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, class_size, kept, k1, k2): one row for each input row.

    A class is a connected set of equal or similar texts; ``class_id`` is its
    least doc_id and ``class_size`` its rows. ``kept`` holds for one row of each
    class: the least by (doc_id, nulls first, then k1, k2); of rows equal in
    every column each says the same. k1, k2 is the fingerprint of all columns.

    Texts with the same 5-word shingles to 0.8 and more meet in a bucket with a
    probability above 1 - 1e-9, to 0.5 above 0.98; only those that an alignment leaves at
    least ``similarity`` alike are linked. Null texts count as empty; texts
    without words are one class; an empty table gives no rows."""
    prepared(docs)
    rows = docs.select("doc_id", _node(F.col("text")).alias("node"),
                       *fingerprint(*[F.col(f"`{c}`") for c in docs.columns]))
    tables = Tables(docs.sparkSession)
    _, roots = _linked(docs, s, tables)
    classed = tables.put("classed", rows.join(roots, "node", "left")
                         .select("doc_id", "k1", "k2", F.coalesce("root", "node").alias("root")))
    tables.keep_only("classed")
    per_class = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
                                            F.min(F.struct("doc_id", "k1", "k2")).alias("first"))
    return (classed.join(per_class, "root")
            .select("doc_id", "class_id", "class_size",
                    F.struct("doc_id", "k1", "k2").eqNullSafe(F.col("first")).alias("kept"), "k1", "k2"))


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The op3 query's columns."""
    return near_duplicates(docs, s).drop("k1", "k2")


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, with its columns."""
    kept = near_duplicates(docs, s).filter("kept").select("k1", "k2").distinct()
    rows = packed(docs, *fingerprint(*[F.col(f"`{c}`") for c in docs.columns]))
    return rows.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
