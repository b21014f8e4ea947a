"""Operator 11: periodic runs of words, by a dictionary of basic factors.

The dictionary numbers, for each power of two m, the factors of m words of a
text. Consecutive occurrences of one factor at most m / 2 apart form an
arithmetic progression (its step is the factor's own least period), so the
occurrences are kept as progressions; the distances from m up to 2 m between two
progressions that follow each other within 2 m words are the proposed periods.
Each proposal is extended to both sides through the dictionary; extensions that
meet in one stretch are deduplicated.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import Numbers, prepared

LEAST = 12  # fixed by the contract: words in the shortest run
FIELDS = ("n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0 in order of first occurrence."""
    return np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))


def basic_factors(ids: np.ndarray) -> list[np.ndarray]:
    """The dictionary: entry k holds at each place a number of the factor of
    2 ** k words that begins there, or -1 if it occurs only once in the text
    (or reaches beyond it). It ends at the first length no factor of which
    occurs twice, so a text without repeats costs no more than its words."""
    levels: list[np.ndarray] = []
    if not len(ids):
        return levels
    name = np.where(np.bincount(ids)[ids] > 1, ids, -1).astype(np.int32)
    size = 1
    while True:
        at = np.flatnonzero(name >= 0)
        if not len(at):
            return levels
        levels.append(name)
        at = at[at < len(ids) - size]
        at = at[name[at + size] >= 0]
        pair = name[at].astype(np.int64) * (int(name.max()) + 1) + name[at + size]
        name = np.full(len(ids), -1, np.int32)
        if len(at):
            _, number, count = np.unique(pair, return_inverse=True, return_counts=True)
            twice = count[number] > 1
            name[at[twice]] = number[twice]
        size *= 2


def proposals(name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q): places i at which the factor of ``size`` words occurs again q
    words on, size <= q < 2 * size. For two progressions one pair per distance
    is enough, as equal distances between them lie in one stretch."""
    at = np.flatnonzero(name >= 0)
    pos = at[np.argsort(name[at], kind="stable")]
    same = name[pos[1:]] == name[pos[:-1]]
    gap = np.diff(pos)
    head = np.flatnonzero(np.concatenate(([True], ~(same & (2 * gap <= size)))))
    count = np.diff(np.append(head, len(pos)))
    first = pos[head]
    step = np.zeros(len(head), np.int64)
    step[count > 1] = gap[head[count > 1]]
    last = first + (count - 1) * step
    starts, periods = [], []
    # gaps between progressions exceed size / 2, so the fourth is out of reach
    for hop in (1, 2, 3):
        a = np.arange(len(head) - hop)
        a = a[(name[first[a]] == name[first[a + hop]]) & (first[a + hop] - last[a] < 2 * size)]
        b = a + hop
        d = np.maximum(np.maximum(step[a], step[b]), 1)
        base = first[b] - first[a]
        low = np.maximum(1 - count[a], -((base - size) // d))
        high = np.minimum(count[b] - 1, (2 * size - 1 - base) // d)
        many = np.maximum(high - low + 1, 0)
        pair = np.repeat(np.arange(len(a)), many)
        t = low[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        starts.append(first[a][pair] - np.minimum(t, 0) * d[pair])
        periods.append(base[pair] + t * d[pair])
    start, period = np.concatenate(starts), np.concatenate(periods)
    # a match at i - 1 with the same distance extends to the same stretch
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (period[1:] != period[:-1]) | (start[1:] - start[:-1] > 1)
    return start[keep], period[keep]


def extended(levels: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the longest stretch around ``start`` in which words
    ``period`` apart are equal; the common prefixes and suffixes are read off
    the dictionary from its longest factors down."""
    n = len(levels[0])
    right, left = start + period, start.copy()
    for k in reversed(range(len(levels))):
        name, size = levels[k], 1 << k
        here = np.minimum(right, n - 1)
        right = right + size * ((right < n) & (name[here] >= 0) & (name[here] == name[here - period]))
        back = np.maximum(left - size, 0)
        left = left - size * ((left >= size) & (name[back] >= 0) & (name[back] == name[back + period]))
    return left, right


def find_runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The runs of ``ids`` as rows (start, length, period), by start, then period:
    stretches of smallest period q and length >= max(least, 2 * q) that no
    neighbour extends."""
    levels = basic_factors(np.asarray(ids, np.int64))
    found = [np.empty((0, 3), np.int64)]
    for k, name in enumerate(levels):
        start, period = proposals(name, 1 << k)
        begin, end = extended(levels, start, period)
        long = end - begin >= np.maximum(least, 2 * period)
        found.append(np.stack((begin, end - begin, period), axis=1)[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # one stretch, several periods: multiples of the smallest
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def words_of(text: str | None) -> list[bytes]:
    """The contract's words, as UTF-8: bytes are split at the six ASCII blanks."""
    return (text or "").encode().split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting of one document in ten: from a word on, the text
    repeats a stretch of itself. A document without an id is left alone."""
    n = len(words)
    if doc_id is None or pd.isna(doc_id) or not n:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(words: list[bytes], least: int = LEAST) -> tuple[np.ndarray, bytes]:
    """The runs of ``words`` and the words left when each run keeps its first period."""
    runs = find_runs(word_numbers(words), least)
    if not len(runs):
        return runs, b" ".join(words)
    return runs, b" ".join([w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k])


def summary(words: list[bytes]) -> tuple:
    """The digest columns ``FIELDS`` of one text's words."""
    runs, kept = collapse(words)
    top = [None] * 4
    if len(runs):
        start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        top = [start, length, period, 1000 * length // period]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def runs_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): the periodic runs of each text and the text with
    each run cut to its first period, words joined by one space. One row for each
    input row; null, empty and blank texts have no runs and collapse to an empty
    text; an empty table gives no rows; other columns aren't read. A text is
    searched whole in one task, in O(n log n) time and about 8 * log2(n) bytes a
    word where all of it repeats."""
    prepared(docs)

    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            runs, kept = collapse(words_of(text), least)
            rows.append(([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], kept.decode()))
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    return docs.select("doc_id", F.pandas_udf(search, RUNS)("text").alias("r")).select("doc_id", "r.*")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, FIELDS...): the contract's columns for each row of ``docs``, with
    the contract's runs planted. Rows as in ``runs_of``; a null doc_id gets none
    planted; a text without runs has four nulls and the hash of an empty list."""
    prepared(docs)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def score(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [summary(planted(int(i) if i else None, words_of(t))) for i, t in zip(ids, texts)]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:5]})

    # ids as text: a nullable number would reach pandas as a float
    return (docs.select("doc_id", F.pandas_udf(score, FIELDS)(F.col("doc_id").cast("string"), "text").alias("r"))
            .select("doc_id", "r.*"))
