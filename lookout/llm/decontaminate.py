"""Operator 10: benchmark decontamination.

All word trigrams of a test item are its seeds, however common. A passage with
several seeds of an item nearby, and words enough of it to reach the least score,
is aligned to it by Smith-Waterman, so edited and paraphrased copies are scored too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import prepared

TOKEN = re.compile(r"\w+")
MATCHES = "array<struct<item_id: bigint, score: double, first_word: int, last_word: int, n_seeds: int>>"


@dataclass(frozen=True)
class Settings:
    """``gram``: words of a seed. ``min_seeds`` different seeds must lie in a
    passage, fewer if the item has fewer than three times as many trigrams.
    ``accept``: least alignment score as a share of the score of an unchanged
    copy. ``block_words``: the benchmark is worked through in blocks of about this
    many words, each sent to all tasks."""
    gram: int = 3
    min_seeds: int = 2
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    accept: float = 0.5
    block_words: int = 500_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Items:
    """One block of test items as numbers: their words, their trigrams, and
    where each trigram stands in which item."""

    def __init__(self, rows: list[tuple[int, str]], gram: int):
        self.gram = gram
        self.ids, self.words, self.vocab = [], [], {}
        for item_id, text in rows:
            words = [self.vocab.setdefault(w, len(self.vocab)) for w in tokens(text)]
            if len(words) >= gram:
                self.ids.append(item_id)
                self.words.append(np.array(words, np.int32))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        places = [(code, k, at) for k, words in enumerate(self.words) for at, code in enumerate(self.codes(words))]
        places.sort()
        self.item = np.array([p[1] for p in places], np.int64)
        self.offset = np.array([p[2] for p in places], np.int64)
        self.grams, self.first = np.unique(np.array([p[0] for p in places], np.uint64), return_index=True)
        self.count = np.diff(np.append(self.first, len(places)))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """A number for every ``gram`` words running; exact, as long as the
        vocabulary to the power of ``gram`` fits 64 bits (a block's does)."""
        words = words.astype(np.uint64)
        out = words[:len(words) - self.gram + 1].copy()
        for k in range(1, self.gram):
            out = out * np.uint64(len(self.vocab)) + words[k:len(words) - self.gram + 1 + k]
        return out

    def shared(self, k: int, passage: np.ndarray) -> int:
        """The words of item ``k``, as often as they are, that ``passage`` has too."""
        words, times = self.bags[k]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        have = np.bincount(at[words[at] == passage], minlength=len(words))
        return int(np.minimum(times, have).sum())

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int32, len(words))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, trigram numbers) of the block's trigrams in ``words``."""
        n = len(words) - self.gram + 1
        if n < 1 or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = words >= 0
        here = known[:n].copy()
        for k in range(1, self.gram):
            here &= known[k:n + k]
        at = np.flatnonzero(here)
        if not len(at):
            return at, at
        code = words[at].astype(np.uint64)
        for k in range(1, self.gram):
            code = code * np.uint64(len(self.vocab)) + words[at + k].astype(np.uint64)
        found = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        same = self.grams[found] == code
        return at[same], found[same]


def align(item: np.ndarray, passage: np.ndarray, s: Settings) -> tuple[int, int]:
    """Smith-Waterman with linear gaps: (best score, position of its last word).
    Row by row; the chain of gaps within a row is a running maximum."""
    slope = np.arange(len(passage) + 1, dtype=np.int32) * s.gap
    row = np.zeros(len(passage) + 1, np.int32)
    best, end = 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, s.match, s.mismatch), row[1:] + s.gap)
        row = np.maximum.accumulate(np.maximum(new, 0) - slope) + slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


def search(items: Items, words: np.ndarray, s: Settings) -> list[tuple]:
    """The items of which ``words`` holds a copy: (item_id, score, first word,
    last word, seeds), the best passage for each item."""
    at, gram = items.hits(words)
    if not len(at):
        return []
    # every place of a seed in the items, and where the item would then begin
    times = items.count[gram]
    place = np.repeat(items.first[gram], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, start = items.item[place], np.repeat(at, times) - items.offset[place]
    gram = np.repeat(gram, times)
    order = np.lexsort((start, item))
    item, start, gram = item[order], start[order], gram[order]
    lengths = items.lengths
    breaks = np.flatnonzero((np.diff(item) != 0) | (np.diff(start) > np.maximum(2, lengths[item[1:]] // 2))) + 1
    out: dict[int, tuple] = {}
    lows, highs = np.append(0, breaks), np.append(breaks, len(item))
    least = np.minimum(s.min_seeds, np.maximum(1, (lengths[item[lows]] - items.gram + 1) // 3))
    some = highs - lows >= least
    for lo, hi in zip(lows[some], highs[some]):
        k = int(item[lo])
        target = items.words[k]
        n_seeds = len(np.unique(gram[lo:hi]))
        if n_seeds < min(s.min_seeds, max(1, (len(target) - items.gram + 1) // 3)):
            continue
        slack = len(target) // 2 + 2
        first = max(0, int(start[lo]) - slack)
        passage = words[first:int(start[hi - 1]) + len(target) + slack]
        # every matched word adds ``match`` at most, and no word of the passage serves twice
        if s.match * items.shared(k, passage) < s.accept * s.match * len(target):
            continue
        score, end = align(target, passage, s)
        share = score / (s.match * len(target))
        if share >= s.accept and (k not in out or share > out[k][1]):
            _, back = align(target[::-1], passage[end::-1], s)
            out[k] = (items.ids[k], share, first + end - back, first + end, n_seeds)
    return [out[k] for k in sorted(out)]


def _blocks(benchmark: DataFrame, s: Settings) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of a bounded number of words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+"))).alias("n")).first().n or 0
    blocks = max(1, -(-int(words) // s.block_words))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield sorted((r.item_id if r.item_id is not None else -1, r.text) for r in block.collect())


def _search_udf(block, s: Settings):
    def found(texts: pd.Series) -> pd.Series:
        items = block.value
        return pd.Series([search(items, items.number(tokens(t)), s) for t in texts], dtype=object)

    return F.pandas_udf(found, MATCHES)


def _searches(docs: DataFrame, benchmark: DataFrame, s: Settings):
    """For each block of the benchmark, a Pandas UDF text -> ``MATCHES``."""
    sc = docs.sparkSession.sparkContext
    for rows in _blocks(benchmark, s):
        items = Items(rows, s.gram)
        if items.ids:
            yield _search_udf(sc.broadcast(items), s)


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_seeds): one row for each
    document (input row) and test item of which it holds a copy scoring at least
    ``accept``; first and last word count ``\\w+`` runs of the text from 0.

    Null or empty texts and items shorter than a seed match nothing; repeated
    rows are reported row by row, items with equal texts each; an empty table on
    either side gives no rows."""
    prepared(docs)
    out = docs.sparkSession.createDataFrame(
        [], docs.select("doc_id").schema.simpleString()[7:-1]
        + ", item_id long, score double, first_word int, last_word int, n_seeds int")
    for udf in _searches(docs, benchmark, settings):
        out = out.unionByName(docs.select("doc_id", F.explode(udf("text")).alias("m")).select("doc_id", "m.*"))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, as they are."""
    prepared(docs)
    out = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    for udf in _searches(docs, benchmark, settings):
        out = out.filter(F.size(udf("text")) == 0)
    return out.select("row.*")
