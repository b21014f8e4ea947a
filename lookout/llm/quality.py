"""Operator 5: quality rules on repetition coverage.

For each text, rolling hashes over its words find the n-grams of several
lengths that occur again in the same text; the verdict depends on the share of
characters inside them and inside repeated lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import WORD_RE, prepared

SYMBOLS = "#*$%&|<>"     # fixed by the contract
BLANKS = " \t\n\v\f\r"   # fixed by the contract
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, dup_gram_share array<double>")


@dataclass(frozen=True)
class Limits:
    """Largest accepted share of word characters inside n-grams that occurred
    before in the text, by n, and inside lines that did; largest accepted number
    of symbols a word."""
    grams: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.19), (7, 0.18), (8, 0.17), (9, 0.16), (10, 0.15))
    lines: float = 0.20
    symbols: float = 0.2


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that rolling sums of word numbers don't cancel."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _again(values: np.ndarray, first: bool) -> np.ndarray:
    """Marks the values that occurred before; with ``first``, also the first of them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(values), bool)
    twice[1:] |= same
    if first:
        twice[:-1] |= same
    out = np.empty(len(values), bool)
    out[order] = twice
    return out


def _covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside the n-word windows that begin at the marked ``starts``."""
    step = np.zeros(n_words + 1, np.int32)
    step[:len(starts)] += starts
    step[n:n + len(starts)] -= starts
    return np.cumsum(step[:n_words]) > 0


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """The fields of ``FIELDS`` for one text (null: as an empty one).

    A share counts the characters of repeats only, not of what they repeat.
    Windows that repeat are the ones equal in 64-bit rolling hashes of the
    words' numbers in the text; for the three-word windows of the base columns
    the numbers themselves are compared."""
    text = text or ""
    words = WORD_RE.findall(text)
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup_lines = dup_line_chars = 0
    seen = set()
    for line in text.split("\n"):
        if line in seen:
            if chars := len(line) - sum(map(line.count, BLANKS)):
                n_dup_lines += 1
                dup_line_chars += chars
        else:
            seen.add(line)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n_words)
    n_repeat = 0
    shares = [0.0] * len(limits.grams)
    if n_words > 3:
        pairs = ids[:-1] * np.int64(len(numbers)) + ids[1:]
        if len(numbers) >= 2_000_000:  # three numbers no longer fit 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        starts = _again(pairs[:-1] * np.int64(len(numbers)) + ids[2:], first=True)
        if starts.any():
            n_repeat = int(_covered(starts, 3, n_words).sum())
            chars = np.fromiter(map(len, words), np.int64, n_words)
            hashed = _mix(ids.astype(np.uint64) + _BASE)
            rolling, have = hashed, 1
            for k, (n, _) in enumerate(limits.grams):
                if n > n_words:
                    break
                while have < n:
                    rolling, have = rolling[:-1] * _BASE + hashed[have:], have + 1
                starts = _again(rolling, first=False)
                if not starts.any():
                    break  # no longer window repeats either
                shares[k] = float(chars[_covered(starts, n, n_words)].sum() / word_chars)
    line_share = dup_line_chars / word_chars if word_chars else 0.0
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    kept = (not base_failed and line_share <= limits.lines and n_symbols <= limits.symbols * n_words
            and all(share <= most for share, (_, most) in zip(shares, limits.grams)))
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, line_share, shares)


def quality(limits: Limits = Limits()):
    """Pandas UDF: text -> struct of ``FIELDS``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, limits) for t in texts], columns=names)

    return F.pandas_udf(score, FIELDS)


def measured(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, FIELDS...): one row for each input row. Null and empty texts
    have no words, so they fail the base rule; repeated rows get equal results;
    an empty table gives no rows. Other columns aren't read."""
    prepared(docs)
    return docs.select("doc_id", quality(limits)("text").alias("q")).select("doc_id", "q.*")


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    prepared(docs)
    return (docs.select(F.struct("*").alias("row"), quality(limits)("text").alias("q"))
            .filter("q.kept").select("row.*"))
