"""Operator 2: line dedup on content-defined chunks.

A rolling hash over the hashes of a few lines decides where a chunk of lines
ends, so an inserted line moves boundaries only near itself. Chunks of several
lines that occur again anywhere in the corpus are removed, after their bytes
have been compared.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import fingerprint, prepared

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """A chunk ends after a line if the rolling hash of it and the ``window`` - 1
    lines before leaves remainder 0 by ``divisor`` (the mean number of lines in
    a chunk). Chunks of at least ``min_lines`` lines with a non-blank character
    count as duplicates."""
    window: int = 2
    divisor: int = 4
    min_lines: int = 2


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def chunk_ends(lines: list[str], s: Settings = Settings()) -> list[int]:
    """The line numbers after which chunks end; the last is ``len(lines)``."""
    n = len(lines)
    hashed = np.fromiter(map(_line_hash, lines), np.uint64, n)
    rolling = np.zeros(n, np.uint64)
    for back in range(s.window):  # the window shrinks at the start of a text
        rolling[back:] += hashed[:n - back] * _BASE ** np.uint64(back)
    rolling = (rolling ^ (rolling >> np.uint64(29))) * _MIX
    ends = np.flatnonzero((rolling >> np.uint64(32)) % np.uint64(s.divisor) == 0) + 1
    return [*ends[ends < n].tolist(), n]


def chunks(text: str | None, s: Settings = Settings()) -> list[tuple[int, int, str]]:
    """(first line, lines, chunk) of a text cut at its line breaks. Chunks joined
    by line breaks give the text."""
    lines = (text or "").split("\n")
    out, at = [], 0
    for end in chunk_ends(lines, s):
        out.append((at, end - at, "\n".join(lines[at:end])))
        at = end
    return out


def _candidate_udf(s: Settings):
    """text -> the chunks that may count as duplicates, without their texts."""
    def hashed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            row = []
            for at, n, chunk in chunks(text, s):
                if n >= s.min_lines and chunk.strip():
                    d = hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    row.append((at, int.from_bytes(d[:8], "little", signed=True),
                                int.from_bytes(d[8:], "little", signed=True)))
            out.append(row)
        return pd.Series(out, dtype=object)
    return F.pandas_udf(hashed, "array<struct<line: int, h1: bigint, h2: bigint>>")


def _cut_udf(s: Settings):
    """(text, first lines) -> the chunks that begin there, with their texts."""
    def cut(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for text, lines in zip(texts, wanted):
            these = set(lines)
            out.append([(at, chunk) for at, _, chunk in chunks(text, s) if at in these])
        return pd.Series(out, dtype=object)
    return F.pandas_udf(cut, "array<struct<line: int, chunk: string>>")


def _removal_udf(s: Settings):
    """(text, first lines of chunks to remove) -> what is left and counts."""
    def remove(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, removed):
            these = set() if gone is None else set(gone)
            cut = chunks(text, s) if these else []
            kept = "\n".join(c for at, _, c in cut if at not in these) if these else (text or "")
            rows.append((len((text or "").split("\n")), len(these), sum(n for at, n, _ in cut if at in these), kept))
        return pd.DataFrame(rows, columns=["n_lines", "n_removed_chunks", "n_removed_lines", "kept_text"])
    return F.pandas_udf(remove, "n_lines long, n_removed_chunks long, n_removed_lines long, kept_text string")


def removed_chunks(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, k1, k2, lines): for the rows that lose chunks, the first lines of
    these. k1, k2 is the fingerprint of (doc_id, text).

    The first copy of a chunk stays: the one with the least (doc_id, fingerprint,
    line), null ids first. Rows equal in id and text count as one document: they
    lose the same chunks, and none for being twice there. Only hashes of chunks are shuffled until a chunk is
    known to repeat; then the texts of its copies are compared, not the hashes."""
    rows = docs.select("doc_id", "text", *fingerprint(F.col("doc_id"), F.col("text")))
    found = (rows.select("doc_id", "k1", "k2", F.explode(_candidate_udf(s)("text")).alias("c"))
             .select("doc_id", "k1", "k2", "c.*")).checkpoint()
    often = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    wanted = (found.join(often, ["h1", "h2"]).groupBy("doc_id", "k1", "k2")
              .agg(F.collect_set("line").alias("lines")))  # at most one entry a line of one text
    both = wanted.withColumnsRenamed({"doc_id": "w_id", "k1": "w1", "k2": "w2"})
    copies = (rows.join(both, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
                        & F.col("doc_id").eqNullSafe(F.col("w_id")))
              .select("doc_id", "k1", "k2", F.explode(_cut_udf(s)("text", "lines")).alias("c"))
              .select("doc_id", "k1", "k2", "c.*")).checkpoint()
    # grouping and joining on the chunk itself compares bytes
    first = (copies.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "k1", "k2", "line")).alias("first"))
             .filter("n > 1").drop("n"))
    me = F.struct("doc_id", "k1", "k2", "line")
    return (copies.join(first, "chunk").filter(~me.eqNullSafe(F.col("first")))
            .groupBy("doc_id", "k1", "k2").agg(F.collect_set("line").alias("lines")))


def line_dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_lines, n_removed_chunks, n_removed_lines, kept_text): one row
    for each input row. Chunks that stay are joined by line breaks.

    Null texts count as empty; texts without repeated chunks stay as they are;
    an empty table gives no rows. Other columns aren't read."""
    prepared(docs)
    rows = docs.select("doc_id", "text", *fingerprint(F.col("doc_id"), F.col("text")))
    gone = removed_chunks(docs, s).withColumnsRenamed({"doc_id": "g_id", "k1": "g1", "k2": "g2"})
    return (rows.join(gone, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
                      & F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
            .select("doc_id", _removal_udf(s)("text", "lines").alias("r")).select("doc_id", "r.*"))


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``line_dedup`` with a hash of the kept text in its place."""
    return (line_dedup(docs, s)
            .select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines",
                    F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")))
