"""Operator 13: byte-level BPE encoding and decoding with the ranks of a public tokenizer.

A text is cut into pieces by the tokenizer's pattern; a piece that is a token
itself is that token, any other piece begins as its bytes. The different pieces
of a batch are put into matrices, one for each length, a piece to a row. Each
round every row merges its leftmost pair of the least rank; pairs are looked up
in a hash table held in numpy arrays, finished rows leave the matrix and the
rest is a column narrower.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import Numbers, prepared

NONE = np.int32(2**31 - 1)   # rank of a pair that isn't a token
_ODD = np.uint64(0x9E3779B97F4A7C15)
MATRIX_BYTES = 96            # longer pieces are merged one by one
BLOCK_CHARS = 2_000_000      # texts encoded together; a longer one goes alone
REMEMBERED = 400_000         # different pieces a task remembers from batch to batch
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """(left id, right id) -> rank, by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray):
        keys = self._key(left, right)
        bits = max(4, int(4 * len(keys)).bit_length())
        self._mask = np.int64((1 << bits) - 1)
        self._shift = np.uint64(64 - bits)
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self._ranks = np.full(1 << bits, NONE)
        self._probes = 0
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            # of those that want one free slot the first gets it, the rest move on
            free = todo[self._keys[slot[todo]] == np.uint64(2**64 - 1)]
            wanted, winner = np.unique(slot[free], return_index=True)
            self._keys[wanted] = keys[free[winner]]
            self._ranks[wanted] = ranks[free[winner]]
            todo = np.setdiff1d(todo, free[winner], assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self._mask
            self._probes += 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``NONE`` for those that are no token or hold a -1."""
        keys = self._key(left, right).ravel()
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._ranks[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        for _ in range(1, self._probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self._mask
            held = self._keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self._ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        out[(left.ravel() < 0) | (right.ravel() < 0)] = NONE
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks of a byte-level BPE: lines of base64 token and rank."""

    def __init__(self, data: bytes, pattern: str):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.pieces = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in self.rank.items()}
        self._byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        split = [(self.rank[t[:k]], self.rank[t[k:]], r) for t, r in self.rank.items()
                 for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self._pairs = PairTable(*np.array(split, np.int64).reshape(-1, 3).astype(np.int32).T)
        self._forget()

    def _forget(self) -> None:
        """Empties what is remembered of earlier batches."""
        self._index = Numbers()
        self._ids, self._len = np.empty(0, np.int32), np.empty(0, np.int64)

    # ---- merging

    def _matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Merges byte rows of one width; the ids of each row."""
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        ids = self._byte[rows]
        which = np.arange(len(rows))
        rank = self._pairs(ids[:, :-1], ids[:, 1:])
        while len(which):
            each = np.arange(len(which))
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(which), np.int64)
            best = rank[each, at] if rank.shape[1] else np.full(len(which), NONE)
            live = best < NONE
            if not live.all():
                for k in np.flatnonzero(~live):
                    out[which[k]] = ids[k]
                ids, rank, which, at, best = ids[live], rank[live], which[live], at[live], best[live]
                each = np.arange(len(which))
                if not len(which):
                    break
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ids[each, at] = best
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._pairs(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < ids.shape[1] - 1)
            rank[right, at[right]] = self._pairs(best[right], ids[right, at[right] + 1])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """Merges one long piece. A round takes the pairs of least rank from left to
        right up to the first whose merge makes a pair of lower rank still: the
        order that merging one at a time keeps, in fewer rounds."""
        ids = self._byte[np.frombuffer(piece, np.uint8)]
        rank = self._pairs(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            # of overlapping pairs (aaa) every other one, from the left
            head = np.concatenate(([True], np.diff(at) > 1))
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            merged = np.full(len(at), best)
            left = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            left[1:][at[1:] - at[:-1] == 2] = best
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.minimum(self._pairs(left, merged), self._pairs(merged, right)) < best
            if lower.any():
                at = at[:int(lower.argmax()) + 1]
            ids[at] = best
            ids = np.delete(ids, at + 1)
            rank = np.delete(rank, at)
            now = at - np.arange(len(at))
            rank[now[now > 0] - 1] = self._pairs(ids[now[now > 0] - 1], ids[now[now > 0]])
            now = now[now < len(ids) - 1]
            rank[now] = self._pairs(ids[now], ids[now + 1])
        return ids

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        widths: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(piece) <= MATRIX_BYTES:
                widths.setdefault(len(piece), []).append(k)
            else:
                out[k] = self._long(piece)
        for width, members in widths.items():
            rows = np.frombuffer(b"".join([pieces[k] for k in members]), np.uint8).reshape(-1, width)
            for k, ids in zip(members, self._matrix(rows)):
                out[k] = ids
        return out

    # ---- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self._index) > REMEMBERED:
            self._forget()
        index, known, codes, ends = self._index, len(self._index), [], []
        for text in texts:
            codes += map(index.__getitem__, self.pieces(text))
            ends.append(len(codes))
        new = self.merged([piece.encode() for piece in islice(index, known, None)])
        self._ids = np.concatenate([self._ids, *new])
        self._len = np.concatenate([self._len, np.fromiter(map(len, new), np.int64, len(new))])
        begin = np.cumsum(self._len) - self._len
        codes = np.array(codes, np.int64)
        size = self._len[codes]
        stop = np.cumsum(size)
        ids = self._ids[np.arange(int(size.sum())) + np.repeat(begin[codes] - (stop - size), size)]
        cuts = np.concatenate(([0], stop))[np.array(ends, np.int64)]
        return [ids[a:b] for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_LOADED: dict[tuple[bytes, str], Vocabulary] = {}


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """One vocabulary a worker, however many batches it sees."""
    if (data, pattern) not in _LOADED:
        _LOADED[data, pattern] = Vocabulary(data, pattern)
    return _LOADED[data, pattern]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """``texts`` (null: empty) in runs of at most ``BLOCK_CHARS`` characters, or one text."""
    block, chars = [], 0
    for text in texts:
        text = text or ""
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield block


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of each whole text, one row for each
    input row. Null and empty texts have none; repeated rows get equal ids; an
    empty table gives no rows; other columns aren't read. The vocabulary file is
    read by the driver and sent to the workers (its size is the vocabulary's,
    not the data's). Very long texts are encoded alone, in one task; a long piece
    without a cut costs its length once for each different rank merged in it."""
    prepared(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def ids(texts: pd.Series) -> pd.Series:
        v = vocabulary(shared.value, pattern)
        return pd.Series([row for block in _blocks(texts.tolist()) for row in v.encode(block)], dtype=object)

    return docs.select("doc_id", F.pandas_udf(ids, "array<int>")("text").alias("ids"))


def decoded(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): what the ``ids`` of each row of ``encoded`` stand for
    (null: no bytes)."""
    prepared(rows)
    shared = rows.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def text(ids: pd.Series) -> pd.Series:
        v = vocabulary(shared.value, pattern)
        return pd.Series([b"" if row is None else v.decode(row) for row in ids], dtype=object)

    return rows.select("doc_id", F.pandas_udf(text, "binary")("ids").alias("bytes"))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, FIELDS...): number and hash of the ids of each text, hash of the
    bytes they decode to; rows as in ``encoded``. Both directions run in one
    pass, so the ids don't leave the worker."""
    prepared(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def score(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(shared.value, pattern)
        rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                 hashlib.sha256(v.decode(ids)).hexdigest())
                for block in _blocks(texts.tolist()) for ids in v.encode(block)]
        return pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", F.pandas_udf(score, FIELDS)("text").alias("r")).select("doc_id", "r.*")


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
