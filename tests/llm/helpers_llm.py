"""Small tables with every awkward case, shared by the operator tests."""

from __future__ import annotations

import random

BASE = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like the operators' own.
EXTRA = BASE + ", size string, shard string, k1 string, `row` string, kept string, runs string, score string, h string"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocab) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long one, ties and
    repeated rows."""
    long = prose(1, 8000)
    a, b = prose(2, 180), prose(3, 150)
    texts = [(1, a), (2, a), (2, a), (3, b), (4, None), (5, ""), (6, " \n\t "), (7, long), (None, b), (None, None),
             (8, long[:40_000]), (9, "one"), (10, "é ü 漢字 \U0001f600 " * 30), (11, a + "\n" + b), (12, "x" * 3000)]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t))
            for k, (i, t) in enumerate(texts)]


def table(spark, rows, extra: bool = False):
    if extra:
        return spark.createDataFrame([(*r, *["?"] * 8) for r in rows], EXTRA)
    return spark.createDataFrame(rows, BASE)


def key(row) -> str:
    return repr(tuple(row))
