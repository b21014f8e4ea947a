"""Operator 6: toxicity by a linear classifier on character n-grams.

Features are the character n-grams present in a text, scaled by naive Bayes
log-count ratios of the training rows; a logistic regression on them gives the
score. The model is fitted on a bounded sample and sent to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import hash_sample, prepared

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """``grams``: lengths of the n-grams; ``bits``: log2 of the number of hashed
    features. The training sample is bounded: at most ``toxic_rows`` rows marked
    toxic and ``clean_rows`` others, those with the least hashes of the id, and of a
    text longer than ``train_chars`` as many characters from a hashed place.
    ``smooth``: added to feature counts; ``penalty``: of the squared weights;
    ``accept``: the score from which a text is taken as toxic."""
    grams: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    toxic_rows: int = 1500
    clean_rows: int = 3000
    train_chars: int = 6_000
    smooth: float = 1.0
    penalty: float = 1e-4
    steps: int = 60
    accept: float = 0.7


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def features(text: str | None, s: Settings = Settings()) -> np.ndarray:
    """Hashed n-grams of the lower-case text at every position, with one blank
    for every run of blanks; not yet made distinct."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    chars = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, rolling, have = [], chars + _U(1), 1
    for n in s.grams:
        while have < n and len(rolling) > 1:
            rolling, have = rolling[:-1] * _U(0x9E3779B97F4A7C15) + chars[have:] + _U(1), have + 1
        if have < n:
            break
        out.append(_mix(rolling) >> _U(64 - s.bits))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """``weights``: of every hashed feature (regression weight times log-count
    ratio), zero where the sample has nothing to say; ``bias``: the intercept."""
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, s: Settings = Settings()) -> float:
        """Between 0 and 1; a text without features scores by the intercept."""
        found = features(text, s)
        found = np.unique(found[self.weights[found] != 0])
        z = float(self.weights[found].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _regression(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """(weights of the features, intercept), by gradient steps on all rows (Adam)."""
    size = 1 << s.bits
    pos, neg = np.zeros(size), np.zeros(size)
    for found, toxic in zip(rows, y):
        (pos if toxic else neg)[found] += 1
    seen = pos + neg >= 3  # rarer n-grams tell too little
    ratio = np.log((pos + s.smooth) / (y.sum() + s.smooth)) - np.log((neg + s.smooth) / ((1 - y).sum() + s.smooth))
    telling = np.flatnonzero(seen & (np.abs(ratio) > 0.5))
    place = np.full(size, -1, np.int32)
    place[telling] = np.arange(len(telling))
    rows = [placed[placed >= 0] for placed in (place[found] for found in rows)]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    col = np.concatenate(rows)
    value = ratio[telling][col]
    length = np.bincount(row, weights=value * value, minlength=len(rows)).mean() ** 0.5 or 1.0
    value = value / length  # rows of about unit length on average
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels count the same
    w, b = np.zeros(len(telling)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, s.steps + 1):
        z = np.bincount(row, weights=value * w[col], minlength=len(rows)) + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(col, weights=value * g[row], minlength=len(w)) + s.penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[telling] = w * ratio[telling] / length
    return weights, b


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The score above which labels are told best, nearer to the last toxic row than
    to the next one. F0.5 is the measure: a clean text taken as toxic counts more
    than a missed one."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f_half = 1.25 * hit / (np.arange(1, len(z) + 1) + 0.25 * y.sum())
    k = int(np.argmax(f_half))
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float(0.75 * z[order[k]] + 0.25 * below)


def fit(texts: list[str], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fits the regression on the whole sample. Two more, each on every other row
    and applied to the rest, tell where the labels part; the intercept puts that
    place at a score of ``accept``."""
    y = labels.astype(np.float64)
    if min(y.sum(), (1 - y).sum()) < 4:
        # hardly a row of one label: everything scores as that label's share
        p = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Model(np.zeros(1 << s.bits, np.float32), float(np.log(p / (1 - p))))
    rows = [np.unique(features(t, s).astype(np.int32)) for t in texts]
    fold = np.empty(len(y), bool)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % 2 == 0
    z = np.empty(len(y))
    for part in (fold, ~fold):
        weights, b = _regression([r for r, p in zip(rows, part) if p], y[part], s)
        z[~part] = [weights[r].sum() + b for r, p in zip(rows, part) if not p]
    cut = _best_cut(z, y)
    weights, b = _regression(rows, y, s)
    return Model(weights, float(b) - cut + float(np.log(s.accept / (1 - s.accept))))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The bounded sample (text, toxic): labelled rows whose crc32(doc_id as
    text) leaves no remainder 1 by 3, of either label those with the least hashes
    of the id. Labels other than 0 and 1 are left out; of several labels of an id
    the greatest counts.

    The sample is drawn from ids alone; only its bounded list of ids meets the
    texts, so that these aren't shuffled."""
    marked = (labels.select(F.col("doc_id").alias("id"), "toxic").filter(F.col("toxic").isin(0, 1))
              .filter(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % 3 != 1)
              .groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
              .join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi"))
    marked = marked.checkpoint()
    drawn = (hash_sample(marked.filter("toxic = 1"), s.toxic_rows, "id")
             .unionByName(hash_sample(marked.filter("toxic = 0"), s.clean_rows, "id")))
    rows = (docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(drawn), "id")  # at most toxic_rows + clean_rows ids
            .withColumn("h", F.xxhash64("text")))
    at = F.pmod("h", F.greatest(F.lit(1), F.length("text") - s.train_chars)).cast("int")
    part = F.when(F.length("text") > s.train_chars, F.substr("text", at + 1, F.lit(s.train_chars))).otherwise(F.col("text"))
    # an id may stand for many rows; the bound holds for texts
    return (rows.select(part.alias("text"), "toxic", "h").orderBy("h", "text", "toxic")
            .limit(s.toxic_rows + s.clean_rows).select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    sample = training_rows(docs, labels, s).toPandas()
    return fit(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64), s)


def scored(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each input row.

    Null and empty texts score by the intercept; equal texts score the same; a
    null id is not held out; an empty table gives no rows. Other columns aren't
    read."""
    prepared(docs)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        model = broadcast.value
        return pd.Series([model.score(t, s) for t in texts], dtype=float)

    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    return (docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"),
                        F.pandas_udf(score, "double")("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= s.accept).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Trains on the labelled rows that aren't held out and scores every text."""
    prepared(docs)
    return scored(docs, train(docs, labels, s), s)
