"""Isolation forest (M3 fit, M4 score, M10 save/load).

Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008). Spark plan:

* sampling: the ``trees x 256`` rows with the least ``md5(id)`` are the pool, and
  tree ``t`` takes those of its ``min(256, n)`` rows with the least
  ``md5(id:t)``. (row, tree) pairs are first thinned by a hash bound; if a tree
  comes up short the bound is raised, so the sample is exact;
* building: ``groupBy(tree).applyInPandas`` - one small group per tree, numpy. A
  node's feature and split point come from ``md5(seed:tree:node)``, so that any
  engine grows the same forest from the same rows; nodes are numbered as in a
  heap (root 1, children 2i and 2i + 1); the output is a node table (bounded by
  trees x 511 rows);
* scoring: the node table is collected (its size is bounded by the
  parameters, not the data) and traversed with numpy inside
  ``mapInPandas`` - one vectorised pass per tree per Arrow batch;
* offset: exact 5 % quantile (linear interpolation) of the training scores, found
  by running counts over range partitions.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.ordered import exact_quantile
from ..session import task_parallelism

EULER = 0.5772156649

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),      # -1 for a leaf
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _draw(seed: int, tree: int, node: int) -> tuple[float, int]:
    """A number in [0, 1) and an integer for a node: the first 52 bits of its hash
    and the 32 after them."""
    h = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(h[:13], 16) / 2.0 ** 52, int(h[13:21], 16)


def _build_tree(x: np.ndarray, seed: int, max_depth: int, tree: int) -> list[tuple]:
    nodes: list[tuple] = []
    todo = [(1, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        leaf = (tree, node, -1, 0.0, -1, -1, depth, len(rows))
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or not len(usable):
            nodes.append(leaf)
            continue
        share, pick = _draw(seed, tree, node)
        f = int(usable[pick % len(usable)])
        cut = float(lo[f] + share * (hi[f] - lo[f]))
        if cut <= lo[f]:
            nodes.append(leaf)
            continue
        nodes.append((tree, node, f, cut, 2 * node, 2 * node + 1, depth, len(rows)))
        low = sub[:, f] < cut
        todo += [(2 * node, depth + 1, rows[low]), (2 * node + 1, depth + 1, rows[~low])]
    return nodes


def _sample_pairs(pool: DataFrame, trees: int, share: float) -> DataFrame:
    """(tree, h, x) for the rows whose hash for a tree lies in the least ``share``."""
    h = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.md5(F.concat_ws(":", "id", t.cast("string"))).alias("h")))
    if share < 1.0:
        bound = f"{int(share * 16 ** 8):08x}"
        h = F.filter(h, lambda s: F.substring(s["h"], 1, 8) < bound)
    return pool.select("id", "x", F.explode(h).alias("s")).select("s.tree", "s.h", "id", "x")


def fit_isolation_forest(df: DataFrame, id_col: str = "id", x_col: str = "x",
                         trees: int = S.IFOREST_TREES, max_samples: int = S.IFOREST_MAX_SAMPLES,
                         seed: int = S.IFOREST_SEED) -> tuple[DataFrame, int]:
    """M3: returns (node table, sample size). ``x_col`` is array<double>; ids are
    compared as text."""
    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(x_col).cast("array<double>").alias("x"))
    n = d.count()
    m = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(m, 2))))
    size = trees * max_samples
    pool = d.orderBy(F.md5("id"), "id").limit(size) if n > size else d
    pool = pool.repartition(task_parallelism(d.sparkSession)).checkpoint()
    share = 4.0 * m / max(min(n, size), 1)
    while True:
        pairs = _sample_pairs(pool, trees, share)
        if share >= 1.0 or pairs.groupBy("tree").count().filter(F.col("count") >= m).count() == trees:
            break
        share *= 4

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"]).head(m)
        x = np.array(pdf["x"].tolist(), dtype=np.float64)
        rows = _build_tree(x, seed, max_depth, int(pdf["tree"].iloc[0]))
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    return pairs.groupBy("tree").applyInPandas(build, NODE_SCHEMA), m


def forest_arrays(nodes: DataFrame):
    return _forest_arrays(nodes.toPandas())


def _forest_arrays(nodes_pdf: pd.DataFrame):
    """Per tree the node table as arrays, by heap number."""
    out = []
    for _, g in nodes_pdf.groupby("tree"):
        at, size = g["node"].to_numpy(np.int64), int(g["node"].max()) + 1
        arrays = []
        for values, empty in ((g["feature"], -1), (g["threshold"], 0.0), (g["left"], 0), (g["right"], 0),
                              (g["depth"] + g["size"].map(c_factor), 0.0)):
            a = np.full(size, empty, np.int64 if isinstance(empty, int) else np.float64)
            a[at] = values.to_numpy()
            arrays.append(a)
        out.append(tuple(arrays))
    return out


def _path_lengths(x: np.ndarray, forest) -> np.ndarray:
    total = np.zeros(len(x))
    for feat, thr, left, right, leaf_h in forest:
        cur = np.ones(len(x), dtype=np.int64)
        while True:
            f = feat[cur]
            inner = f >= 0
            if not inner.any():
                break
            fi = np.where(inner, f, 0)
            val = x[np.arange(len(x)), fi]
            nxt = np.where(val < thr[cur], left[cur], right[cur])
            cur = np.where(inner, nxt, cur)
        total += leaf_h[cur]
    return total / max(len(forest), 1)


def score_samples(df: DataFrame, nodes: DataFrame, sample_size: int, x_col: str = "x",
                  out: str = "if_raw", forest=None) -> DataFrame:
    """-2^(-E[h(x)]/c(sample_size)) per row (sklearn's ``score_samples``).

    ``forest`` is the collected node table (``forest_arrays``); its size is
    bounded by trees x (2 x max_samples - 1), whatever the data size."""
    if forest is None:
        forest = forest_arrays(nodes)
    cn = c_factor(sample_size)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{out: pd.Series(dtype="float64")})
                continue
            x = np.array(pdf[x_col].tolist(), dtype=np.float64)
            eh = _path_lengths(x, forest)
            pdf[out] = -np.power(2.0, -eh / cn) if cn > 0 else -1.0
            yield pdf

    return df.mapInPandas(run, schema)


class IsolationForestModel:
    def __init__(self, nodes: DataFrame, sample_size: int, offset: float, meta: dict | None = None,
                 forest=None):
        self.nodes, self.sample_size, self.offset = nodes, sample_size, offset
        self.meta = meta or {}
        self._forest = forest

    @property
    def forest(self):
        if self._forest is None:
            self._forest = forest_arrays(self.nodes)
        return self._forest

    def isolation_score(self, df: DataFrame, x_col: str = "x",
                        out: str = "isolation_forest_score") -> DataFrame:
        """M4: clamp(0.5 - (score_samples - offset), 0, 1)."""
        s = score_samples(df, self.nodes, self.sample_size, x_col, "__raw", self.forest)
        return s.withColumn(out, F.least(F.lit(1.0), F.greatest(
            F.lit(0.0), F.lit(0.5) - (F.col("__raw") - F.lit(self.offset))))).drop("__raw")

    # M10 ---------------------------------------------------------------
    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        meta = dict(self.meta, sample_size=self.sample_size, offset=self.offset)
        spark = self.nodes.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(os.path.join(path, "metadata"))

    @classmethod
    def load(cls, spark: SparkSession, paths: list[str] | str) -> "IsolationForestModel | None":
        """Load from the first path of the search list that holds a model."""
        for p in [paths] if isinstance(paths, str) else paths:
            try:
                meta = json.loads(spark.read.text(os.path.join(p, "metadata")).first()[0])
                nodes = spark.read.parquet(os.path.join(p, "nodes"))
            except Exception:  # noqa: BLE001 - try the next location
                continue
            return cls(nodes, int(meta["sample_size"]), float(meta["offset"]), meta)
        return None


def fit_model(df: DataFrame, id_col: str = "id", x_col: str = "x",
              contamination: float = S.IFOREST_CONTAMINATION, **kw) -> IsolationForestModel:
    """M3 + offset: the offset is the exact ``contamination`` quantile of the
    training scores, so that ``decision = score - offset`` is 0 at that quantile."""
    nodes, m = fit_isolation_forest(df, id_col, x_col, **kw)
    nodes = nodes.checkpoint(eager=True)  # cut lineage; lives in spark.checkpoint.dir
    forest = forest_arrays(nodes)
    scored = score_samples(df.select(F.col(x_col).cast("array<double>").alias("x")), nodes, m, "x",
                           forest=forest)
    offset = exact_quantile(scored, "if_raw", contamination)
    meta = {"model_version": "iforest_v1", "trees": kw.get("trees", S.IFOREST_TREES),
            "max_samples": kw.get("max_samples", S.IFOREST_MAX_SAMPLES), "n_features": None}
    return IsolationForestModel(nodes, m, float(offset), meta, forest)


def feature_array(cols) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
