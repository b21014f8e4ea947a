"""Anomaly scoring.

Per-row scoring is column arithmetic. The baseline is one aggregate row
(24 numbers, a proven size bound), joined by a broadcast on a constant key.
The EMA needs each host's last 60 raw scores: exact row numbers come from
bucketed prefix counts and the 60-row frame is evaluated in row-number
chunks (``functions.ordered``), so a busy host is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ordered import rows_frame
from .folds import epoch_micros, period_starts


def fit_baseline(vectors: DataFrame, features=S.FEATURE_NAMES) -> DataFrame:
    """M1: (feature, mean, std) with the population standard deviation."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"{f}__m"),
                 F.stddev_pop(F.col(f).cast("double")).alias(f"{f}__s")]
    wide = vectors.agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}__m`, `{f}__s`" for f in features)
    return wide.selectExpr(f"stack({len(features)}, {stack}) as (feature, mean, std)")


def _baseline_row(baseline: DataFrame, features) -> DataFrame:
    """One-row wide form of the long baseline (size bounded by the feature count)."""
    aggs = []
    for f in features:
        aggs += [F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"__mean_{f}"),
                 F.max(F.when(F.col("feature") == f, F.col("std"))).alias(f"__std_{f}")]
    return baseline.agg(*aggs).withColumn("__one", F.lit(1))


def with_baseline(vectors: DataFrame, baseline: DataFrame, features=S.FEATURE_NAMES) -> DataFrame:
    row = _baseline_row(baseline, features)
    return vectors.withColumn("__one", F.lit(1)).join(F.broadcast(row), "__one").drop("__one")


def standardize(vectors: DataFrame, baseline: DataFrame, features=S.FEATURE_NAMES) -> DataFrame:
    """M2: (x - mean) / std per feature, std 0 -> 1 (columns ``z_<feature>``)."""
    d = with_baseline(vectors, baseline, features)
    for f in features:
        std = F.col(f"__std_{f}")
        std = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
        d = d.withColumn(f"z_{f}", (F.col(f) - F.coalesce(F.col(f"__mean_{f}"), F.lit(0.0))) / std)
    return d.drop(*[c for c in d.columns if c.startswith("__mean_") or c.startswith("__std_")])


def zscore_col(features=S.FEATURE_NAMES) -> Column:
    """M5 over columns ``f`` and ``__mean_f``/``__std_f`` (missing stat -> mean 0, std 1)."""
    zs = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        mean = F.coalesce(F.col(f"__mean_{f}"), F.lit(0.0))
        std = F.coalesce(F.col(f"__std_{f}"), F.lit(1.0))
        delta = F.abs(x - mean)
        floor = F.greatest(F.abs(mean) * S.ZSCORE_MIN_RELATIVE_CHANGE,
                           F.lit(S.ZSCORE_MIN_ABSOLUTE_CHANGE))
        zs.append(F.when(delta < floor, F.lit(0.0))
                  .otherwise(delta / F.greatest(std, F.lit(S.ZSCORE_STD_FLOOR))))
    top = F.slice(F.sort_array(F.array(*zs), asc=False), 1, S.ZSCORE_TOP_N)
    avg_top = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return F.least(F.lit(1.0), avg_top / S.ZSCORE_DIVISOR)


def zscore_score(vectors: DataFrame, baseline: DataFrame, features=S.FEATURE_NAMES) -> DataFrame:
    d = with_baseline(vectors, baseline, features).withColumn("zscore_score", zscore_col(features))
    return d.drop(*[c for c in d.columns if c.startswith("__mean_") or c.startswith("__std_")])


def ensemble_raw(if_score: Column, z_score: Column) -> Column:
    """M7 (first half)."""
    return (S.ENSEMBLE_IF_WEIGHT * if_score + S.ENSEMBLE_Z_WEIGHT * z_score
            + S.ENSEMBLE_MAX_WEIGHT * F.greatest(if_score, z_score))


def ema_over(values: Column) -> Column:
    """M6: EMA over an oldest-first array, seeded with its first element; clamp 0..1."""
    seed = F.element_at(values, 1)
    rest = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    ema = F.aggregate(rest, seed, lambda a, x: S.EMA_ALPHA * x + (1 - S.EMA_ALPHA) * a)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), ema))


def ema_score(df: DataFrame, value: str, keys=("host",), ts: str = "ts", tie: str = "ts",
              n: int = S.EMA_WINDOW, out: str = "ema_score") -> DataFrame:
    """M6 per key over the last ``n`` values (incl. the current row)."""
    keys = list(keys)
    order = [ts] if tie == ts else [ts, tie]
    d = rows_frame(df, keys, order, n, F.col(value), "__last")
    return d.withColumn(out, ema_over(F.col("__last"))).drop("__last")


def risk_level_col(score: Column) -> Column:
    """M8 on the unrounded final score."""
    c = None
    for thr, name in S.RISK_LEVELS:
        c = F.when(score >= thr, name) if c is None else c.when(score >= thr, name)
    return c.otherwise("normal")


def score_vectors(vectors: DataFrame, baseline: DataFrame, if_scores: DataFrame | None = None,
                  model_version: str = "unknown", features=S.FEATURE_NAMES) -> DataFrame:
    """M5-M9: z-score, optional isolation-forest score, EMA, ensemble, risk level, record.

    ``if_scores`` is ``(host, ts, isolation_forest_score)``; without a model the
    forest score is 0 as in the original scorer."""
    d = zscore_score(vectors, baseline, features)
    if if_scores is not None:
        d = d.join(if_scores, ["host", "ts"], "left")
        d = d.withColumn("isolation_forest_score",
                         F.coalesce(F.col("isolation_forest_score"), F.lit(0.0)))
    else:
        d = d.withColumn("isolation_forest_score", F.lit(0.0))
    d = d.withColumn("raw_score", ensemble_raw(F.col("isolation_forest_score"),
                                               F.col("zscore_score")))
    d = ema_score(d, "raw_score")
    final = F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), S.FINAL_RAW_WEIGHT * F.col("raw_score") + S.FINAL_EMA_WEIGHT * F.col("ema_score")))
    d = d.withColumn("__final", final)
    fmap = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    return d.select(
        "host", "ts",
        F.round("__final", 4).alias("score"),
        risk_level_col(F.col("__final")).alias("risk_level"),
        F.round("isolation_forest_score", 4).alias("isolation_forest_score"),
        F.round("zscore_score", 4).alias("zscore_score"),
        F.round("ema_score", 4).alias("ema_score"),
        F.lit(model_version).alias("model_version"),
        fmap.alias("features"),
        *[F.col(f) for f in features],
    )


def latest_score(scores: DataFrame, keys=("host",), ts: str = "ts", tie: str = "id") -> DataFrame:
    """Newest score per key (partial aggregate, so hot keys combine map-side)."""
    cols = [c for c in scores.columns if c not in keys]
    order = F.struct(ts, tie) if tie in scores.columns else F.struct(ts)
    g = scores.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("__r"))
    return g.select(*keys, "__r.*")


def anomaly_periods(scores: DataFrame, keys=("host",), ts: str = "ts", tie: str = "id",
                    threshold: float = S.ANOMALY_SCORE_THRESHOLD,
                    period_seconds: int = S.ANOMALY_PERIOD_SECONDS) -> DataFrame:
    """Anomalies (rounded score > threshold) counted per fixed period that
    starts at the first anomaly after the previous period ended."""
    keys = list(keys)
    a = scores.filter(F.round("score", 4) > threshold) \
        .withColumn("__t", epoch_micros(F.col(ts)))
    # periods are long here: two to a bucket, so that a busy host is cut finely
    p = period_starts(a, keys, "__t", tie, period_seconds * 1_000_000, levels=(2, 4, 4, 4))
    return p.groupBy(*keys, "period_start").agg(F.count(F.lit(1)).alias("anomalies")) \
        .select(*keys, F.timestamp_micros("period_start").cast("timestamp_ntz").alias("period_start"),
                F.col("anomalies").cast("long").alias("anomalies"))
