"""The end-to-end detection chain as one plan.

log lines -> typed events (P1-P4) + connection / process diffs (D1, D3, D5)
-> hourly feature vectors (F1-F5) -> baseline (M1), scaler (M2), forest
(M3/M4), z-score (M5), EMA (M6), ensemble (M7-M9) -> anomaly type (E1)
-> policy matching with repeat counts and cooldown (E2-E6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import iforest as IF
from ..operators import policy as P
from ..operators import scoring as SC
from . import q_detect as QD


def scored_vectors(spark: SparkSession, sf: str, with_forest: bool = True) -> DataFrame:
    # QD.vectors is checkpointed: baseline, scaler, forest and scoring all reread it
    vec = QD.vectors(spark, sf).withColumn("id", F.xxhash64("host", "ts"))
    base = SC.fit_baseline(vec).checkpoint()
    if_scores = None
    version = "unknown"
    if with_forest:
        z = SC.standardize(vec, base)
        zx = z.select("id", "host", "ts",
                      IF.feature_array([f"z_{f}" for f in S.FEATURE_NAMES]).alias("x")).checkpoint()
        model = IF.fit_model(zx)
        if_scores = model.isolation_score(zx).select("host", "ts", "isolation_forest_score")
        version = model.meta.get("model_version", "unknown")
    scored = SC.score_vectors(vec, base, if_scores, model_version=version)
    scored = P.classify_anomaly(scored)
    return scored.withColumn("id", F.xxhash64("host", "ts")) \
        .withColumn("source_ip", F.lit(None).cast("string"))


def alerts(spark: SparkSession, sf: str, rules: list[dict] | None = None) -> DataFrame:
    scores = scored_vectors(spark, sf)
    return P.evaluate_policies(spark, scores, rules or QD.example_rules())


def alerts_per_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts per policy and severity over the whole chain."""
    return alerts(spark, sf).groupBy("policy_name", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.round(F.max("score"), 4).alias("max_score"))
