"""Policy evaluation.

Plan shape: scores x rules is a broadcast nested-loop join against a rule
table of a handful of rows; the repeat count (E4) is a bucketed range count
per dedup key; the cooldown (E5) is a greedy fold per dedup key. The dedup
key includes the source IP, so the work hashes by attacker, not by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ordered import count_in_range
from ..sources.config import active_rules, rules_frame
from .folds import epoch_micros, period_starts

MICROS = 1_000_000


def classify_anomaly(vectors: DataFrame) -> DataFrame:
    """Anomaly type from the most elevated feature group."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    auth, sudo = c("log_auth_failures"), c("log_sudo_attempts")
    t = (
        F.when((auth > 5) | (sudo > 3), F.when(auth > 10, "brute_force").otherwise("ssh_failure"))
        .when((c("net_port_scan_candidates") > 0) | (c("net_new_connections") > 50), "port_scan")
        .when((c("proc_cpu_spikes") > 0) | (c("proc_memory_spikes") > 0)
              | (c("proc_new_spawns") > 10) | (c("proc_unusual_children") > 0), "process_spike")
        .otherwise("unknown")
    )
    return vectors.withColumn("anomaly_type", t)


def match_rules(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """Score >= threshold and (rule type empty, event type empty, or equal)."""
    r = rules.filter("enabled").select(
        F.col("name").alias("policy_name"), F.col("score_above"),
        F.col("anomaly_type").alias("rule_anomaly_type"),
        "repeated_within_seconds", "min_occurrences", "action", "severity", "notify")
    ev_type = F.coalesce(F.col("anomaly_type"), F.lit(""))
    rule_type = F.coalesce(F.col("rule_anomaly_type"), F.lit(""))
    cond = (F.col("score") >= F.col("score_above")) & (
        (rule_type == "") | (ev_type == "") | (rule_type == ev_type))
    return scores.join(F.broadcast(r), cond, "inner")


def dedup_key(rule: Column, anomaly_type: Column, source_ip: Column) -> Column:
    """First 16 hex of sha256('rule:type:ip'), missing parts as ''."""
    raw = F.concat_ws(":", F.coalesce(rule, F.lit("")), F.coalesce(anomaly_type, F.lit("")),
                      F.coalesce(source_ip, F.lit("")))
    return F.substring(F.sha2(raw, 256), 1, 16)


def repeat_counts(matches: DataFrame, t: str = "__t", tie: str = "id",
                  idle: int = S.DEDUP_IDLE_TTL_SECONDS) -> DataFrame:
    """For rules with a repeat window w > 0, the number of matches of the
    same dedup key in (t - w, t] (suppressed ones included). Each key belongs
    to one rule, so w is a column of the one count for all rules. A key's
    occurrences expire after ``idle`` seconds without a match."""
    return count_in_range(matches, ["dedup_key"], t, tie, F.col("repeated_within_seconds") * MICROS,
                          "repeat_count", idle=idle * MICROS)


def apply_cooldown(passing: DataFrame, cooldown: int = S.ALERT_COOLDOWN_SECONDS,
                   t: str = "__t", tie: str = "id") -> DataFrame:
    """E5: rules with w > 0 fire for a key at most once per ``cooldown`` seconds
    (greedy: measured from the last *fired* alert)."""
    windowed = passing.filter(F.col("repeated_within_seconds") > 0)
    fired = period_starts(windowed.select("dedup_key", t, tie), ["dedup_key"], t, tie,
                          cooldown * MICROS).filter("opens").select("dedup_key", tie)
    kept = windowed.join(fired, ["dedup_key", tie], "left_semi")
    return passing.filter(F.col("repeated_within_seconds") <= 0).unionByName(kept)


def type_label(t: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in S.ANOMALY_TYPE_LABELS.items() for x in kv])
    return F.coalesce(m[t], t)


def alert_message(severity: Column, name: Column, score: Column, anomaly_type: Column,
                  source_ip: Column, action: Column) -> Column:
    """E7; the score is rounded half-up to 2 dp before printing."""
    at = F.when(F.coalesce(anomaly_type, F.lit("")) != "", anomaly_type)
    ip = F.when(F.coalesce(source_ip, F.lit("")) != "", source_ip)
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), F.upper(severity), F.lit("] Policy '"), name, F.lit("' triggered")),
        F.concat(F.lit("(score: "), F.format_string("%.2f", F.round(score, 2)), F.lit(")")),
        F.when(at.isNotNull(), F.concat(F.lit("— "), type_label(at))),
        F.when(ip.isNotNull(), F.concat(F.lit("from "), ip)),
        F.when(action != "alert_only", F.concat(F.lit("→ Action: "), action)),
    )


def top_features(features: Column, n: int = S.TOP_FEATURES_N) -> Column:
    """The ``n`` largest positive features as (name, value), largest first (ties
    by name)."""
    pos = F.filter(F.map_entries(features), lambda e: e["value"] > 0)
    keyed = F.transform(pos, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.slice(F.transform(F.sort_array(keyed), lambda e: F.struct(e["k"].alias("name"), (-e["v"]).alias("value"))), 1, n)


def alert_id(rule: Column, key: Column, score_id: Column) -> Column:
    """The whole hash: sinks drop rows by this key, so it must not collide."""
    return F.concat(F.lit("alert_"), F.sha2(F.concat_ws("|", rule, key, score_id.cast("string")), 256))


def make_alerts(fired: DataFrame) -> DataFrame:
    """Alert rows."""
    top = top_features(F.col("features"))
    conds = F.to_json(F.struct(
        F.col("score_above"), F.col("rule_anomaly_type").alias("anomaly_type"),
        F.col("repeated_within_seconds"), F.col("min_occurrences")))
    return fired.select(
        alert_id(F.col("policy_name"), F.col("dedup_key"), F.col("id")).alias("alert_id"),
        F.col("id").alias("score_id"), "ts", "host", "policy_name", "severity",
        F.round("score", 4).alias("score"), "risk_level",
        F.coalesce(F.when(F.col("anomaly_type") != "", F.col("anomaly_type")),
                   F.lit("unknown")).alias("anomaly_type"),
        F.coalesce(F.col("source_ip"), F.lit("")).alias("source_ip"),
        "action", "notify",
        alert_message(F.col("severity"), F.col("policy_name"), F.col("score"),
                      F.col("anomaly_type"), F.col("source_ip"), F.col("action")).alias("message"),
        F.array_join(F.transform(top, lambda e: e["name"]), ",").alias("top_features"),
        F.map_from_entries(top).alias("contributing_features"),
        conds.alias("rule_conditions"), "dedup_key",
    )


def evaluate_policies(spark: SparkSession, scores: DataFrame, rules: list[dict],
                      stage: str = "alerts") -> DataFrame:
    """E2-E6 over score rows ``(id, ts, host, score, risk_level, anomaly_type,
    source_ip, features)``. ``stage`` returns an intermediate result:
    ``matches`` (E2+E3), ``counted`` (E4), ``passing`` (E4 filter),
    ``fired`` (E5) or ``alerts`` (E6)."""
    act = active_rules(rules)
    m = match_rules(scores, rules_frame(spark, act))
    m = m.withColumn("dedup_key", dedup_key(F.col("policy_name"), F.col("anomaly_type"),
                                            F.col("source_ip"))) \
        .withColumn("__t", epoch_micros(F.col("ts")))
    if stage == "matches":
        return m.drop("__t")
    c = repeat_counts(m)
    if stage == "counted":
        return c.drop("__t")
    passing = c.filter((F.col("repeated_within_seconds") <= 0)
                       | (F.col("repeat_count") >= F.col("min_occurrences")))
    if stage == "passing":
        return passing.drop("__t")
    # read three times: twice by the fold, then to keep what fired
    fired = apply_cooldown(passing.checkpoint())
    if stage == "fired":
        return fired.drop("__t")
    return make_alerts(fired)


def alert_counters(alerts: DataFrame, as_of: str, ttl_seconds: int = 3600) -> DataFrame:
    """Total alerts and the latest alert if younger than the TTL at ``as_of``."""
    g = alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                   F.max_by(F.struct("ts", "alert_id"), F.struct("ts", "alert_id")).alias("l"))
    fresh = F.col("l.ts") > F.lit(as_of).cast("timestamp_ntz") - F.expr(
        f"INTERVAL {int(ttl_seconds)} SECONDS")
    return g.select(F.col("total_alerts").cast("long").alias("total_alerts"),
                    F.when(fresh, F.col("l.alert_id")).alias("latest_alert_id"),
                    F.when(fresh, F.col("l.ts")).alias("latest_alert_ts"))
