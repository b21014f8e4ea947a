"""Registered queries: parsing, diffs, features, scoring, policy (P, D, F, M, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import features as FE
from ..operators import logs as L
from ..operators import netflow as N
from ..operators import policy as P
from ..operators import processes as PR
from ..operators import scoring as SC
from ..sources.config import load_rules
from ..session import read_table
from . import views as V
from .forestsql import forest
from .registry import register
from .sqlviews import with_views

WINDOW = 3600          # feature window used on the driver data (events are sparse)
SCAN_WINDOW = "1 day"  # port-scan tracker window on the driver data


# ---------------------------------------------------------------- shared inputs

def logs(spark: SparkSession, sf: str) -> DataFrame:
    return L.classify_logs(V.raw_logs(spark, sf))


def new_conns(spark: SparkSession, sf: str) -> DataFrame:
    return N.new_connections(V.connections(spark, sf)).withColumn(
        "ts", F.timestamp_seconds(F.col("snap") * V.SNAP_SECONDS_CONN).cast("timestamp_ntz"))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return N.port_scan_candidates(new_conns(spark, sf), SCAN_WINDOW)


def network_events(spark: SparkSession, sf: str) -> DataFrame:
    nc = new_conns(spark, sf).select("host", "ts", "type", F.col("remote_ip").alias("source_ip"))
    sc = scans(spark, sf).select("host", F.col("window_start").alias("ts"), "type",
                                 F.col("remote_ip").alias("source_ip"))
    return nc.unionByName(sc)


def process_events(spark: SparkSession, sf: str) -> DataFrame:
    return PR.process_events(V.processes(spark, sf)).withColumn(
        "ts", F.timestamp_seconds(F.col("snap") * V.SNAP_SECONDS_PROC).cast("timestamp_ntz"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return FE.union_telemetry(logs(spark, sf), network_events(spark, sf),
                              process_events(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly feature vectors; checkpointed because every scoring step reads them
    more than once (baseline, scaler, forest, EMA)."""
    return FE.feature_vectors(telemetry(spark, sf), WINDOW).checkpoint(eager=True)


def example_rules() -> list[dict]:
    return load_rules(rules=list(S.EXAMPLE_RULES))


# ---------------------------------------------------------------- SQL pieces

NEWCONN_SQL = """
csnaps AS (SELECT host, snap, lag(snap) OVER (PARTITION BY host ORDER BY snap) AS prev_snap
           FROM (SELECT DISTINCT host, snap FROM connections)),
newconn AS (
  SELECT c.*, make_timestamp(c.snap * 21600 * 1000000) AS ts
  FROM connections c JOIN csnaps s ON c.host = s.host AND c.snap = s.snap
  WHERE c.remote_ip <> '0.0.0.0' AND NOT EXISTS (
    SELECT 1 FROM connections p WHERE p.host = c.host AND p.snap = s.prev_snap
      AND p.remote_ip = c.remote_ip AND p.remote_port = c.remote_port
      AND p.local_ip = c.local_ip AND p.local_port = c.local_port)),
scans AS (
  SELECT host, date_trunc('day', ts) AS window_start, remote_ip,
         CAST(count(DISTINCT local_port) AS BIGINT) AS ports
  FROM newconn GROUP BY host, date_trunc('day', ts), remote_ip
  HAVING count(DISTINCT local_port) > 5)"""

CHILD_PAIRS = ", ".join(f"('{p}', '{c}')" for p, kids in S.SUSPICIOUS_CHILDREN.items()
                        for c in kids)

PROC_SQL = f"""
psnaps AS (SELECT host, snap, lag(snap) OVER (PARTITION BY host ORDER BY snap) AS prev_snap
           FROM (SELECT DISTINCT host, snap FROM processes)),
child_pairs(parent, child) AS (VALUES {CHILD_PAIRS}),
pflags AS (
  SELECT p.*, (pp.pid IS NULL) AS is_new,
    p.cpu_percent > 80 AS cpu_spike, p.memory_mb > 500 AS memory_spike,
    EXISTS (SELECT 1 FROM child_pairs cp WHERE cp.parent = p.parent_name AND cp.child = p.name) AS unusual_child
  FROM processes p JOIN psnaps s ON p.host = s.host AND p.snap = s.snap
  LEFT JOIN processes pp ON pp.host = p.host AND pp.snap = s.prev_snap AND pp.pid = p.pid),
pev AS (
  SELECT *, CASE WHEN is_new THEN 'new_process' ELSE 'process_snapshot' END AS type,
    (cpu_spike OR memory_spike OR unusual_child) AS risk_flag,
    CASE WHEN unusual_child THEN 'Unusual child: ' || parent_name || ' → ' || name
         WHEN memory_spike THEN printf('High memory: %.0fMB', round(memory_mb, 0))
         WHEN cpu_spike THEN printf('High CPU: %.1f%%', round(cpu_percent, 1)) END AS risk_reason
  FROM pflags)"""

TEL_SQL = """
tel AS (
  SELECT host, ts, 'logs' AS stream, type, NULL AS source_ip, NULL AS risk_reason FROM logs
  UNION ALL SELECT host, ts, 'network', 'new_connection', remote_ip, NULL FROM newconn
  UNION ALL SELECT host, window_start, 'network', 'port_scan_candidate', remote_ip, NULL FROM scans
  UNION ALL SELECT host, make_timestamp(snap * 86400 * 1000000), 'processes', type, NULL, risk_reason
            FROM pev WHERE is_new OR risk_flag),
vec AS (
  SELECT host, date_trunc('hour', ts) AS ts, 3600 AS window_seconds,
    count(*) FILTER (WHERE stream = 'logs') AS log_total_events,
    count(*) FILTER (WHERE stream = 'logs' AND type IN ('ssh_failure', 'auth_failure')) AS log_auth_failures,
    count(*) FILTER (WHERE stream = 'logs' AND type = 'sudo_attempt') AS log_sudo_attempts,
    count(*) FILTER (WHERE stream = 'logs' AND type = 'service_restart') AS log_service_restarts,
    count(*) FILTER (WHERE stream = 'network' AND type = 'new_connection') AS net_new_connections,
    count(DISTINCT CASE WHEN stream = 'network' AND type = 'new_connection'
                         AND coalesce(source_ip, '') <> '' THEN source_ip END) AS net_unique_ips,
    count(*) FILTER (WHERE stream = 'network' AND type = 'port_scan_candidate') AS net_port_scan_candidates,
    CAST(0.0 AS DOUBLE) AS net_bytes_rate,
    count(*) FILTER (WHERE stream = 'processes' AND type = 'new_process') AS proc_new_spawns,
    count(*) FILTER (WHERE stream = 'processes' AND contains(coalesce(risk_reason, ''), 'High CPU')) AS proc_cpu_spikes,
    count(*) FILTER (WHERE stream = 'processes' AND contains(coalesce(risk_reason, ''), 'High memory')) AS proc_memory_spikes,
    count(*) FILTER (WHERE stream = 'processes' AND contains(coalesce(risk_reason, ''), 'Unusual child')) AS proc_unusual_children
  FROM tel GROUP BY host, date_trunc('hour', ts))"""

FEATS = list(S.FEATURE_NAMES)

BASELINE_SQL = "baseline AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} AS DOUBLE)) AS mean, stddev_pop(CAST({f} AS DOUBLE)) AS std FROM vec"
    for f in FEATS) + ")"


def _z_expr(f: str) -> str:
    m = f"coalesce((SELECT mean FROM baseline WHERE feature = '{f}'), 0.0)"
    s = f"coalesce((SELECT std FROM baseline WHERE feature = '{f}'), 1.0)"
    return (f"CASE WHEN abs({f} - {m}) < greatest(abs({m}) * 0.1, 0.5) THEN 0.0 "
            f"ELSE abs({f} - {m}) / greatest({s}, 0.5) END")


_ZSCORE_SQL = """
zs AS (
  SELECT *, least(1.0, list_sum(list_sort([""" + ", ".join(_z_expr(f) for f in FEATS) + """], 'DESC')[1:3]) / 3 / 6.0) AS zscore_score
  FROM vec),
ens AS (SELECT *, 0.5 * isof + 0.3 * zscore_score + 0.2 * greatest(isof, zscore_score) AS raw_score FROM {scored_by}),
emas AS (
  SELECT *, least(1.0, greatest(0.0, list_reduce(
    list(raw_score) OVER (PARTITION BY host ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
    lambda a, x: 0.3 * x + 0.7 * a))) AS ema_score
  FROM ens),
scored AS (
  SELECT *, least(1.0, greatest(0.0, 0.7 * raw_score + 0.3 * ema_score)) AS final_score FROM emas)"""

ZSCORE_SQL = _ZSCORE_SQL.replace("{scored_by}", "(SELECT *, 0.0 AS isof FROM zs)")
_X_SQL = """xs AS (SELECT host || '|' || CAST(ts AS VARCHAR) AS id, [""" + ", ".join(
    f"({f} - (SELECT mean FROM baseline WHERE feature = '{f}')) / (SELECT CASE WHEN std = 0 THEN 1.0 ELSE std END "
    f"FROM baseline WHERE feature = '{f}')" for f in FEATS) + "]::DOUBLE[] AS x FROM vec)"

RISK_SQL = ("CASE WHEN {x} >= 0.8 THEN 'critical' WHEN {x} >= 0.6 THEN 'suspicious' "
            "WHEN {x} >= 0.4 THEN 'elevated' ELSE 'normal' END")

RULES_SQL = "rules(policy_name, score_above, rule_type, w, min_occ, action, severity, notify) AS (VALUES " + \
    ", ".join(
        "('{n}', {s}, {t}, {w}, {m}, '{a}', '{sev}', {no})".format(
            n=r["name"], s=r["conditions"]["score_above"],
            t=("'" + r["conditions"]["anomaly_type"] + "'") if r["conditions"].get("anomaly_type") else "NULL",
            w=r["conditions"].get("repeated_within_seconds", 0),
            m=r["conditions"].get("min_occurrences", 1), a=r["action"], sev=r["severity"],
            no="true" if r["notify"] else "false")
        for r in S.EXAMPLE_RULES if r["enabled"]) + ")"

MATCH_SQL = """
matches AS (
  SELECT s.*, r.*,
    substr(sha256(r.policy_name || ':' || coalesce(s.anomaly_type, '') || ':' || coalesce(s.source_ip, '')), 1, 16) AS dedup_key,
    epoch_us(s.ts) AS t
  FROM scores_raw s JOIN rules r ON s.score >= r.score_above
   AND (coalesce(r.rule_type, '') = '' OR coalesce(s.anomaly_type, '') = '' OR r.rule_type = s.anomaly_type)),
counted AS (
  SELECT m.*, CASE WHEN m.w > 0 THEN (
      SELECT count(*) FROM matches o WHERE o.dedup_key = m.dedup_key AND o.t > m.t - m.w * 1000000
        AND (o.t < m.t OR (o.t = m.t AND o.id <= m.id))) END AS repeat_count
  FROM matches m),
passing AS (SELECT * FROM counted WHERE w <= 0 OR repeat_count >= min_occ),
pw AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY t, id) AS rn FROM passing WHERE w > 0),
cool AS (
  SELECT dedup_key, rn, id, t, t AS last_fire, true AS fired FROM pw WHERE rn = 1
  UNION ALL
  SELECT pw.dedup_key, pw.rn, pw.id, pw.t,
         CASE WHEN pw.t >= cool.last_fire + 60000000 THEN pw.t ELSE cool.last_fire END,
         pw.t >= cool.last_fire + 60000000
  FROM cool JOIN pw ON pw.dedup_key = cool.dedup_key AND pw.rn = cool.rn + 1),
fired AS (
  SELECT * FROM passing WHERE w <= 0
  UNION ALL
  SELECT p.* FROM passing p JOIN cool c ON c.dedup_key = p.dedup_key AND c.id = p.id AND c.fired WHERE p.w > 0)"""


# ---------------------------------------------------------------- P: parsing

@register("p1_classify_log", with_views("logs") + "SELECT id, type FROM logs")
def p1_classify_log(spark, sf):
    return logs(spark, sf).select("id", "type")


@register("p2_log_level", with_views("logs") + "SELECT id, level FROM logs")
def p2_log_level(spark, sf):
    return logs(spark, sf).select("id", "level")


@register("p3_extract_log_fields", with_views("logs") + 'SELECT id, "user", source_ip FROM logs')
def p3_extract_log_fields(spark, sf):
    return logs(spark, sf).select("id", "user", "source_ip")


@register("p4_parse_access_status", with_views("logs") + r"""
SELECT id, CAST(nullif(regexp_extract(message, '" (\d{3}) ', 1), '') AS INTEGER) AS status, type
FROM logs WHERE source = 'access.log'""")
def p4_parse_access_status(spark, sf):
    d = logs(spark, sf).filter(F.col("source") == "access.log")
    return d.select("id", L.parse_access_status(F.col("message")).alias("status"), "type")


@register("p7_process_risk", with_views("processes", extra=PROC_SQL) + """
SELECT host, snap, pid, risk_flag, risk_reason FROM pev""")
def p7_process_risk(spark, sf):
    d = PR.process_risk(V.processes(spark, sf))
    return d.select("host", "snap", "pid", "risk_flag", "risk_reason")


@register("p8_suspicious_child", with_views("processes", extra=PROC_SQL) + """
SELECT host, snap, pid, parent_name, name FROM pev WHERE unusual_child""")
def p8_suspicious_child(spark, sf):
    d = V.processes(spark, sf)
    return d.filter(PR.suspicious_child(F.col("parent_name"), F.col("name"))) \
        .select("host", "snap", "pid", "parent_name", "name")


@register("p9_api_process_risk", with_views("processes") + """
SELECT host, snap, pid,
  CASE WHEN cpu_percent > 80 THEN printf('High CPU: %.1f%%', round(cpu_percent, 1))
       WHEN memory_mb > 500 THEN printf('High memory: %.0fMB', round(memory_mb, 0)) END AS risk_reason
FROM processes""")
def p9_api_process_risk(spark, sf):
    return PR.api_process_risk(V.processes(spark, sf)).select("host", "snap", "pid", "risk_reason")


@register("p10_flagged_or_new", with_views("processes", extra=PROC_SQL) + """
SELECT host, snap, pid, type, substr(cmdline, 1, 500) AS cmdline, round(memory_mb, 1) AS memory_mb, risk_reason
FROM pev WHERE is_new OR risk_flag""")
def p10_flagged_or_new(spark, sf):
    d = PR.process_events(V.processes(spark, sf))
    return d.select("host", "snap", "pid", "type", "cmdline", "memory_mb", "risk_reason")


@register("p11_mask_url_secrets", r"""
SELECT doc_id, length(masked) AS masked_chars, md5(masked) AS masked_md5
FROM (SELECT doc_id, regexp_replace(text, '(://[^:/@]*:)[^@]*@', '\1*****@', 'g') AS masked FROM documents)""")
def p11_mask_url_secrets(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", L.mask_url_secrets(F.col("text")).alias("masked")).select(
        "doc_id", F.length("masked").cast("long").alias("masked_chars"), F.md5("masked").alias("masked_md5"))


@register("p14_log_search", with_views("logs") + """
SELECT id, source, type FROM logs WHERE regexp_matches(message, '(?i)failed|oom')""")
def p14_log_search(spark, sf):
    return L.log_search(logs(spark, sf), "/failed|oom/").select("id", "source", "type")


# ---------------------------------------------------------------- D: snapshot diffs

@register("d1_new_connections", with_views("connections", extra=NEWCONN_SQL) + """
SELECT host, snap, remote_ip, remote_port, local_port, state FROM newconn""")
def d1_new_connections(spark, sf):
    return N.new_connections(V.connections(spark, sf)) \
        .select("host", "snap", "remote_ip", "remote_port", "local_port", "state")


@register("d2_closed_connections", with_views("connections", extra="""
ckeys AS (SELECT DISTINCT host, snap, remote_ip, remote_port, local_ip, local_port FROM connections),
csn AS (SELECT host, snap, lag(snap) OVER (PARTITION BY host ORDER BY snap) AS prev_snap
        FROM (SELECT DISTINCT host, snap FROM connections))""") + """
SELECT s.host, s.snap, CAST(count(*) AS BIGINT) AS closed
FROM csn s JOIN ckeys p ON p.host = s.host AND p.snap = s.prev_snap
WHERE NOT EXISTS (SELECT 1 FROM ckeys c WHERE c.host = s.host AND c.snap = s.snap
  AND c.remote_ip = p.remote_ip AND c.remote_port = p.remote_port AND c.local_ip = p.local_ip
  AND c.local_port = p.local_port)
GROUP BY s.host, s.snap""")
def d2_closed_connections(spark, sf):
    return N.closed_connections(V.connections(spark, sf)).select(
        "host", "snap", F.col("closed").cast("long").alias("closed"))


@register("d3_new_processes", with_views("processes", extra=PROC_SQL) + """
SELECT host, snap, pid, type FROM pev""")
def d3_new_processes(spark, sf):
    return PR.new_processes(V.processes(spark, sf)).select("host", "snap", "pid", "type")


@register("d4_process_summary", with_views("processes", extra=PROC_SQL) + """
SELECT host, snap, count(*) AS total, count(*) FILTER (WHERE is_new) AS new_spawns,
  count(*) FILTER (WHERE cpu_spike) AS cpu_spikes, count(*) FILTER (WHERE memory_spike) AS memory_spikes,
  count(*) FILTER (WHERE unusual_child) AS unusual_children
FROM pev GROUP BY host, snap""")
def d4_process_summary(spark, sf):
    return PR.process_summary(V.processes(spark, sf))


@register("d5_port_scan_candidates", with_views("connections", extra=NEWCONN_SQL) + """
SELECT host, window_start, remote_ip, ports FROM scans""")
def d5_port_scan_candidates(spark, sf):
    return scans(spark, sf).select("host", "window_start", "remote_ip", "ports")


# ---------------------------------------------------------------- F: features

_VEC_SQL = with_views("logs", "connections", "processes",
                      extra=NEWCONN_SQL + "," + PROC_SQL + "," + TEL_SQL)
_VEC_COLS = ", ".join(["host", "ts", "window_seconds"] + FEATS)


@register("f1_union_telemetry", _VEC_SQL.rstrip() + """,
ckeys AS (SELECT DISTINCT host, snap, remote_ip, remote_port, local_ip, local_port FROM connections),
closed AS (
  SELECT s.host, s.snap, count(*) AS n FROM csnaps s JOIN ckeys p ON p.host = s.host AND p.snap = s.prev_snap
  WHERE NOT EXISTS (SELECT 1 FROM ckeys c WHERE c.host = s.host AND c.snap = s.snap AND c.remote_ip = p.remote_ip
    AND c.remote_port = p.remote_port AND c.local_ip = p.local_ip AND c.local_port = p.local_port)
  GROUP BY s.host, s.snap),
whole AS (
  SELECT host, ts, stream, type, source_ip, 1 AS n FROM tel
  UNION ALL SELECT host, make_timestamp(snap * 21600 * 1000000), 'network', 'connections_closed', 'summary', n FROM closed
  UNION ALL SELECT host, make_timestamp(snap * 86400 * 1000000), 'processes', 'process_summary', '', count(*) FROM processes
            GROUP BY host, snap)
SELECT host, date_trunc('day', ts) AS day, stream, type, CAST(count(*) AS BIGINT) AS events,
  CAST(count(DISTINCT CASE WHEN stream = 'network' THEN source_ip END) AS BIGINT) AS sources, CAST(sum(n) AS BIGINT) AS n
FROM whole GROUP BY ALL""")
def f1_union_telemetry(spark, sf):
    """The whole fan-in, closed connections and process summaries with their counts
    included, by host, day and type."""
    none = F.lit(None).cast("string")
    closed = N.closed_connections(V.connections(spark, sf)).select(
        "host", F.timestamp_seconds(F.col("snap") * V.SNAP_SECONDS_CONN).cast("timestamp_ntz").alias("ts"),
        F.lit("connections_closed").alias("type"), F.lit("summary").alias("source_ip"), F.col("closed").alias("n"))
    summary = PR.process_summary(V.processes(spark, sf)).select(
        "host", F.timestamp_seconds(F.col("snap") * V.SNAP_SECONDS_PROC).cast("timestamp_ntz").alias("ts"),
        F.lit("process_summary").alias("type"), none.alias("risk_reason"), F.col("total").alias("n"))
    whole = FE.union_telemetry(logs(spark, sf), network_events(spark, sf).unionByName(closed, allowMissingColumns=True),
                               process_events(spark, sf).unionByName(summary, allowMissingColumns=True), extra=("n",))
    return whole.groupBy("host", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "stream", "type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(F.when(F.col("stream") == "network", F.col("source_ip"))).alias("sources"),
        F.sum(F.coalesce("n", F.lit(1))).alias("n"))


@register("f2_feature_vectors", _VEC_SQL + f"SELECT {_VEC_COLS} FROM vec")
def f2_feature_vectors(spark, sf):
    return vectors(spark, sf)


@register("f3_log_features", _VEC_SQL + """
SELECT host, ts, log_total_events, log_auth_failures, log_sudo_attempts, log_service_restarts
FROM vec WHERE log_total_events > 0""")
def f3_log_features(spark, sf):
    return vectors(spark, sf).filter("log_total_events > 0").select(
        "host", "ts", "log_total_events", "log_auth_failures", "log_sudo_attempts",
        "log_service_restarts")


@register("f4_network_features", _VEC_SQL + """
SELECT host, ts, net_new_connections, net_unique_ips, net_port_scan_candidates, net_bytes_rate
FROM vec WHERE net_new_connections + net_port_scan_candidates > 0""")
def f4_network_features(spark, sf):
    return vectors(spark, sf).filter("net_new_connections + net_port_scan_candidates > 0").select(
        "host", "ts", "net_new_connections", "net_unique_ips", "net_port_scan_candidates",
        "net_bytes_rate")


@register("f5_process_features", _VEC_SQL + """
SELECT host, ts, proc_new_spawns, proc_cpu_spikes, proc_memory_spikes, proc_unusual_children
FROM vec WHERE proc_new_spawns + proc_cpu_spikes + proc_memory_spikes + proc_unusual_children > 0""")
def f5_process_features(spark, sf):
    return vectors(spark, sf).filter(
        "proc_new_spawns + proc_cpu_spikes + proc_memory_spikes + proc_unusual_children > 0").select(
        "host", "ts", "proc_new_spawns", "proc_cpu_spikes", "proc_memory_spikes",
        "proc_unusual_children")


# ---------------------------------------------------------------- M: scoring

_SCORED_SQL = with_views("logs", "connections", "processes",
                         extra=NEWCONN_SQL + "," + PROC_SQL + "," + TEL_SQL + ",\n"
                         + BASELINE_SQL + "," + ZSCORE_SQL)


_VEC_FOREST_SQL = with_views("logs", "connections", "processes",
                             extra=NEWCONN_SQL + "," + PROC_SQL + "," + TEL_SQL + ",\n"
                             + BASELINE_SQL + "," + _X_SQL + "," + forest("vf", "xs"))
_FOREST_SCORED_SQL = _VEC_FOREST_SQL.rstrip() + "," + _ZSCORE_SQL.replace(
    "{scored_by}", "(SELECT zs.*, s.score AS isof FROM zs JOIN vf_scores s ON s.id = host || '|' || CAST(ts AS VARCHAR))")


def _scored(spark, sf):
    v = vectors(spark, sf)
    return SC.score_vectors(v, SC.fit_baseline(v))


def _scored_with_forest(spark, sf):
    """``_scored`` with a forest fitted on the vectors themselves."""
    from ..operators import iforest as IF
    v = vectors(spark, sf)
    base = SC.fit_baseline(v).checkpoint()  # both are read several times
    zx = _standardized(v, base).checkpoint()
    model = IF.fit_model(zx)
    return SC.score_vectors(v, base, model.isolation_score(zx).select("host", "ts", "isolation_forest_score"),
                            model.meta["model_version"])


@register("m1_fit_baseline", _SCORED_SQL + """
SELECT feature, round(mean, 4) AS mean, round(std, 4) AS std FROM baseline""")
def m1_fit_baseline(spark, sf):
    b = SC.fit_baseline(vectors(spark, sf))
    return b.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@register("m2_standardize", _SCORED_SQL + """
SELECT host, ts,
  round((log_auth_failures - (SELECT mean FROM baseline WHERE feature = 'log_auth_failures'))
        / CASE WHEN (SELECT std FROM baseline WHERE feature = 'log_auth_failures') = 0 THEN 1.0
               ELSE (SELECT std FROM baseline WHERE feature = 'log_auth_failures') END, 4) AS z_auth,
  round((net_port_scan_candidates - (SELECT mean FROM baseline WHERE feature = 'net_port_scan_candidates'))
        / CASE WHEN (SELECT std FROM baseline WHERE feature = 'net_port_scan_candidates') = 0 THEN 1.0
               ELSE (SELECT std FROM baseline WHERE feature = 'net_port_scan_candidates') END, 4) AS z_scan
FROM vec""")
def m2_standardize(spark, sf):
    v = vectors(spark, sf)
    z = SC.standardize(v, SC.fit_baseline(v))
    return z.select("host", "ts", F.round("z_log_auth_failures", 4).alias("z_auth"),
                    F.round("z_net_port_scan_candidates", 4).alias("z_scan"))


@register("m5_zscore_score", _SCORED_SQL + "SELECT host, ts, round(zscore_score, 4) AS zscore_score FROM zs")
def m5_zscore_score(spark, sf):
    v = vectors(spark, sf)
    z = SC.zscore_score(v, SC.fit_baseline(v))
    return z.select("host", "ts", F.round("zscore_score", 4).alias("zscore_score"))


@register("m6_ema_score", _SCORED_SQL + "SELECT host, ts, round(ema_score, 4) AS ema_score FROM scored")
def m6_ema_score(spark, sf):
    return _scored(spark, sf).select("host", "ts", "ema_score")


@register("m7_ensemble_score", _FOREST_SCORED_SQL + "SELECT host, ts, round(final_score, 4) AS score FROM scored")
def m7_ensemble_score(spark, sf):
    return _scored_with_forest(spark, sf).select("host", "ts", "score")


@register("m8_risk_level", _SCORED_SQL + "SELECT host, ts, " + RISK_SQL.format(x="final_score")
          + " AS risk_level FROM scored")
def m8_risk_level(spark, sf):
    return _scored(spark, sf).select("host", "ts", "risk_level")


@register("m9_score_record", _FOREST_SCORED_SQL + """
SELECT host, ts, round(final_score, 4) AS score, """ + RISK_SQL.format(x="final_score") + """ AS risk_level,
  round(isof, 4) AS isolation_forest_score, round(zscore_score, 4) AS zscore_score, round(ema_score, 4) AS ema_score,
  'iforest_v1' AS model_version
FROM scored""")
def m9_score_record(spark, sf):
    return _scored_with_forest(spark, sf).select("host", "ts", "score", "risk_level", "isolation_forest_score",
                                                 "zscore_score", "ema_score", "model_version")


@register("m11_latest_score", with_views("scores_raw") + """
SELECT host, id, ts, score FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) AS rn FROM scores_raw) WHERE rn = 1""")
def m11_latest_score(spark, sf):
    return SC.latest_score(V.scores_raw(spark, sf)).select("host", "id", "ts", "score")


@register("m12_anomaly_count_24h", with_views("scores_raw", extra="""
an AS (SELECT host, id, epoch_us(ts) AS t,
              row_number() OVER (PARTITION BY host ORDER BY epoch_us(ts), id) AS rn
       FROM scores_raw WHERE round(score, 4) > 0.6),
per AS (
  SELECT host, rn, t AS start FROM an WHERE rn = 1
  UNION ALL
  SELECT an.host, an.rn, CASE WHEN an.t >= per.start + 86400000000 THEN an.t ELSE per.start END
  FROM per JOIN an ON an.host = per.host AND an.rn = per.rn + 1)""", recursive=True) + """
SELECT host, make_timestamp(start) AS period_start, CAST(count(*) AS BIGINT) AS anomalies
FROM per GROUP BY host, start""")
def m12_anomaly_count_24h(spark, sf):
    return SC.anomaly_periods(V.scores_raw(spark, sf))


# ---------------------------------------------------------------- E: policy

@register("e1_classify_anomaly", _VEC_SQL + """
SELECT host, ts, CASE
  WHEN log_auth_failures > 5 OR log_sudo_attempts > 3 THEN
    CASE WHEN log_auth_failures > 10 THEN 'brute_force' ELSE 'ssh_failure' END
  WHEN net_port_scan_candidates > 0 OR net_new_connections > 50 THEN 'port_scan'
  WHEN proc_cpu_spikes > 0 OR proc_memory_spikes > 0 OR proc_new_spawns > 10 OR proc_unusual_children > 0
    THEN 'process_spike'
  ELSE 'unknown' END AS anomaly_type
FROM vec""")
def e1_classify_anomaly(spark, sf):
    return P.classify_anomaly(vectors(spark, sf)).select("host", "ts", "anomaly_type")


_POLICY_SQL = with_views("scores_raw", extra=RULES_SQL + "," + MATCH_SQL, recursive=True)


def _policy(spark, sf, stage):
    return P.evaluate_policies(spark, V.scores_raw(spark, sf), example_rules(), stage)


@register("e2_match_rules", _POLICY_SQL + "SELECT id, policy_name FROM matches")
def e2_match_rules(spark, sf):
    return _policy(spark, sf, "matches").select("id", "policy_name")


@register("e3_dedup_key", _POLICY_SQL + "SELECT id, policy_name, dedup_key FROM matches")
def e3_dedup_key(spark, sf):
    return _policy(spark, sf, "matches").select("id", "policy_name", "dedup_key")


@register("e4_repeat_count", _POLICY_SQL + """
SELECT id, policy_name, repeat_count, (w <= 0 OR repeat_count >= min_occ) AS passes FROM counted""")
def e4_repeat_count(spark, sf):
    c = _policy(spark, sf, "counted")
    return c.select("id", "policy_name", "repeat_count",
                    ((F.col("repeated_within_seconds") <= 0)
                     | (F.col("repeat_count") >= F.col("min_occurrences"))).alias("passes"))


@register("e5_cooldown", _POLICY_SQL + "SELECT id, policy_name FROM fired")
def e5_cooldown(spark, sf):
    return _policy(spark, sf, "fired").select("id", "policy_name")


_ALERT_SQL = _POLICY_SQL.rstrip() + """,
alerts AS (
  SELECT 'alert_' || sha256(policy_name || '|' || dedup_key || '|' || CAST(id AS VARCHAR)) AS alert_id,
    id AS score_id, ts, host, policy_name, severity, round(score, 4) AS score,
    CASE WHEN coalesce(anomaly_type, '') = '' THEN 'unknown' ELSE anomaly_type END AS anomaly_type,
    coalesce(source_ip, '') AS source_ip, action, notify,
    concat_ws(' ',
      '[' || upper(severity) || '] Policy ''' || policy_name || ''' triggered',
      '(score: ' || printf('%.2f', round(score, 2)) || ')',
      CASE WHEN coalesce(anomaly_type, '') <> '' THEN '— ' || CASE anomaly_type
        WHEN 'brute_force' THEN 'Brute force attack detected'
        WHEN 'port_scan' THEN 'Port scan activity detected'
        WHEN 'ssh_failure' THEN 'SSH authentication anomaly'
        WHEN 'process_spike' THEN 'Unusual process activity' ELSE anomaly_type END END,
      CASE WHEN coalesce(source_ip, '') <> '' THEN 'from ' || source_ip END,
      CASE WHEN action <> 'alert_only' THEN '→ Action: ' || action END) AS message,
    k
  FROM fired)
"""


@register("e6_make_alert", _ALERT_SQL + """
SELECT alert_id, score_id, ts, policy_name, severity, score, anomaly_type, source_ip, action, notify FROM alerts""")
def e6_make_alert(spark, sf):
    return _policy(spark, sf, "alerts").select(
        "alert_id", "score_id", "ts", "policy_name", "severity", "score", "anomaly_type",
        "source_ip", "action", "notify")


@register("e7_alert_message", _ALERT_SQL + "SELECT alert_id, message FROM alerts")
def e7_alert_message(spark, sf):
    return _policy(spark, sf, "alerts").select("alert_id", "message")


# scores_raw features: fixed per-k values (see views.scores_raw)
@register("e8_top_features", _ALERT_SQL.rstrip() + """,
top AS (SELECT alert_id, list_sort(list_filter([
    {'v': -CAST(k % 13 AS DOUBLE), 'k': 'log_total_events'},
    {'v': -CAST(k % 7 AS DOUBLE), 'k': 'log_auth_failures'},
    {'v': -CAST(k % 11 AS DOUBLE), 'k': 'net_new_connections'},
    {'v': -CAST(k % 3 AS DOUBLE), 'k': 'proc_new_spawns'},
    {'v': -3600.0, 'k': 'window_seconds'}], lambda e: e.v < 0))[1:5] AS t FROM alerts)
SELECT alert_id, array_to_string(list_transform(t, lambda e: e.k), ',') AS top_features,
  array_to_string(list_transform(t, lambda e: e.k || '=' || CAST(-e.v AS VARCHAR)), ',') AS contributing_features FROM top""")
def e8_top_features(spark, sf):
    values = F.transform(F.map_entries("contributing_features"),
                         lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _policy(spark, sf, "alerts").select("alert_id", "top_features",
                                               F.array_join(values, ",").alias("contributing_features"))


@register("e9_alert_counters", _ALERT_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total_alerts,
  CASE WHEN max(ts) > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 3600 SECOND
       THEN arg_max(alert_id, (ts, alert_id)) END AS latest_alert_id,
  CASE WHEN max(ts) > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 3600 SECOND THEN max(ts) END AS latest_alert_ts
FROM alerts""")
def e9_alert_counters(spark, sf):
    return P.alert_counters(_policy(spark, sf, "alerts"), "2024-01-30 23:00:00")


# ---------------------------------------------------------------- M3, M4, M10: forest

def _standardized(v: DataFrame, base: DataFrame) -> DataFrame:
    """(id, host, ts, x): the vectors as the forest reads them."""
    from ..operators import iforest as IF
    z = SC.standardize(v, base)
    return z.select(F.concat_ws("|", "host", F.col("ts").cast("string")).alias("id"), "host", "ts",
                    IF.feature_array([f"z_{f}" for f in S.FEATURE_NAMES]).alias("x"))


def _forest_input(spark, sf):
    v = vectors(spark, sf)
    return _standardized(v, SC.fit_baseline(v)).checkpoint()


@register("m3_fit_isolation_forest", _VEC_FOREST_SQL + """
SELECT tree::INTEGER AS tree, node::INTEGER AS node, feature::INTEGER AS feature, round(threshold, 6) AS threshold,
  "left"::INTEGER AS "left", "right"::INTEGER AS "right", depth::INTEGER AS depth, size::INTEGER AS size FROM vf_nodes""")
def m3_fit_isolation_forest(spark, sf):
    """Forest node table fitted on the standardized hourly vectors."""
    from ..operators import iforest as IF
    nodes, _ = IF.fit_isolation_forest(_forest_input(spark, sf))
    return nodes.withColumn("threshold", F.round("threshold", 6))


@register("m4_isolation_score", _VEC_FOREST_SQL.rstrip() + """,
ex AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS x FROM embeddings),""" + forest("ef", "ex") + """
SELECT 'vectors' AS input, id, round(score, 4) AS score FROM vf_scores
UNION ALL SELECT 'embeddings', id, round(score, 4) FROM ef_scores""")
def m4_isolation_score(spark, sf):
    """Forest score in [0, 1] for every hourly vector and every embedding."""
    from ..operators import iforest as IF
    zx = _forest_input(spark, sf)
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"),
                                                     F.col("embedding").cast("array<double>").alias("x"))
    parts = [IF.fit_model(rows).isolation_score(rows).select(
        F.lit(name).alias("input"), "id", F.round("isolation_forest_score", 4).alias("score"))
        for name, rows in (("vectors", zx), ("embeddings", emb))]
    return parts[0].unionByName(parts[1])


@register("m10_save_load_model", _VEC_FOREST_SQL + """
SELECT id, round(score, 4) AS isolation_forest_score FROM vf_scores""")
def m10_save_load_model(spark, sf):
    """Fit, save under the checkpoint folder, load through a search path, score."""
    import os
    import uuid
    from ..operators import iforest as IF
    from ..session import ensure_checkpoint_dir
    zx = _forest_input(spark, sf)
    model = IF.fit_model(zx)
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex[:8]}")
    model.save(path)
    loaded = IF.IsolationForestModel.load(spark, [path + "-missing", path])
    return loaded.isolation_score(zx).select("id", F.round("isolation_forest_score", 4)
                                             .alias("isolation_forest_score"))
