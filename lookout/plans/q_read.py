"""Registered queries: reads, host metrics, retention, sources and sinks (Q, H, T, S)."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import hostmetrics as H
from ..operators import reads as Q
from ..operators import response as R
from ..operators import retention as T
from ..operators import scoring as SC
from ..session import ensure_checkpoint_dir
from ..sources import envelope as EN
from ..sources import files as FI
from ..sources import sinks as SK
from ..sources import tcp_table as TCP
from . import views as V
from .q_detect import (_ALERT_SQL, _POLICY_SQL, MATCH_SQL, NEWCONN_SQL, PROC_SQL, RISK_SQL, RULES_SQL, TEL_SQL, logs,
                       network_events, process_events, vectors)
from .q_respond import _OUT_SQL, _R_SQL, DISP_SQL, actions, alerts, outcomes
from .registry import register
from .sqlviews import with_views

AS_OF = "2024-01-30 23:59:00"


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


# ---------------------------------------------------------------- Q

@register("q1_query_logs", with_views("logs") + """
SELECT id, ts, source, level, message, CASE WHEN type <> 'unknown' THEN type END AS parsed_type
FROM logs WHERE level = 'warning' AND contains(source, 'auth') AND id < 9000
ORDER BY id DESC LIMIT 100""")
def q1_query_logs(spark, sf):
    return Q.query_logs(logs(spark, sf), level="warning", source="auth", after=9000, limit=100) \
        .select("id", "ts", "source", "level", "message", "parsed_type")


@register("q2_query_alerts", _ALERT_SQL + """
SELECT alert_id, score_id, ts, severity, (SELECT count(*) FROM alerts) AS total FROM alerts
WHERE severity = 'high' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY score_id DESC, alert_id DESC LIMIT 50""")
def q2_query_alerts(spark, sf):
    return Q.query_alerts(alerts(spark, sf), severity="high", since="2024-01-10 00:00:00") \
        .select("alert_id", "score_id", "ts", "severity", "total")


@register("q3_query_actions", _R_SQL + """
SELECT action_id, ts, status FROM acts WHERE triggered_by = 'manual' AND ts >= TIMESTAMP '2024-01-05 00:00:00'
ORDER BY ts DESC, action_id DESC LIMIT 50""")
def q3_query_actions(spark, sf):
    return Q.query_actions(actions(spark, sf), triggered_by="manual", since="2024-01-05 00:00:00") \
        .select("action_id", "ts", "status")


@register("q2_all_alert_pages", _ALERT_SQL.rstrip() + """,
paged AS (SELECT *, (row_number() OVER (ORDER BY score_id DESC, alert_id DESC) - 1) // 500 AS page FROM alerts)
SELECT alert_id, score_id, severity, page, CASE WHEN count(*) OVER (PARTITION BY page) = 500 THEN
  last_value('{"score_id":' || score_id || ',"alert_id":"' || alert_id || '"}') OVER (
    PARTITION BY page ORDER BY score_id DESC, alert_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor
FROM paged""")
def q2_all_alert_pages(spark, sf):
    """Every alert with its page at the largest page size and that page's cursor."""
    return Q.all_pages(alerts(spark, sf), 500, Q.ALERT_CURSOR).select(
        "alert_id", "score_id", "severity", "page", "next_cursor")


@register("q3_all_action_pages", _R_SQL.rstrip() + """,
paged AS (SELECT *, (row_number() OVER (ORDER BY ts DESC, action_id DESC) - 1) // 500 AS page FROM acts)
SELECT action_id, status, page, CASE WHEN count(*) OVER (PARTITION BY page) = 500 THEN
  last_value(action_id) OVER (PARTITION BY page ORDER BY ts DESC, action_id DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_action_id
FROM paged""")
def q3_all_action_pages(spark, sf):
    """Every action with its page at the largest page size and the action that its
    cursor ends at."""
    return Q.all_pages(actions(spark, sf), 500, Q.ACTION_CURSOR).select(
        "action_id", "status", "page", F.get_json_object("next_cursor", "$.action_id").alias("next_action_id"))


@register("q4_query_scores", with_views("scores_raw") + """
SELECT id, ts, score FROM scores_raw WHERE id < 5000 ORDER BY id DESC LIMIT 50""")
def q4_query_scores(spark, sf):
    return Q.query_scores(V.scores_raw(spark, sf), after=5000, limit=50).select("id", "ts", "score")


@register("q5_log_sources", with_views("logs") + """
SELECT DISTINCT source FROM (SELECT source FROM logs ORDER BY id DESC LIMIT 2000)
WHERE coalesce(source, '') <> '' ORDER BY source""")
def q5_log_sources(spark, sf):
    return Q.log_sources(logs(spark, sf))


_PROC_SQL_Q = with_views("processes") + """
, flagged AS (SELECT * FROM processes WHERE cpu_percent > 80 OR memory_mb > 500)"""


@register("q6_top_processes", _PROC_SQL_Q + """
SELECT host, snap, pid, cpu_percent, (SELECT count(*) FROM flagged) AS total
FROM flagged ORDER BY cpu_percent DESC, host, snap, pid LIMIT 50""")
def q6_top_processes(spark, sf):
    p = V.processes(spark, sf)
    from ..operators.processes import api_process_risk
    d = Q.top_processes(api_process_risk(p), "cpu_percent", 50, flagged_only=True)
    return d.select("host", "snap", "pid", "cpu_percent", "total")


_HINTS = " ".join(f"WHEN {p} THEN '{h}'" for p, h in S.PORT_HINTS.items())


@register("q7_port_summary", with_views("connections") + f"""
SELECT host, snap, local_port AS port, count(*) AS connections,
  count(DISTINCT CASE WHEN remote_ip NOT IN ('0.0.0.0', '00000000') THEN remote_ip END) AS unique_ips,
  CASE WHEN count(DISTINCT CASE WHEN remote_ip NOT IN ('0.0.0.0', '00000000') THEN remote_ip END) > 10
       THEN 'elevated' ELSE 'normal' END AS state,
  count(DISTINCT CASE WHEN remote_ip NOT IN ('0.0.0.0', '00000000') THEN remote_ip END) > 10 AS risk_flag,
  CASE local_port {_HINTS} ELSE '' END AS service_hint
FROM connections WHERE state IN ('LISTEN', 'ESTABLISHED') GROUP BY host, snap, local_port""")
def q7_port_summary(spark, sf):
    return Q.port_summary(V.connections(spark, sf))


@register("q8_recent_alerts", _ALERT_SQL + """
SELECT alert_id, ts, policy_name FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 100""")
def q8_recent_alerts(spark, sf):
    return Q.recent_alerts(alerts(spark, sf)).select("alert_id", "ts", "policy_name")


@register("q9_action_lifecycle", _R_SQL + """
SELECT a.action_id, a.ts, a.status, r.reversal_at,
  coalesce(r.reversal_at <= TIMESTAMP '2024-01-30 12:00:00', false) AS reversed FROM acts a LEFT JOIN revs r ON r.action_id = a.action_id
ORDER BY a.ts DESC, a.action_id DESC LIMIT 100""")
def q9_action_lifecycle(spark, sf):
    a = actions(spark, sf)
    return Q.action_lifecycle(a, R.schedule_reversals(a), "2024-01-30 12:00:00").select(
        "action_id", "ts", "status", "reversal_at", "reversed")


@register("q10_filter_alerts", _ALERT_SQL + f"""
SELECT alert_id FROM alerts WHERE severity = 'high'
  AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 604800 SECOND
  AND contains(lower(concat_ws(' ', anomaly_type, message, source_ip, policy_name)), 'brute')""")
def q10_filter_alerts(spark, sf):
    return Q.filter_alerts(alerts(spark, sf), "high", 604800, "Brute", AS_OF).select("alert_id")


@register("q11_alert_severity_buckets", _ALERT_SQL + """
SELECT count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity IN ('high', 'warning')) AS high,
  count(*) FILTER (WHERE severity NOT IN ('critical', 'high', 'warning') OR severity IS NULL) AS medium,
  count(*) AS total,
  count(*) FILTER (WHERE severity = 'critical') + count(*) FILTER (WHERE severity IN ('high', 'warning')) AS badge
FROM alerts""")
def q11_alert_severity_buckets(spark, sf):
    return Q.alert_severity_buckets(alerts(spark, sf))


def _feed_parts(spark, sf):
    from .q_detect import process_events
    sc = V.scores_raw(spark, sf).select("id", "ts", "score", "risk_level")
    lg = logs(spark, sf).select("id", "ts", "type", "message")
    al = alerts(spark, sf).select(F.col("alert_id").alias("id"), "ts", "policy_name")
    pr = process_events(spark, sf).filter("risk_flag").select(
        F.concat_ws(":", "host", F.col("snap").cast("string"), F.col("pid").cast("string")).alias("id"),
        "ts", "risk_reason")
    return {"scores": sc, "logs": lg, "alerts": al, "processes": pr}


@register("q12_live_feed", _ALERT_SQL.rstrip() + """,
""" + with_views("logs", "processes")[len("WITH "):].replace("base AS (", "base2 AS (", 1)
          .replace("FROM base)", "FROM base2)").rstrip() + """,
pr AS (SELECT p.*, (p.cpu_percent > 80 OR p.memory_mb > 500 OR EXISTS (
          SELECT 1 FROM (VALUES """ + ", ".join(f"('{p}', '{c}')" for p, kids in S.SUSPICIOUS_CHILDREN.items() for c in kids) + """) cp(parent, child)
          WHERE cp.parent = p.parent_name AND cp.child = p.name)) AS risk_flag FROM processes p)
SELECT 'scores' AS type, CAST(id AS VARCHAR) AS id, ts, CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR) AS what, """ + RISK_SQL.format(x="score") + """ AS detail FROM scores_raw
UNION ALL SELECT 'logs', CAST(id AS VARCHAR), ts, type, message FROM logs
UNION ALL SELECT 'alerts', alert_id, ts, policy_name, NULL FROM alerts
UNION ALL SELECT 'processes', host || ':' || CAST(snap AS VARCHAR) || ':' || CAST(pid AS VARCHAR),
  make_timestamp(snap * 86400 * 1000000),
  CASE WHEN EXISTS (SELECT 1 FROM (VALUES """ + ", ".join(f"('{p}', '{c}')" for p, kids in S.SUSPICIOUS_CHILDREN.items() for c in kids) + """) cp(parent, child)
                    WHERE cp.parent = parent_name AND cp.child = name) THEN 'Unusual child: ' || parent_name || ' → ' || name
       WHEN memory_mb > 500 THEN printf('High memory: %.0fMB', round(memory_mb, 0))
       ELSE printf('High CPU: %.1f%%', round(cpu_percent, 1)) END, NULL FROM pr WHERE risk_flag""")
def q12_live_feed(spark, sf):
    """The feed, with what its JSON says read back from it."""
    def said(*fields):
        return F.coalesce(*[F.get_json_object("data", f"$.{f}") for f in fields])

    return Q.live_feed(_feed_parts(spark, sf)).select(
        F.col("type"), "id", "ts",
        F.coalesce(F.round(said("score").cast("double") * 10000).cast("long").cast("string"),
                   said("type", "policy_name", "risk_reason")).alias("what"),
        said("risk_level", "message").alias("detail"))


@register("q13_replay", _ALERT_SQL.rstrip() + """,
""" + with_views("logs")[len("WITH "):].replace("base AS (", "base2 AS (", 1)
          .replace("FROM base)", "FROM base2)").rstrip() + """
SELECT * FROM (
  (SELECT 'score' AS type, CAST(id AS VARCHAR) AS id, ts FROM scores_raw ORDER BY ts DESC, id DESC LIMIT 1)
  UNION ALL (SELECT 'alert', alert_id, ts FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 10)
  UNION ALL (SELECT 'log', CAST(id AS VARCHAR), ts FROM logs ORDER BY ts DESC, id DESC LIMIT 20))""")
def q13_replay(spark, sf):
    return Q.replay(V.scores_raw(spark, sf), alerts(spark, sf), logs(spark, sf))


@register("q14_anomaly_notifications", with_views("scores_raw", extra="""
an AS (SELECT host, id, epoch_us(ts) AS t,
              row_number() OVER (PARTITION BY host ORDER BY epoch_us(ts), id) AS rn
       FROM scores_raw WHERE score > 0.6),
nt AS (
  SELECT host, rn, id, t AS last, true AS sent FROM an WHERE rn = 1
  UNION ALL
  SELECT an.host, an.rn, an.id, CASE WHEN an.t >= nt.last + 30000000 THEN an.t ELSE nt.last END,
         an.t >= nt.last + 30000000
  FROM nt JOIN an ON an.host = nt.host AND an.rn = nt.rn + 1)""", recursive=True) + """
SELECT id FROM nt WHERE sent""")
def q14_anomaly_notifications(spark, sf):
    return Q.anomaly_notifications(V.scores_raw(spark, sf)).select("id")


@register("q15_series_tail", with_views("scores_raw") + """
SELECT host, id, ts, score FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) AS r FROM scores_raw) WHERE r <= 60""")
def q15_series_tail(spark, sf):
    return Q.series_tail(V.scores_raw(spark, sf), ["host"], 60).select("host", "id", "ts", "score")


@register("q16_event_rate", with_views("raw_logs") + """
SELECT date_trunc('second', ts) AS second, CAST(count(*) AS BIGINT) AS rate FROM raw_logs
GROUP BY date_trunc('second', ts)""")
def q16_event_rate(spark, sf):
    return Q.event_rate(V.raw_logs(spark, sf))


_BEAT_SCALE = 180  # the driver's events are minutes apart, heartbeats seconds


@register("q17_service_liveness", with_views("heartbeats") + f"""
, expected(service, ttl) AS (VALUES ('collectors', 20), ('ml', 20), ('policy_engine', 60), ('action_engine', 60),
                                    ('webhook_service', 60), ('api', 60)),
live AS (
  SELECT e.service, CAST(ttl * {_BEAT_SCALE} AS INTEGER) AS ttl_seconds, max(h.ts) AS last_seen,
    coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(max(h.ts)) < ttl * {_BEAT_SCALE}, false) AS active
  FROM expected e LEFT JOIN heartbeats h ON h.service = e.service GROUP BY e.service, ttl)
SELECT *, count(*) FILTER (active) OVER () AS services_up, count(*) OVER () AS services_total,
  CASE WHEN bool_and(active) OVER () THEN 'healthy' ELSE 'degraded' END AS status FROM live""")
def q17_service_liveness(spark, sf):
    """Each service by its own TTL, beside the overview (one row)."""
    live = Q.service_liveness(V.heartbeats(spark, sf), AS_OF, {s: t * _BEAT_SCALE for s, t in S.SERVICE_TTLS.items()})
    return live.join(F.broadcast(Q.liveness_overview(live).withColumn("__one", F.lit(1))),
                     F.col("__one") == 1).drop("__one")


_COUNTER_SQL = """
, cnt AS (
  SELECT host, ts, event_id AS seq,
    sum(CAST(floor(value * 1000) AS BIGINT)) OVER w AS rx_bytes,
    sum(CAST(floor(value * 300) AS BIGINT)) OVER w AS tx_bytes,
    sum(k) OVER w AS "user", sum(k % 7) OVER w AS system, sum(100 - k) OVER w AS idle, sum(k % 3) OVER w AS iowait
  FROM base WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cpu AS (
  SELECT host, ts, seq,
    ("user" + system + idle + iowait) - lag("user" + system + idle + iowait) OVER (PARTITION BY host ORDER BY ts, seq) AS dt,
    (idle + iowait) - lag(idle + iowait) OVER (PARTITION BY host ORDER BY ts, seq) AS di
  FROM cnt),
cpu_pct AS (SELECT host, ts, seq, round(CASE WHEN dt IS NULL OR dt <= 0 THEN 0.0 ELSE (dt - di) / dt * 100.0 END, 1) AS cpu_percent FROM cpu)"""


@register("q18_metrics_snapshot", _ALERT_SQL.rstrip() + _COUNTER_SQL + """,
an AS (SELECT host, id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY host ORDER BY epoch_us(ts), id) AS rn
       FROM scores_raw WHERE round(score, 4) > 0.6),
per AS (SELECT host, rn, t AS start FROM an WHERE rn = 1
        UNION ALL SELECT an.host, an.rn, CASE WHEN an.t >= per.start + 86400000000 THEN an.t ELSE per.start END
        FROM per JOIN an ON an.host = per.host AND an.rn = per.rn + 1),
cur_period AS (SELECT host, arg_max(n, start) AS anomalies FROM (SELECT host, start, count(*) AS n FROM per GROUP BY host, start) GROUP BY host)
SELECT c.host, c.cpu_percent, s.score AS latest_score, coalesce(p.anomalies, 0) AS anomalies_24h,
  (SELECT count(*) FROM alerts) AS alerts_total
FROM (SELECT host, arg_max(cpu_percent, (ts, seq)) AS cpu_percent FROM cpu_pct GROUP BY host) c
LEFT JOIN (SELECT host, arg_max(score, (ts, id)) AS score FROM scores_raw GROUP BY host) s ON s.host = c.host
LEFT JOIN cur_period p ON p.host = c.host""")
def q18_metrics_snapshot(spark, sf):
    cpu = H.cpu_percent(V.counters(spark, sf, parts=True))
    newest = cpu.groupBy("host").agg(F.max_by("cpu_percent", F.struct("ts", "seq")).alias("cpu_percent"))
    sc = V.scores_raw(spark, sf)
    latest = SC.latest_score(sc).select("host", F.col("score").alias("latest_score"))
    per = SC.anomaly_periods(sc)
    cur = per.groupBy("host").agg(F.max_by("anomalies", "period_start").alias("anomalies_24h"))
    total = alerts(spark, sf).agg(F.count(F.lit(1)).alias("alerts_total")).withColumn("__one", F.lit(1))
    j = newest.join(latest, "host", "left").join(cur, "host", "left") \
        .withColumn("anomalies_24h", F.coalesce("anomalies_24h", F.lit(0)).cast("long")) \
        .withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")
    return j.select("host", "cpu_percent", "latest_score", "anomalies_24h", "alerts_total")


# ---------------------------------------------------------------- H

@register("h1_cpu_percent", with_views("base") + _COUNTER_SQL + """
SELECT host, seq, cpu_percent FROM cpu_pct""")
def h1_cpu_percent(spark, sf):
    return H.cpu_percent(V.counters(spark, sf, parts=True)).select("host", "seq", "cpu_percent")


_PER_SQL = """
, cnt AS (
  SELECT host, event_type AS dev, ts, event_id AS seq,
    sum(CAST(floor(value * 1000) AS BIGINT)) OVER w AS rx_bytes,
    sum(CAST(floor(value * 300) AS BIGINT)) OVER w AS tx_bytes,
    sum(k) OVER w AS "user", sum(k % 7) OVER w AS system, sum(100 - k) OVER w AS idle, sum(k % 3) OVER w AS iowait,
    sum(k % 5) OVER w AS reads_completed, sum(CAST(floor(value * 10) AS BIGINT)) OVER w AS sectors_read,
    sum(k % 3) OVER w AS writes_completed, sum(CAST(floor(value * 3) AS BIGINT)) OVER w AS sectors_written,
    sum(k * 10) OVER w AS io_time_ms
  FROM base WINDOW w AS (PARTITION BY host, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
prev AS (SELECT *, lag(cnt) OVER (PARTITION BY host, dev ORDER BY ts, seq) AS p FROM cnt)"""


@register("h2_cpu_percent_per_core", with_views("base") + _PER_SQL + """
SELECT host, dev AS core, seq, round(CASE WHEN p IS NULL OR ("user" + system + idle + iowait) - (p."user" + p.system + p.idle + p.iowait) <= 0 THEN 0.0
  ELSE ((("user" + system + idle + iowait) - (p."user" + p.system + p.idle + p.iowait)) - ((idle + iowait) - (p.idle + p.iowait)))
       / (("user" + system + idle + iowait) - (p."user" + p.system + p.idle + p.iowait)) * 100.0 END, 1) AS cpu_percent
FROM prev""")
def h2_cpu_percent_per_core(spark, sf):
    c = V.counters(spark, sf, per="core", parts=True)
    return H.cpu_percent(c, keys=("host", "core")).select("host", "core", "seq", "cpu_percent")


_MEM_SQL = """
, mem AS (
  SELECT host, ts, 16384000 AS mem_total, 16384000 - CAST(floor(value * 20000) AS BIGINT) AS mem_avail,
         2097152 AS swap_total, 2097152 - k * 1000 AS swap_free, k FROM base)"""


# fixed: field -> /proc/meminfo key, beside total, available and swap
_MEM_FIELDS = {"cached_mb": "Cached", "buffers_mb": "Buffers", "active_mb": "Active", "inactive_mb": "Inactive",
               "dirty_mb": "Dirty", "writeback_mb": "Writeback", "slab_mb": "Slab", "page_tables_mb": "PageTables",
               "committed_mb": "Committed_AS", "commit_limit_mb": "CommitLimit", "mapped_mb": "Mapped"}


def _mem_rows(spark, sf):
    """(host, ts, key, kb) as the kernel lists them; no Shmem, every 9th sample without swap."""
    b = V.base(spark, sf)
    more = ", ".join(f"'{key}', cast({i + 1} * 1500 * k + {i} as bigint)" for i, key in enumerate(_MEM_FIELDS.values()))
    return b.select("host", "ts", F.expr(
        f"stack({4 + len(_MEM_FIELDS)}, 'MemTotal', 16384000L, 'MemAvailable', 16384000L - cast(floor(value * 20000) as bigint), "
        f"'SwapTotal', if(k % 9 = 0, 0L, 2097152L), 'SwapFree', if(k % 9 = 0, 0L, 2097152L - k * 1000L), {more}) as (key, kb)"))


@register("h3_memory_usage", with_views("base") + _MEM_SQL + """
, kb AS (SELECT * REPLACE (CASE WHEN k % 9 = 0 THEN 0 ELSE swap_total END AS swap_total,
                           CASE WHEN k % 9 = 0 THEN 0 ELSE swap_free END AS swap_free) FROM mem)
SELECT host, ts, round(mem_total / 1024, 1) AS total_mb, round((mem_total - mem_avail) / 1024, 1) AS used_mb,
  round(mem_avail / 1024, 1) AS available_mb,
  """ + ", ".join(f"round(({i + 1} * 1500 * k + {i}) / 1024, 1) AS {field}" for i, field in enumerate(_MEM_FIELDS)) + """,
  0.0::DOUBLE AS shared_mb,
  round((mem_total - mem_avail) / mem_total * 100, 1) AS percent,
  round(swap_total / 1024, 1) AS swap_total_mb, round(swap_free / 1024, 1) AS swap_free_mb,
  round(round(swap_total / 1024, 1) - round(swap_free / 1024, 1), 1) AS swap_used_mb,
  CASE WHEN swap_total > 0 THEN round((swap_total - swap_free) / swap_total * 100, 1) ELSE 0.0 END AS swap_percent
FROM kb""")
def h3_memory_usage(spark, sf):
    return H.memory_usage(_mem_rows(spark, sf))


@register("h4_net_rates", with_views("base") + _COUNTER_SQL + """
, lagged AS (SELECT host, ts, rx_bytes, tx_bytes,
    lag(rx_bytes) OVER w AS prx, lag(tx_bytes) OVER w AS ptx, lag(ts) OVER w AS pts
  FROM (SELECT host, ts, sum(rx_bytes) AS rx_bytes, sum(tx_bytes) AS tx_bytes FROM cnt GROUP BY host, ts)
  WINDOW w AS (PARTITION BY host ORDER BY ts))
SELECT host, ts,
  round(CASE WHEN prx IS NULL OR epoch_us(ts) - epoch_us(pts) <= 0 THEN 0.0
        ELSE greatest((rx_bytes - prx) / ((epoch_us(ts) - epoch_us(pts)) / 1e6), 0.0) END, 4) AS rx_bytes_rate,
  round(CASE WHEN ptx IS NULL OR epoch_us(ts) - epoch_us(pts) <= 0 THEN 0.0
        ELSE greatest((tx_bytes - ptx) / ((epoch_us(ts) - epoch_us(pts)) / 1e6), 0.0) END, 4) AS tx_bytes_rate
FROM lagged""")
def h4_net_rates(spark, sf):
    c = V.counters(spark, sf).withColumn("interface", F.lit("eth0"))
    return H.net_rates(c).select("host", "ts", "rx_bytes_rate", "tx_bytes_rate")


_IFACE = {"click": "eth0", "view": "wlan0", "purchase": "wg0", "signup": "veth12", "error": "lo"}


@register("h5_interface_rates", with_views("base") + _PER_SQL + """
SELECT host, CASE dev """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _IFACE.items()) + """ END AS interface, seq,
  round(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p.ts) <= 0 THEN 0.0
        ELSE greatest((rx_bytes - p.rx_bytes) / ((epoch_us(ts) - epoch_us(p.ts)) / 1e6), 0.0) END, 4) AS rx_bytes_rate
FROM prev WHERE dev IN ('click', 'view', 'purchase')""")
def h5_interface_rates(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in _IFACE.items() for x in kv])
    c = V.counters(spark, sf, per="dev").withColumn("interface", m[F.col("dev")])
    return H.interface_rates(c).select("host", "interface", "seq", "rx_bytes_rate")


_DISK = {"click": "sda", "view": "sda1", "purchase": "nvme0n1", "signup": "vdb", "error": "nvme0n1p2"}


@register("h6_disk_io_rates", with_views("base") + _PER_SQL + """
, r AS (SELECT host, CASE dev """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DISK.items()) + """ END AS device, seq,
  CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p.ts) <= 0 THEN NULL ELSE (epoch_us(ts) - epoch_us(p.ts)) / 1e6 END AS dts,
  sectors_read - p.sectors_read AS dsr, reads_completed - p.reads_completed AS drc, io_time_ms - p.io_time_ms AS dio
  FROM prev WHERE dev IN ('click', 'purchase', 'signup'))
SELECT host, device, seq,
  round(round(CASE WHEN dts IS NULL THEN 0.0 ELSE greatest(dsr / dts, 0.0) END, 4) * 512 / 1048576, 4) AS read_mb_s,
  round(CASE WHEN dts IS NULL THEN 0.0 ELSE greatest(drc / dts, 0.0) END, 4) AS read_ops_s,
  least(100.0, round(round(CASE WHEN dts IS NULL THEN 0.0 ELSE greatest(dio / dts, 0.0) END, 4) / 10, 1)) AS busy_percent
FROM r""")
def h6_disk_io_rates(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in _DISK.items() for x in kv])
    c = V.counters(spark, sf, per="dev").withColumn("device", m[F.col("dev")])
    return H.disk_io_rates(c).select("host", "device", "seq", "read_mb_s", "read_ops_s", "busy_percent")


_DEVS = ["sda1", "sdb1", "loop0", "nvme0n1p1"]
_FS = ["ext4", "xfs", "tmpfs", "squashfs", "ext4"]


def _mounts(spark, sf):
    b = V.base(spark, sf)
    dev = F.concat(F.lit("/dev/"), F.element_at(F.array(*[F.lit(x) for x in _DEVS]), (F.col("k") % 4 + 1).cast("int")))
    fs = F.element_at(F.array(*[F.lit(x) for x in _FS]), (F.col("k") % 5 + 1).cast("int"))
    mnt = F.when(F.col("k") % 7 == 0, F.lit("/")).otherwise(F.concat(F.lit("/data/"), (F.col("k") % 7).cast("string")))
    return b.select("host", dev.alias("device"), mnt.alias("mount"), fs.alias("fstype")).distinct()


@register("h7_primary_mounts", with_views("base") + """
, mounts AS (SELECT DISTINCT host, '/dev/' || ['sda1', 'sdb1', 'loop0', 'nvme0n1p1'][k % 4 + 1] AS device,
    CASE WHEN k % 7 = 0 THEN '/' ELSE '/data/' || CAST(k % 7 AS VARCHAR) END AS mount,
    ['ext4', 'xfs', 'tmpfs', 'squashfs', 'ext4'][k % 5 + 1] AS fstype FROM base)
SELECT host, device, mount, fstype FROM (
  SELECT *, row_number() OVER (PARTITION BY host, device ORDER BY length(mount), mount, fstype) AS r FROM mounts
  WHERE device LIKE '/dev/%' AND fstype NOT IN ('squashfs', 'tmpfs', 'devtmpfs', 'devpts') AND NOT contains(device, 'loop'))
WHERE r = 1""")
def h7_primary_mounts(spark, sf):
    return H.primary_mounts(_mounts(spark, sf)).select("host", "device", "mount", "fstype")


@register("h8_active_connections", with_views("connections") + """
SELECT host, snap, count(*) AS established FROM connections WHERE state = 'ESTABLISHED' GROUP BY host, snap""")
def h8_active_connections(spark, sf):
    return H.active_connections(V.connections(spark, sf))


_ROUTES = {"click": ("10.0.0.0", 24, "eth0", 1), "view": ("203.0.113.0", 25, "wlan0", 2),
           "purchase": ("203.0.113.0", 24, "wg0", 3), "signup": ("0.0.0.0", 0, "eth1", 4),
           "error": ("127.0.0.0", 8, "lo", 5)}


# IPv6 routes beside them, one not on a digit's edge
_ROUTES6 = {"click": ("2001:db8::", 32, "wg1", 7), "view": ("2001:db8:0:4::", 62, "eth2", 6), "error": ("::1", 128, "lo", 8)}


def _routes(spark, sf):
    b = V.base(spark, sf).select("host", "event_type").distinct()
    rows = [(k, *v) for routes in (_ROUTES, _ROUTES6) for k, v in routes.items()]
    spec = spark.createDataFrame(rows, "event_type string, network string, mask_bits int, interface string, route_order int")
    return b.join(F.broadcast(spec), "event_type").drop("event_type")


@register("h9_ip_to_interface", with_views("base") + """
, routes(event_type, network, mask_bits, interface, route_order) AS (VALUES """ + ", ".join(
    f"('{k}', '{v[0]}', {v[1]}, '{v[2]}', {v[3]})" for k, v in _ROUTES.items()) + """),
hr AS (SELECT DISTINCT b.host, r.* FROM (SELECT DISTINCT host, event_type FROM base) b JOIN routes r USING (event_type)
       WHERE r.mask_bits > 0 AND NOT starts_with(r.network, '127.')),
ips AS (SELECT DISTINCT host, ip FROM base),
num AS (SELECT *, CAST(string_split(ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip, '.')[2] AS BIGINT) * 65536
                + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) AS n FROM ips),
rnum AS (SELECT *, CAST(string_split(network, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(network, '.')[2] AS BIGINT) * 65536
                + CAST(string_split(network, '.')[3] AS BIGINT) * 256 + CAST(string_split(network, '.')[4] AS BIGINT) AS net FROM hr)
SELECT DISTINCT host, '2001:DB8::' || to_hex(k % 16) || ':0:0:0:' || to_hex(user_id % 200 + 1) AS ip,
  CASE WHEN k % 16 BETWEEN 4 AND 7 AND v THEN 'eth2' ELSE 'wg1' END AS interface
FROM (SELECT *, bool_or(event_type = 'click') OVER (PARTITION BY host) AS c, bool_or(event_type = 'view') OVER (PARTITION BY host) AS v
      FROM base) WHERE c OR (v AND k % 16 BETWEEN 4 AND 7)
UNION ALL
SELECT n.host, n.ip, arg_min(r.interface, r.route_order) AS interface
FROM num n JOIN rnum r ON r.host = n.host AND n.n >= r.net AND n.n < r.net + (1::BIGINT << (32 - r.mask_bits))
GROUP BY n.host, n.ip""")
def h9_ip_to_interface(spark, sf):
    b = V.base(spark, sf)
    six = F.concat(F.lit("2001:DB8::"), F.hex(F.col("k") % 16), F.lit(":0:0:0:"), F.hex(F.col("user_id") % 200 + 1))
    ips = b.select("host", F.explode(F.array("ip", six)).alias("ip")).distinct()
    return H.ip_to_interface(ips, _routes(spark, sf))


def _container_stats(spark, sf):
    b = V.base(spark, sf)
    k, v = F.col("k"), F.col("value")
    return b.select(
        "host", F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("container"), "ts",
        (F.col("event_type") != "error").alias("running"),
        F.floor(v * 1e6).cast("long").alias("cpu_total"),
        (F.floor(v * 1e6) - k * 1000).cast("long").alias("precpu_total"),
        (F.col("es") * 1000).cast("long").alias("system_total"),
        (F.col("es") * 1000 - 100000).cast("long").alias("presystem_total"),
        F.lit(4).alias("online_cpus"),
        F.floor(v * 1e6).cast("long").alias("mem_usage"), (k * 1000).cast("long").alias("mem_cache"),
        F.lit(1_000_000_000).cast("long").alias("mem_limit"),
        F.array(k.cast("long"), (k * 2).cast("long")).alias("rx_bytes"),
        F.array((k * 3).cast("long")).alias("tx_bytes"),
        F.array(k.cast("long")).alias("blk_read"), F.array((k % 7).cast("long")).alias("blk_write"))


_CONT_SQL = """
, cs AS (SELECT host, 'c' || CAST(user_id % 10 AS VARCHAR) AS container, ts, event_type <> 'error' AS running,
    round(CAST(k * 1000 AS DOUBLE) / 100000 * 4 * 100.0, 2) AS cpu_percent,
    round((CAST(floor(value * 1e6) AS BIGINT) - k * 1000) / 1048576, 1) AS mem_mb,
    round(CAST(CAST((CAST(floor(value * 1e6) AS BIGINT) - k * 1000) * 100.0 / 1e9 AS VARCHAR) AS DECIMAL(38, 12)), 2)::DOUBLE AS mem_percent,
    CAST(k + k * 2 AS BIGINT) AS rx_bytes, CAST(k * 3 AS BIGINT) AS tx_bytes FROM base)"""


@register("h10_container_usage", with_views("base") + _CONT_SQL + """
SELECT host, container, ts, cpu_percent, mem_mb, mem_percent, rx_bytes, tx_bytes FROM cs""")
def h10_container_usage(spark, sf):
    return H.container_usage(_container_stats(spark, sf)).select(
        "host", "container", "ts", "cpu_percent", "mem_mb", "mem_percent", "rx_bytes", "tx_bytes")


@register("h11_container_totals", with_views("base") + _CONT_SQL + """
SELECT host, ts, round(sum(cpu_percent), 2) AS cpu_percent, round(sum(mem_mb), 1) AS mem_mb,
  count(*) FILTER (WHERE running) AS running FROM cs GROUP BY host, ts""")
def h11_container_totals(spark, sf):
    return H.container_totals(H.container_usage(_container_stats(spark, sf)))


@register("h12_process_cpu_from_ticks", with_views("base") + """
SELECT event_id, round(CASE WHEN 200000.0 - (es % 100000) / 100.0 > 0 THEN least(100.0, greatest(0.0,
  (k * 10 + (k % 7) * 10) / 100.0 / (200000.0 - (es % 100000) / 100.0) * 100.0 / 4)) ELSE 0.0 END, 1) AS cpu_percent
FROM base""")
def h12_process_cpu_from_ticks(spark, sf):
    b = V.base(spark, sf).select("event_id", (F.col("k") * 10).alias("utime"),
                                 (F.col("k") % 7 * 10).alias("stime"),
                                 (F.col("es") % 100000).alias("starttime"),
                                 F.lit(200000.0).alias("system_uptime"), F.lit(4).alias("num_cpus"))
    return H.process_cpu_from_ticks(b).select("event_id", "cpu_percent")


@register("h13_cpu_topology", with_views("base") + """
, ci AS (SELECT DISTINCT host, user_id % 8 AS processor, user_id % 2 AS physical_id, user_id % 4 AS core_id FROM base)
SELECT host, count(*) AS logical, count(DISTINCT (physical_id, core_id)) AS physical FROM ci GROUP BY host""")
def h13_cpu_topology(spark, sf):
    b = V.base(spark, sf).select("host", (F.col("user_id") % 8).alias("processor"),
                                 (F.col("user_id") % 2).alias("physical_id"),
                                 (F.col("user_id") % 4).alias("core_id")).distinct()
    return H.cpu_topology(b)


# ---------------------------------------------------------------- T

_T_CUT = "2024-01-16 06:30:00"  # each table's as_of is its retention after this


def _table_rows(spark, sf) -> dict:
    """Every table and stream of the system as (key, ts)."""
    def keyed(df, *key, ts="ts"):
        return df.select(F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("key"), F.col(ts).alias("ts"))

    al, ac = alerts(spark, sf).checkpoint(), actions(spark, sf).checkpoint()
    out = outcomes(spark, sf)
    return {
        "logs": keyed(V.raw_logs(spark, sf), "id"),
        "network": keyed(network_events(spark, sf), "host", "type", "source_ip", "ts"),
        "processes": keyed(process_events(spark, sf), "host", "pid", "snap"),
        "features": keyed(vectors(spark, sf), "host", "ts"),
        "scores": keyed(V.scores_raw(spark, sf), "id"),
        "alerts": keyed(al, "alert_id"),
        "actions": keyed(ac, "action_id"),
        "audit": keyed(al, "alert_id").unionByName(keyed(ac, "action_id")),
        "dead_letter": keyed(out.filter("status = 'failed'"), "delivery_id"),
        "webhook_deliveries": keyed(out, "delivery_id"),
        "host_metrics": keyed(V.base(spark, sf), "host", "event_id"),
    }


_TABLE_SQL = with_views("raw_logs", "logs", "connections", "processes", "scores_raw", "requests", "attempts", recursive=True, extra=(
    NEWCONN_SQL.strip() + "," + PROC_SQL.strip() + "," + TEL_SQL.strip() + ",\n" + RULES_SQL + "," + MATCH_SQL.strip()
    + _ALERT_SQL[len(_POLICY_SQL.rstrip()):].rstrip() + "," + DISP_SQL.strip()
    + ",\n" + _OUT_SQL[_OUT_SQL.index("urls(webhook_name, url)"):].strip() + """,
rows_of AS (
  SELECT 'logs' AS "table", CAST(id AS VARCHAR) AS key, ts FROM raw_logs
  UNION ALL SELECT 'network', host || ':' || type || ':' || source_ip || ':' || CAST(ts AS VARCHAR), ts FROM tel WHERE stream = 'network'
  UNION ALL SELECT 'processes', host || ':' || pid || ':' || snap, make_timestamp(snap * 86400 * 1000000) FROM pev WHERE is_new OR risk_flag
  UNION ALL SELECT 'features', host || ':' || CAST(ts AS VARCHAR), ts FROM vec
  UNION ALL SELECT 'scores', CAST(id AS VARCHAR), ts FROM scores_raw
  UNION ALL SELECT 'alerts', alert_id, ts FROM alerts
  UNION ALL SELECT 'actions', action_id, ts FROM acts
  UNION ALL SELECT 'audit', alert_id, ts FROM alerts
  UNION ALL SELECT 'audit', action_id, ts FROM acts
  UNION ALL SELECT 'dead_letter', CAST(delivery_id AS VARCHAR), ts FROM outcomes WHERE status = 'failed'
  UNION ALL SELECT 'webhook_deliveries', CAST(delivery_id AS VARCHAR), ts FROM outcomes
  UNION ALL SELECT 'host_metrics', host || ':' || event_id, ts FROM base)
"""))


@register("t1_retention_cleanup", _TABLE_SQL + f"""
SELECT CASE "table" WHEN 'audit' THEN 'audit_log' ELSE "table" END AS "table",
  count(*) FILTER (ts < TIMESTAMP '{_T_CUT}') AS rows_deleted, 0::BIGINT AS rows_deleted_again,
  count(*) FILTER (ts >= TIMESTAMP '{_T_CUT}') AS rows_kept, min(ts) FILTER (ts >= TIMESTAMP '{_T_CUT}') AS oldest_kept,
  sum(('0x' || substr(md5(key), 1, 8))::BIGINT) FILTER (ts >= TIMESTAMP '{_T_CUT}')::BIGINT AS kept_keys
FROM rows_of WHERE "table" IN ('logs', 'scores', 'host_metrics', 'webhook_deliveries', 'audit', 'alerts', 'actions') GROUP BY "table\"""")
def t1_retention_cleanup(spark, sf):
    """Retention run twice on tables stored by day; what is left is read back."""
    rows = _table_rows(spark, sf)
    rows["audit_log"] = rows["audit"]
    out = None
    for name, days in S.RETENTION_DAYS.items():
        path = _scratch(spark, f"retention-{name}")
        SK.append_once(rows[name], path, "key")
        as_of = (dt.datetime.fromisoformat(_T_CUT) + dt.timedelta(days=days)).isoformat(sep=" ")
        gone, again = T.enforce_retention(spark, path, days, as_of), T.enforce_retention(spark, path, days, as_of)
        left = spark.read.parquet(path).agg(
            F.lit(name).alias("table"), F.lit(gone).cast("long").alias("rows_deleted"),
            F.lit(again).cast("long").alias("rows_deleted_again"),
            F.count(F.lit(1)).alias("rows_kept"), F.min("ts").alias("oldest_kept"),
            F.sum(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")).alias("kept_keys"))
        out = left if out is None else out.unionByName(left)
    return out


@register("t2_trim_stream", with_views("raw_logs", "scores_raw", "requests") + """
SELECT 'logs' AS stream, id FROM (SELECT id FROM raw_logs ORDER BY ts DESC, id DESC LIMIT 50000)
UNION ALL SELECT 'scores', id FROM (SELECT id FROM scores_raw ORDER BY ts DESC, id DESC LIMIT 10000)
UNION ALL SELECT 'actions', request_id FROM (SELECT request_id FROM requests ORDER BY ts DESC, request_id DESC LIMIT 5000)""")
def t2_trim_stream(spark, sf):
    """The three streams of raw events, each by its own cap."""
    streams = {"logs": V.raw_logs(spark, sf), "scores": V.scores_raw(spark, sf),
               "actions": V.requests(spark, sf).withColumn("id", F.col("request_id"))}
    parts = [T.trim_stream(d, S.STREAM_CAPS[name]).select(F.lit(name).alias("stream"), "id")
             for name, d in streams.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("t2_trim_all_streams", _TABLE_SQL + " UNION ALL ".join(
    f"""(SELECT "table" AS stream, key FROM rows_of WHERE "table" = '{name}' ORDER BY ts DESC, key DESC LIMIT {cap})"""
    for name, cap in (("logs", 50000), ("network", 50000), ("processes", 50000), ("features", 10000), ("scores", 10000),
                      ("alerts", 10000), ("actions", 5000), ("audit", 100000), ("dead_letter", 1000))))
def t2_trim_all_streams(spark, sf):
    """Each of the nine streams keeps as many of its newest entries as its own cap says."""
    rows, out = _table_rows(spark, sf), None
    for name, cap in S.STREAM_CAPS.items():
        kept = T.trim_stream(rows[name], cap, tie="key").select(F.lit(name).alias("stream"), "key")
        out = kept if out is None else out.unionByName(kept)
    return out


# ---------------------------------------------------------------- S

_LINES_SQL = with_views("raw_logs") + """
SELECT source, CAST(count(*) AS BIGINT) AS lines, sum(('0x' || substr(md5(trim(line)), 1, 8))::BIGINT)::BIGINT AS text
FROM raw_logs WHERE length(trim(line)) > 0 AND source IN ('auth.log', 'syslog', 'kern.log', 'access.log') GROUP BY source"""


def _lines(rows):
    """Per log the number of lines and a checksum of their text."""
    digits = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.sum(digits).alias("text"))


@register("s1_read_log_files", _LINES_SQL)
def s1_read_log_files(spark, sf):
    """raw_logs written as text files per log name under a shared folder, then read back."""
    root = _scratch(spark, "hostlogs")
    rl = V.raw_logs(spark, sf)
    layout = {"auth.log": "auth.log", "syslog": "syslog", "kern.log": "kern.log",
              "access.log": "nginx/access.log"}
    for src, rel in layout.items():
        rl.filter(F.col("source") == src).select(F.col("line").alias("value")) \
            .write.mode("overwrite").text(os.path.join(root, rel))
    return _lines(FI.read_log_files(spark, root))


@register("s3_decode_envelope", with_views("envelope") + """
SELECT id, CASE WHEN json_valid(data) THEN TRY_CAST(json_extract_string(data, '$.k') AS BIGINT) END AS k,
  'env' AS form, NULL AS word, NULL::BIGINT AS list_size FROM envelope
UNION ALL SELECT id, CASE WHEN json_valid(data) THEN TRY_CAST(json_extract_string(data, '$.k') AS BIGINT) END, 'flat',
  CASE WHEN id % 3 = 0 THEN 'plain ' || id % 7 ELSE 'quoted ' || id % 7 END, CASE WHEN id % 4 > 0 THEN id % 4 END FROM envelope""")
def s3_decode_envelope(spark, sf):
    """Both forms: one JSON document per entry, and fields that each hold JSON or text."""
    env = V.envelope(spark, sf)
    whole = EN.decode_envelope(env, S.ENVELOPE_DATA).select(
        "id", "k", F.lit("env").alias("form"), F.lit(None).cast("string").alias("word"),
        F.lit(None).cast("long").alias("list_size"))
    n = F.col("id") % 7
    flat = EN.decode_flat(env.select(
        "id", "data", F.when(F.col("id") % 3 == 0, F.concat(F.lit("plain "), n.cast("string")))
        .otherwise(F.concat(F.lit('"quoted '), n.cast("string"), F.lit('"'))).alias("word"),
        F.to_json(F.sequence(F.lit(1), (F.col("id") % 4).cast("int"), F.lit(1))).alias("list"))
        .withColumn("list", F.when(F.col("id") % 4 > 0, F.col("list"))), ["data", "word", "list"])
    return whole.unionByName(flat.select(
        "id", F.try_variant_get("data", "$.k", "bigint").alias("k"), F.lit("flat").alias("form"),
        F.try_variant_get("word", "$", "string").alias("word"),
        F.size(F.try_variant_get("list", "$", "array<bigint>")).cast("long").alias("list_size")))


@register("s4_split_dead_letters", with_views("envelope") + """
SELECT 'ml' AS source, CAST(id AS VARCHAR) AS msg_id, 'json_decode_error' AS reason, substr(data, 1, 500) AS data
FROM envelope WHERE NOT json_valid(data)
UNION ALL
SELECT 'actions', CAST(id AS VARCHAR), 'ValueError: no budget for k = ' || json_extract_string(data, '$.k'), NULL
FROM envelope WHERE json_valid(data) AND TRY_CAST(json_extract_string(data, '$.k') AS BIGINT) % 10 = 0""")
def s4_split_dead_letters(spark, sf):
    """Entries that don't parse, and entries whose handling fails row by row."""
    good, dead = EN.split_dead_letters(V.envelope(spark, sf), "ml")

    def budget(k: str) -> int:
        if int(k) % 10 == 0:
            raise ValueError(f"no budget for k = {k}")
        return 100 // int(k)

    _, failed = EN.handled(EN.decode_envelope(good, S.ENVELOPE_DATA), budget, [F.col("k").cast("string")], "long")
    errors = EN.processing_dead_letters(failed, "actions").withColumn("data", F.lit(None).cast("string"))
    cols = ["source", "msg_id", "reason", "data"]
    return dead.select(*cols).unionByName(errors.select(*cols))


@register("s5_parse_connection_snapshot", with_views("connections") + """
SELECT host, snap, local_ip, local_port, remote_ip, remote_port, state FROM connections""")
def s5_parse_connection_snapshot(spark, sf):
    lines = TCP.render_tcp_table(V.connections(spark, sf))
    return TCP.parse_connection_snapshot(lines).select(
        "host", "snap", "local_ip", "local_port", "remote_ip", "remote_port", "state")


@register("s9_append_alerts", _ALERT_SQL + "SELECT DISTINCT alert_id, policy_name, score_id, ts, message FROM alerts")
def s9_append_alerts(spark, sf):
    """Alerts appended twice (a replayed batch) keep one row per alert_id."""
    path = _scratch(spark, "alerts")
    a = alerts(spark, sf).checkpoint(eager=True)
    SK.append_alerts(a, path)
    SK.append_alerts(a, path)
    return spark.read.parquet(path).select("alert_id", "policy_name", "score_id", "ts", "message")


@register("s10_append_logs", with_views("logs") + """
SELECT id, date_trunc('second', ts) AS ts, message, coalesce(source, 'unknown') AS source,
  coalesce(level, 'info') AS level, coalesce(type, 'unknown') AS log_type
FROM logs""")
def s10_append_logs(spark, sf):
    path = _scratch(spark, "logs")
    lg = logs(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    SK.append_logs(lg, path, AS_OF)
    return spark.read.parquet(path).select("id", "ts", "message", "source", "level", "log_type")


@register("s11_append_audit", _R_SQL.rstrip() + """,
""" + _ALERT_SQL[len("WITH RECURSIVE "):].replace("base AS (", "base2 AS (", 1).replace("FROM base)", "FROM base2)")
          .replace("scores_raw AS (", "scores_raw2 AS (").replace("FROM scores_raw s", "FROM scores_raw2 s").rstrip() + """
SELECT 'alert_generated' AS event_type, alert_id AS ref_id, action, source_ip AS target,
  'policy_engine' AS triggered_by, 'generated' AS status FROM alerts
UNION ALL SELECT 'action_executed', action_id, action, target, triggered_by, status FROM acts""")
def s11_append_audit(spark, sf):
    path = _scratch(spark, "audit")
    SK.append_audit(SK.audit_rows(alerts(spark, sf), actions(spark, sf)), path)
    return spark.read.parquet(path).select("event_type", "ref_id", "action", "target", "triggered_by", "status")


@register("p15_metric_bands", with_views("base") + """
, m AS (SELECT host, ts, least(100.0, value) AS cpu_percent, least(100.0, value / 4) AS memory_percent,
          value % 100 AS disk_percent, value / 50 AS load_1m, round(least(1.0, value / 150.0), 4) AS risk_score FROM base),
u AS (
  SELECT host, ts, 'cpu_percent' AS metric, cpu_percent AS value,
    CASE WHEN cpu_percent > 80 THEN 'danger' WHEN cpu_percent > 50 THEN 'warning' ELSE 'success' END AS status FROM m
  UNION ALL SELECT host, ts, 'memory_percent', memory_percent,
    CASE WHEN memory_percent > 85 THEN 'danger' WHEN memory_percent > 70 THEN 'warning' ELSE 'success' END FROM m
  UNION ALL SELECT host, ts, 'disk_percent', disk_percent,
    CASE WHEN disk_percent > 90 THEN 'danger' WHEN disk_percent > 75 THEN 'warning' ELSE 'success' END FROM m
  UNION ALL SELECT host, ts, 'load_1m', load_1m,
    CASE WHEN load_1m > 4 THEN 'danger' WHEN load_1m > 2 THEN 'warning' ELSE 'success' END FROM m
  UNION ALL SELECT host, ts, 'risk_score', risk_score, CASE WHEN risk_score > 0.7 THEN 'danger' ELSE 'success' END FROM m
  UNION ALL SELECT host, ts, 'risk_level', NULL,
    CASE WHEN risk_score >= 0.8 THEN 'danger' ELSE 'success' END FROM m)
SELECT host, ts, metric, round(value, 4) AS value, status FROM u""")
def p15_metric_bands(spark, sf):
    """Dashboard bands over per-event metrics derived from ``value``."""
    from ..operators.scoring import risk_level_col
    b = V.base(spark, sf)
    v = F.col("value")
    risk = F.round(F.least(F.lit(1.0), v / 150.0), 4)
    m = b.select("host", "ts", F.least(F.lit(100.0), v).alias("cpu_percent"),
                 F.least(F.lit(100.0), v / 4).alias("memory_percent"), (v % 100).alias("disk_percent"),
                 (v / 50).alias("load_1m"), risk.alias("risk_score"),
                 risk_level_col(risk).alias("risk_level"))
    return Q.metric_bands(m).select("host", "ts", "metric", F.round("value", 4).alias("value"), "status")


@register("s2_stream_log_files", _LINES_SQL)
def s2_stream_log_files(spark, sf):
    """raw_logs tailed over a rotation: each log's older lines are a first segment,
    read to its end; the query stops, a second segment comes, and the query goes
    on from its checkpoint."""
    from ..streaming import jobs as Z
    root = _scratch(spark, "taillogs")
    rl = V.raw_logs(spark, sf)
    middle = rl.agg((F.unix_micros(F.min("ts").cast("timestamp")) / 2
                     + F.unix_micros(F.max("ts").cast("timestamp")) / 2).alias("m")).first()[0] or 0
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(middle)
    logs_of = ("auth.log", "syslog", "kern.log", "access.log")
    for src in logs_of:
        rl.limit(0).select(F.col("line").alias("value")).write.text(os.path.join(root, src))

    class Rotation:
        def through(self, start):
            for segment in (~late, late):
                for src in logs_of:
                    rl.filter((F.col("source") == src) & segment).select(F.col("line").alias("value")) \
                        .write.mode("append").text(os.path.join(root, src))
                start().awaitTermination()

    s = FI.stream_log_files(spark, root, max_files_per_trigger=2, source_from_parent=True)
    return _lines(Z.run_to_table(s, spark, "s2", replay=Rotation()))
