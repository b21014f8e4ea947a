"""Registered queries: streaming jobs (Z1-Z6), each run to completion with
``trigger(availableNow=True)`` over the telemetry views written as
time-ordered parquet files in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy as P
from ..sources import sinks as SK
from ..sources.config import active_rules, rules_frame
from ..operators.folds import epoch_micros
from ..operators.netflow import connection_key
from ..streaming import jobs as Z
from . import views as V
from .q_detect import (_POLICY_SQL, _VEC_COLS, _VEC_SQL, NEWCONN_SQL, example_rules, logs,
                       telemetry)
from .q_respond import _R_SQL
from .registry import register
from .sqlviews import with_views


def _replay_of(spark, df, name, ts="ts"):
    return Z.Replay(df, Z.scratch(spark, f"{name}-in"), ts)


def _marked(stream, late: str = "10 minutes"):
    """``stream`` with a watermark on its event time."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


@register("z1_stream_features", _VEC_SQL + f"""
SELECT {_VEC_COLS} FROM vec
WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM tel) - INTERVAL 1 HOUR""")
def z1_stream_features(spark, sf):
    """F2 on a stream with a 1 h watermark: windows closed by the watermark."""
    r = _replay_of(spark, telemetry(spark, sf), "telemetry")
    out = Z.run_to_table(Z.stream_features(r.stream, 3600, "1 hour"), spark, "z1", replay=r)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("z2_stream_alerts", _POLICY_SQL + "SELECT id, policy_name FROM fired")
def z2_stream_alerts(spark, sf):
    """E2-E5 on a stream: repeat counts and cooldown kept as state per dedup key."""
    r = _replay_of(spark, V.scores_raw(spark, sf).drop("features"), "scores")
    m = P.match_rules(_marked(r.stream), rules_frame(spark, active_rules(example_rules())))
    m = m.withColumn("dedup_key", P.dedup_key(F.col("policy_name"), F.col("anomaly_type"),
                                              F.col("source_ip"))) \
        .withColumn("t_us", epoch_micros(F.col("ts")))
    out = Z.run_to_table(Z.stream_alerts(m), spark, "z2", replay=r)
    return out.filter("fired").select("id", "policy_name")


@register("z3_stream_rate_limit", _R_SQL + "SELECT request_id, rate_ok FROM val")
def z3_stream_rate_limit(spark, sf):
    """R5 on a stream with the last allowed times per target as state."""
    r = _replay_of(spark, V.requests(spark, sf), "requests")
    s = _marked(r.stream).withColumn("t_us", epoch_micros(F.col("ts")))
    out = Z.run_to_table(Z.stream_rate_limit(s), spark, "z3", replay=r)
    return out.select("request_id", "rate_ok")


@register("z4_stream_reversals", _R_SQL + """
SELECT action_id, target, 'unblock_ip' AS action, epoch_us(reversal_at) AS due_at FROM revs
WHERE epoch_us(reversal_at) <= (CAST(floor(epoch_us((SELECT max(ts) FROM revs)) / 1000) AS BIGINT) - 600000) * 1000""")
def z4_stream_reversals(spark, sf):
    """Blocked actions set event-time timers; unblock requests fire as the
    watermark passes each reversal time (timers still open at the end stay pending)."""
    from .q_respond import actions
    from ..operators import response as R
    rev = R.schedule_reversals(actions(spark, sf))
    r = _replay_of(spark, rev, "reversals")
    s = _marked(r.stream).withColumn("due_us", epoch_micros(F.col("reversal_at")))
    return Z.run_to_table(Z.stream_reversals(s), spark, "z4", replay=r)


@register("z5_stream_snapshot_diff", with_views("connections", extra=NEWCONN_SQL) + """
SELECT host, snap, remote_ip || ':' || CAST(remote_port AS VARCHAR) || '->' || local_ip || ':'
  || CAST(local_port AS VARCHAR) AS conn_key, remote_ip, local_port FROM newconn""")
def z5_stream_snapshot_diff(spark, sf):
    """D1 on a stream: a state per connection of a host and one for the host's snapshots."""
    c = connection_key(V.connections(spark, sf)).withColumn(
        "ts", F.timestamp_seconds(F.col("snap") * V.SNAP_SECONDS_CONN).cast("timestamp_ntz"))
    r = _replay_of(spark, c, "conns")
    out = Z.run_to_table(Z.stream_snapshot_diff(_marked(r.stream)), spark, "z5", replay=r)
    return out.select("host", "snap", "conn_key", "remote_ip", "local_port")


@register("z6_stream_persist", with_views("logs") + """
SELECT id, coalesce(source, 'unknown') AS source, coalesce(level, 'info') AS level,
  coalesce(type, 'unknown') AS log_type FROM logs""")
def z6_stream_persist(spark, sf):
    """Logs appended per micro-batch through the idempotent sink; one batch is replayed."""
    lg = logs(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    r = _replay_of(spark, lg, "logs")
    path = Z.scratch(spark, "z6-table")
    seen = []

    def writer(df):
        SK.append_logs(df, path, "2024-01-30 23:59:00")
        if not seen:  # replay the first batch: at-least-once delivery must not duplicate
            SK.append_logs(df, path, "2024-01-30 23:59:00")
            seen.append(1)

    Z.stream_persist(r.stream, writer, spark, "z6", replay=r)
    return spark.read.parquet(path).select("id", "source", "level", "log_type")
