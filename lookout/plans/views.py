"""Telemetry views derived from the driver's ``events`` table.

The driver tables hold no logs, connection tables or counters, so each
view below renders rows of the shape an operator expects from ``events``
(see FIXTURES.md, part B). The views only shape input; none of them does an
operator's work. All are narrow projections (no shuffle) except the ones
whose definition needs a distinct / newest-row / running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def _i(c) -> Column:
    return c.cast("string")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events + k, es (epoch seconds), host and ip."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    uid = F.col("user_id")
    ip = F.when(
        k % 10 == 0, F.concat(F.lit("10.0.0."), _i(uid % 5 + 1))
    ).otherwise(F.concat(F.lit("203.0.113."), _i(uid % 20 + 1)))
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        k.alias("k"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("es"),
        F.concat(F.lit("h"), _i(uid % 4)).alias("host"),
        ip.alias("ip"),
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, host, source, line): one rendered log line per event."""
    b = base(spark, sf_dir)
    t, k, ip = F.col("event_type"), F.col("k"), F.col("ip")
    user = F.concat(F.lit("u"), _i(F.col("user_id")))
    port = _i(k + 1024)
    source = (
        F.when(t.isin("error", "signup"), "auth.log")
        .when(t == "purchase", "syslog")
        .when(t == "click", "access.log")
        .when(t == "view", "kern.log")
        .otherwise("unknown")
    )
    status = F.when(k % 10 == 0, "503").when(k % 7 == 0, "404").otherwise("200")
    message = (
        F.when((t == "error") & (k % 2 == 0), F.concat(
            F.lit("sshd[7]: Failed password for "),
            F.when(k % 4 == 0, "invalid user ").otherwise(""),
            user, F.lit(" from "), ip, F.lit(" port "), port, F.lit(" ssh2")))
        .when(t == "error", F.lit("login: pam_unix(login:auth): authentication failure; uid=0"))
        .when((t == "signup") & (k % 3 == 0), F.concat(
            F.lit("sshd[7]: Accepted publickey for "), user, F.lit(" from "), ip,
            F.lit(" port "), port))
        .when((t == "signup") & (k % 3 == 1), F.concat(
            F.lit("sudo:    "), user, F.lit(" : TTY=pts/0 ; COMMAND=/bin/ls")))
        .when(t == "signup", F.lit("sshd[7]: pam_unix(sshd:session): session opened for user u1"))
        .when((t == "purchase") & (k % 2 == 0), F.concat(
            F.lit("systemd[1]: Started unit-"), _i(k), F.lit(".service")))
        .when((t == "purchase") & (k % 4 == 1), F.lit("disk: I/O ERROR on sda"))
        .when(t == "purchase", F.lit("cron: tick"))
        .when(t == "click", F.concat(
            ip, F.lit(' - - "GET /p/'), _i(k), F.lit(' HTTP/1.1" '), status, F.lit(" 512")))
        .when((t == "view") & (k % 20 == 0),
              F.lit("kernel: Out of memory: Killed process 77 (java)"))
        .otherwise(F.lit("usb: device connected"))
    )
    return b.select(F.col("event_id").alias("id"), "ts", "host",
                    source.alias("source"), message.alias("line"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection snapshots: one row per (host, snap, connection)."""
    b = base(spark, sf_dir)
    k = F.col("k")
    m = k % 12
    local_port = (
        F.when(m == 0, 22).when(m == 1, 80).when(m == 2, 443).when(m == 3, 8080)
        .when(m == 4, 3306).when(m == 5, 5432).when(m == 6, 6379)
        .otherwise(9000 + m)
    )
    state = F.when(k % 5 == 0, "LISTEN").when(k % 5 == 4, "TIME_WAIT").otherwise("ESTABLISHED")
    return b.select(
        "host",
        F.floor(F.col("es") / 21600).cast("long").alias("snap"),
        F.col("ip").alias("remote_ip"),
        (40000 + k % 3).cast("int").alias("remote_port"),
        F.lit("192.0.2.1").alias("local_ip"),
        local_port.cast("int").alias("local_port"),
        state.alias("state"),
    ).distinct()


SNAP_SECONDS_CONN = 21600
SNAP_SECONDS_PROC = 86400

_PROC_NAMES = ["bash", "python3", "nginx", "curl", "java", "sshd"]
_PARENTS = ["nginx", "mysqld", "postgres", "systemd", "httpd"]


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process snapshots: newest event per (host, day snapshot, pid)."""
    b = base(spark, sf_dir)
    k, uid = F.col("k"), F.col("user_id")
    name = F.element_at(F.array(*[F.lit(x) for x in _PROC_NAMES]), (k % 6 + 1).cast("int"))
    parent = F.element_at(F.array(*[F.lit(x) for x in _PARENTS]), (uid % 5 + 1).cast("int"))
    rows = b.select(
        "host", "ts", "event_id",
        F.floor(F.col("es") / SNAP_SECONDS_PROC).cast("long").alias("snap"),
        (100 + uid % 60).cast("int").alias("pid"),
        name.alias("name"),
        F.concat(name, F.lit(" --job "), _i(k)).alias("cmdline"),
        F.least(F.lit(100.0), F.col("value")).alias("cpu_percent"),
        (F.col("value") * 4).alias("memory_mb"),
        (k % 10).cast("int").alias("connections"),
        F.lit("running").alias("status"),
        (1 + uid % 5).cast("int").alias("ppid"),
        parent.alias("parent_name"),
    )
    newest = rows.groupBy("host", "snap", "pid").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in ("host", "snap", "pid")]),
                 F.struct("ts", "event_id")).alias("r"))
    return newest.select("host", "snap", "pid", "r.*").drop("event_id")


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    data = F.when(F.col("k") % 17 == 0, F.lit("{bad")).otherwise(F.col("props"))
    return b.select(F.col("event_id").alias("id"), "ts", data.alias("data"))


_ANOMALY_TYPES = ["brute_force", "port_scan", "ssh_failure", "process_spike", "unknown"]


def scores_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score events: (id, ts, host, score, risk_level, anomaly_type, source_ip, features)."""
    b = base(spark, sf_dir)
    k = F.col("k")
    score = F.round(F.least(F.lit(1.0), F.col("value") / 150.0), 4)
    atype = F.element_at(F.array(*[F.lit(x) for x in _ANOMALY_TYPES]), (k % 5 + 1).cast("int"))
    from ..operators.scoring import risk_level_col
    feats = F.create_map(
        F.lit("log_total_events"), (k % 13).cast("double"),
        F.lit("log_auth_failures"), (k % 7).cast("double"),
        F.lit("net_new_connections"), (k % 11).cast("double"),
        F.lit("proc_new_spawns"), (k % 3).cast("double"),
        F.lit("window_seconds"), F.lit(3600.0),
    )
    return b.select(
        F.col("event_id").alias("id"), "ts", "host",
        score.alias("score"), risk_level_col(score).alias("risk_level"),
        atype.alias("anomaly_type"), F.col("ip").alias("source_ip"),
        feats.alias("features"),
    )


_ACTIONS = ["block_ip", "kill_process", "alert_only", "unblock_ip", "Reboot", "resize",
            "block_ip", "block_ip"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action requests: (request_id, ts, action, target, triggered_by, alert_id, duration_minutes)."""
    b = base(spark, sf_dir)
    k = F.col("k")
    action = F.element_at(F.array(*[F.lit(x) for x in _ACTIONS]), (k % 8 + 1).cast("int"))
    target = (
        F.when((k % 8 == 1) & (k % 3 == 0), _i(F.col("user_id")))
        .when((k % 8 == 1) & (k % 3 == 1), F.lit("SSHD"))
        .when(k % 8 == 1, F.lit("worker"))
        .when(k % 16 == 6, F.lit(""))
        .otherwise(F.col("ip"))
    )
    return b.select(
        F.col("event_id").alias("request_id"), "ts", action.alias("action"),
        target.alias("target"),
        F.when(k % 4 == 3, "manual").otherwise("policy").alias("triggered_by"),
        F.concat(F.lit("alert_"), _i(F.col("event_id"))).alias("alert_id"),
        F.when(k % 4 == 3, (k % 3 + 1) * 30).cast("long").alias("duration_minutes"),
    )


_WEBHOOK_NAMES = ["slack", "discord", "siem", "mail"]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook delivery attempts: (delivery_id, attempt, webhook_name, http_status, error, ts)."""
    b = base(spark, sf_dir)
    k = F.col("k")
    did = F.floor(F.col("event_id") / 5).cast("long")
    status = F.when(k % 4 == 0, F.lit(200)).when(k % 4 == 3, F.lit(None)).otherwise(500 + k % 4)
    return b.select(
        did.alias("delivery_id"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        F.element_at(F.array(*[F.lit(x) for x in _WEBHOOK_NAMES]), (did % 4 + 1).cast("int"))
        .alias("webhook_name"),
        status.cast("int").alias("http_status"),
        F.when(k % 4 == 3, F.lit("timeout")).alias("error"),
        "ts",
    )


_SERVICES = {"click": "collectors", "view": "ml", "purchase": "policy_engine",
             "signup": "action_engine", "error": "webhook_service"}


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    svc = F.create_map(*[F.lit(x) for kv in _SERVICES.items() for x in kv])[F.col("event_type")]
    return b.select(svc.alias("service"), "ts")


def counters(spark: SparkSession, sf_dir: str, per: str | None = None, parts: bool = False) -> DataFrame:
    """Cumulative counters per host (``per`` adds a device key = event_type).

    Running sums are carried over the edges of even range partitions. ``parts``
    keeps these for an operator that reads the same keys in the same order."""
    from ..functions.ordered import prefix_sums
    b = base(spark, sf_dir)
    k = F.col("k")
    keys = ["host"] + ([per] if per else [])
    if per:
        b = b.withColumn(per, F.col("event_type"))
    sums = {
        "rx_bytes": F.floor(F.col("value") * 1000).cast("long"),
        "tx_bytes": F.floor(F.col("value") * 300).cast("long"),
        "user": k.cast("long"), "system": (k % 7).cast("long"),
        "idle": (100 - k).cast("long"), "iowait": (k % 3).cast("long"),
        "reads_completed": (k % 5).cast("long"), "sectors_read": F.floor(F.col("value") * 10).cast("long"),
        "writes_completed": (k % 3).cast("long"),
        "sectors_written": F.floor(F.col("value") * 3).cast("long"),
        "io_time_ms": (k * 10).cast("long"),
    }
    d = prefix_sums(b.select(*keys, "ts", "event_id", "value", "k"), keys, ["ts", "event_id"], sums, parts)
    return d.withColumnRenamed("event_id", "seq").drop("value", "k")
