"""Idempotent sinks (S9-S11). Tables are partitioned by day; every writer appends
with an anti join on the natural key against the days of its rows, so a replayed
micro-batch or a re-run after an executor loss adds nothing twice and reads only
those days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_DAY = "1970-01-01"  # of rows without a time


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to the table has been committed."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def append_once(df: DataFrame, path: str, key: str, ts: str = "ts", timed: str | None = None) -> None:
    """Append rows whose ``key`` is not in the table yet (first copy wins). A key
    belongs to one time, so only the partitions of the new rows' days are read;
    the list of these days is all that is broadcast. ``timed``: a column (not
    written) that tells rows with a time of their own from those whose ``ts``
    was filled in and may be another one on replay; the latter have one day."""
    spark = df.sparkSession
    own = F.when(F.col(timed), F.to_date(ts)) if timed else F.to_date(ts)
    df = df.withColumn("day", F.coalesce(own, F.lit(NO_DAY).cast("date")))
    new = df.dropDuplicates([key]).drop(*([timed] if timed else []))
    if _exists(spark, path):
        old = spark.read.parquet(path).select(key, "day").join(
            F.broadcast(df.select("day").distinct()), "day", "left_semi")
        new = new.join(old.select(key), key, "left_anti")
    new.write.mode("append").partitionBy("day").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Insert each alert once by alert_id."""
    append_once(alerts, path, "alert_id")


def prepare_logs(logs: DataFrame, as_of: str) -> DataFrame:
    """ISO time parse falling back to ``as_of``; field defaults."""
    own = F.try_to_timestamp(F.col("timestamp").cast("string")).cast("timestamp_ntz")
    return logs.select(
        F.coalesce(own, F.lit(as_of).cast("timestamp_ntz")).alias("ts"), own.isNotNull().alias("timed"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("level"), F.lit("info")).alias("level"),
        F.coalesce(F.col("type"), F.lit("unknown")).alias("log_type"),
        F.col("message"), F.col("source_ip"), F.col("user").alias("log_user"),
        F.col("id"))


def append_logs(logs: DataFrame, path: str, as_of: str) -> None:
    append_once(prepare_logs(logs, as_of), path, "id", timed="timed")


def audit_rows(alerts: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """One audit row per generated alert and per executed action."""
    parts = []
    if alerts is not None:
        parts.append(alerts.select(
            F.lit("alert_generated").alias("event_type"), F.col("alert_id").alias("ref_id"),
            F.col("action"), F.col("source_ip").alias("target"),
            F.lit("policy_engine").alias("triggered_by"), F.lit("generated").alias("status"), "ts"))
    if actions is not None:
        parts.append(actions.select(
            F.lit("action_executed").alias("event_type"), F.col("action_id").alias("ref_id"),
            "action", "target", "triggered_by", "status", "ts"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append_audit(rows: DataFrame, path: str) -> None:
    append_once(rows.withColumn("audit_id", F.concat_ws(":", "event_type", "ref_id")), path, "audit_id")
