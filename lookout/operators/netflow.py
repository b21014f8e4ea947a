"""Connection snapshots: new / closed connections and port-scan candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .processes import previous_snapshot

KEY_COLS = ("remote_ip", "remote_port", "local_ip", "local_port")


def connection_key(df: DataFrame) -> DataFrame:
    return df.withColumn("conn_key", F.concat(
        F.col("remote_ip"), F.lit(":"), F.col("remote_port").cast("string"), F.lit("->"),
        F.col("local_ip"), F.lit(":"), F.col("local_port").cast("string")))


def _by_key() -> WindowSpec:
    return Window.partitionBy("host", "conn_key").orderBy("snap")


def new_connections(conns: DataFrame) -> DataFrame:
    """Connections whose key is absent from the host's previous snapshot.

    The host's first snapshot is all new; remote 0.0.0.0 is dropped. One shuffle
    on (host, key) tells when a key was last seen; that is compared to the host's
    previous snapshot, of which there is one row per snapshot."""
    prev = previous_snapshot(conns)
    d = connection_key(conns.filter(F.col("remote_ip") != "0.0.0.0")).withColumn(
        "__seen", F.max("snap").over(_by_key().rangeBetween(Window.unboundedPreceding, -1)))
    d = d.join(prev, ["host", "snap"])
    fresh = F.col("__seen").isNull() | F.col("prev_snap").isNull() | (F.col("__seen") < F.col("prev_snap"))
    return d.filter(fresh).drop("__seen").withColumn("type", F.lit("new_connection"))


def closed_connections(conns: DataFrame) -> DataFrame:
    """Per snapshot, number of keys of the previous snapshot that are gone (>0 only)."""
    after = previous_snapshot(conns).filter(F.col("prev_snap").isNotNull()) \
        .select("host", F.col("prev_snap").alias("snap"), F.col("snap").alias("next_snap"))
    keys = connection_key(conns).select("host", "snap", "conn_key").distinct() \
        .withColumn("__seen", F.lead("snap").over(_by_key()))
    gone = keys.join(after, ["host", "snap"]) \
        .filter(F.col("__seen").isNull() | (F.col("__seen") > F.col("next_snap")))
    return gone.groupBy("host", F.col("next_snap").alias("snap")) \
        .agg(F.count(F.lit(1)).alias("closed"))


def port_scan_candidates(new_conns: DataFrame, window: str = "30 seconds",
                         min_ports: int = 5, ts: str = "ts") -> DataFrame:
    """Remote IPs touching more than ``min_ports`` distinct local ports
    with new connections in one tumbling window."""
    g = new_conns.groupBy("host", F.window(ts, window).alias("w"), "remote_ip").agg(
        F.count_distinct("local_port").alias("ports"))
    return g.filter(F.col("ports") > min_ports).select(
        "host", F.col("w.start").alias("window_start"), "remote_ip",
        F.col("ports").cast("long").alias("ports"),
        F.lit("port_scan_candidate").alias("type"))
