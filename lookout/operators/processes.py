"""Process snapshots: risk rules (P7-P10), diffs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def _children_map() -> Column:
    kv = []
    for parent, kids in S.SUSPICIOUS_CHILDREN.items():
        kv += [F.lit(parent), F.array(*[F.lit(k) for k in kids])]
    return F.create_map(*kv)


def suspicious_child(parent: Column, child: Column) -> Column:
    """(parent, child) is in the fixed table; a literal map lookup, no join."""
    kids = _children_map()[parent]
    return F.coalesce(F.array_contains(kids, child), F.lit(False))


def cpu_reason(cpu: Column) -> Column:
    return F.format_string("High CPU: %.1f%%", F.round(cpu, 1))


def mem_reason(mem: Column) -> Column:
    return F.format_string("High memory: %.0fMB", F.round(mem, 0))


def process_risk(df: DataFrame) -> DataFrame:
    """Every rule is tested; the last one that holds gives the reason."""
    cpu_hit = F.col("cpu_percent") > S.CPU_SPIKE_THRESHOLD
    mem_hit = F.col("memory_mb") > S.MEMORY_SPIKE_MB
    child_hit = suspicious_child(F.col("parent_name"), F.col("name"))
    reason = F.coalesce(
        F.when(child_hit, F.concat(F.lit("Unusual child: "), F.col("parent_name"), F.lit(" → "),
                                   F.col("name"))),
        F.when(mem_hit, mem_reason(F.col("memory_mb"))),
        F.when(cpu_hit, cpu_reason(F.col("cpu_percent"))),
    )
    return df.withColumn("cpu_spike", cpu_hit).withColumn("memory_spike", mem_hit) \
        .withColumn("unusual_child", child_hit) \
        .withColumn("risk_flag", cpu_hit | mem_hit | child_hit) \
        .withColumn("risk_reason", reason)


def api_process_risk(df: DataFrame) -> DataFrame:
    """The API's variant: CPU before memory, no child rule."""
    reason = (F.when(F.col("cpu_percent") > 80, cpu_reason(F.col("cpu_percent")))
              .when(F.col("memory_mb") > 500, mem_reason(F.col("memory_mb"))))
    return df.withColumn("risk_flag", reason.isNotNull()).withColumn("risk_reason", reason)


def previous_snapshot(snaps: DataFrame, keys=("host",), snap: str = "snap",
                      bucket_size: int = 4096) -> DataFrame:
    """(keys, snap, prev_snap) over the distinct snapshot numbers.

    The snapshot list is small next to the rows but still grows with time
    (a poll every few seconds), so the lag is bucketed by snapshot number
    with the previous bucket's last snapshot carried in."""
    keys = list(keys)
    d = snaps.select(*keys, snap).distinct().withColumn("__b", F.floor(F.col(snap) / bucket_size))
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    carry = d.groupBy(*keys, "__b").agg(F.max(snap).alias("__last")) \
        .select(*keys, "__b", F.lag("__last").over(by_bucket).alias("__carry"))
    prev = F.lag(snap).over(Window.partitionBy(*keys, "__b").orderBy(snap))
    return d.join(carry, [*keys, "__b"]).select(*keys, snap, F.coalesce(prev, F.col("__carry")).alias("prev_snap"))


def new_processes(procs: DataFrame) -> DataFrame:
    """D3: pid absent from the host's previous snapshot -> new_process."""
    prev = previous_snapshot(procs)
    cur = procs.join(prev, ["host", "snap"])
    before = procs.select("host", F.col("snap").alias("prev_snap"), "pid",
                          F.lit(True).alias("__seen"))
    j = cur.join(before, ["host", "prev_snap", "pid"], "left")
    return j.withColumn("is_new", F.col("__seen").isNull()) \
        .withColumn("type", F.when(F.col("is_new"), "new_process").otherwise("process_snapshot")) \
        .drop("__seen")


def flagged_or_new(df: DataFrame, cmd_len: int = 500) -> DataFrame:
    """P10: keep rows that are new or flagged; cut cmdline, round memory to 1 dp."""
    return df.filter(F.col("is_new") | F.col("risk_flag")) \
        .withColumn("cmdline", F.substring("cmdline", 1, cmd_len)) \
        .withColumn("memory_mb", F.round("memory_mb", 1))


def process_events(procs: DataFrame) -> DataFrame:
    """D3 + P7 + P10: the process event stream of the collector."""
    return flagged_or_new(process_risk(new_processes(procs)))


def process_summary(procs: DataFrame) -> DataFrame:
    """Per (host, snapshot) counts, each condition counted on its own."""
    d = process_risk(new_processes(procs))
    return d.groupBy("host", "snap").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_new").alias("new_spawns"),
        F.count_if("cpu_spike").alias("cpu_spikes"),
        F.count_if("memory_spike").alias("memory_spikes"),
        F.count_if("unusual_child").alias("unusual_children"),
    )
