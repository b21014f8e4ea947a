"""Retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import NO_DAY


def retention_split(df: DataFrame, days: int, as_of: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, expired) rows for a ``days`` retention at ``as_of``."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(int(days)))
    return df.filter(F.col(ts) >= cut), df.filter(F.col(ts) < cut)


def enforce_retention(spark: SparkSession, path: str, days: int, as_of: str, ts: str = "ts",
                      partition_col: str = "day") -> int:
    """T1 on a table stored by day: rows older than ``days`` at ``as_of`` go; returns
    how many went.

    Days before the cut lose their folder. The day that holds the cut, and the
    sinks' ``NO_DAY`` whose rows are stamped with any time, are written anew with
    the rows that stay (not those without a time), beside the table, and then put
    in the old one's place. Later days aren't read. A marker named after the cut
    closes the run: it is written last, so a run that broke off is done again
    (each step may be repeated), and one that is done deletes nothing when
    repeated."""
    cut = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=int(days))
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(*parts: str):
        return jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))

    name = cut.strftime("%Y%m%dT%H%M%S%f")
    marker = at("_retention", name)
    if not fs.exists(root) or fs.exists(marker):
        return 0
    # prunes folders
    old = spark.read.parquet(path).filter(F.col(partition_col) <= F.lit(cut.date()))
    kept, _ = retention_split(old, days, as_of, ts)
    n_expired = old.agg(F.count(F.lit(1)) - F.count_if(F.col(ts) >= F.lit(cut.isoformat()).cast("timestamp_ntz"))).first()[0]
    for day in (NO_DAY, str(cut.date())):
        edge, staged = at(f"{partition_col}={day}"), at("_retention", f"{name}-{day}")
        if fs.exists(edge):
            kept.filter(F.col(partition_col) == F.lit(day).cast("date")).drop(partition_col) \
                .write.mode("overwrite").parquet(staged.toString())
            fs.delete(edge, True)
        if not fs.exists(edge) and fs.exists(at("_retention", f"{name}-{day}", "_SUCCESS")):
            fs.rename(staged, edge)  # also where a run broke off between the two
    drop_expired_partitions(spark, path, days, as_of, partition_col)
    fs.mkdirs(marker.getParent())
    fs.create(marker, True).close()
    return n_expired


def trim_stream(df: DataFrame, cap: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``cap`` entries (exact; a bounded top-k, TakeOrderedAndProject)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(int(cap))


def drop_expired_partitions(spark, table_path: str, days: int, as_of: str,
                            partition_col: str = "date") -> list[str]:
    """T1 applied to a date-partitioned table: delete the ``partition_col=YYYY-MM-DD``
    folders older than ``days`` at ``as_of``, other than that of rows without a
    time of their own. Only folder names are listed on
    the driver (no data is read); returns the deleted partition values."""
    cutoff = (dt.datetime.fromisoformat(as_of) - dt.timedelta(days=int(days))).date()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    if not fs.exists(path):
        return dropped
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if not st.isDirectory() or not name.startswith(partition_col + "="):
            continue
        try:
            day = dt.date.fromisoformat(name.split("=", 1)[1][:10])
        except ValueError:
            continue
        if day < cutoff and str(day) != NO_DAY:
            fs.delete(st.getPath(), True)
            dropped.append(str(day))
    return sorted(dropped)
