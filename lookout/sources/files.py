"""Log file sources."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def _fs_glob(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths matching ``pattern`` on the cluster file system (a listing,
    not a read: only names reach the driver)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    stats = fs.globStatus(path)
    return [] if stats is None else [s.getPath().toString() for s in stats]


def read_log_files(spark: SparkSession, root: str, patterns=S.LOG_PATTERNS,
                   host: str | None = None) -> DataFrame:
    """Lines of every existing log file under ``root``; missing files are
    skipped; ``source`` is the file's base name (also of a log kept as a folder of
    segments); lines trimmed, blanks dropped; undecodable bytes are replaced (the
    text source decodes leniently). One read of all paths: the name comes from
    the file's metadata."""
    paths = [p for pat in patterns for p in _fs_glob(spark, os.path.join(root, pat))]
    if not paths:
        return spark.createDataFrame([], "source string, line string, file string")
    names = "|".join(re.escape(p).replace(r"\*", "[^/]*") for p in patterns)
    log = F.regexp_extract("_metadata.file_path", f"/({names})(?:/[^/]+)?$", 1)
    out = spark.read.text(paths).select(
        F.regexp_extract(log, "([^/]*)$", 1).alias("source"), F.trim(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("file")).filter(F.length("line") > 0)
    if host is not None:
        out = out.withColumn("host", F.lit(host))
    return out


def stream_log_files(spark: SparkSession, directory: str, max_files_per_trigger: int = 100,
                     source_from_parent: bool = False) -> DataFrame:
    """A continuous tail of a log folder (and its sub-folders). Progress lives
    in the query's checkpoint, so a restart resumes where it stopped; a rotated
    segment is a new file and is read from its start (it needs a name of its own:
    a path that was read isn't read again). ``source`` is the file's
    base name, or its folder's name when segments are kept one folder per log."""
    path = F.col("_metadata.file_path")
    src = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1) if source_from_parent \
        else F.regexp_extract(path, r"([^/]*)$", 1)
    return spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger) \
        .option("recursiveFileLookup", "true").text(directory) \
        .select(src.alias("source"), F.trim("value").alias("line")) \
        .filter(F.length("line") > 0)
