"""SparkSession helpers shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Scan splits and post-shuffle partitions target ``partition_bytes`` (a
    size a 4-8 GB executor core sorts and aggregates without heavy spill).
    The initial shuffle width is sized for the worst case of the input
    being shuffled whole; AQE then coalesces it to the bytes actually
    shuffled (most aggregates are partial, so usually far fewer) and
    splits skewed join partitions."""
    parts = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "lookout", input_bytes: int | None = None) -> SparkSession:
    """A session configured the way the library expects: UTC, AQE on, UI off.

    On a cluster call this without ``master`` so that spark-submit decides,
    and pass ``input_bytes`` to size partitions (``cluster_conf``).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    elif input_bytes:
        for k, v in cluster_conf(input_bytes).items():
            builder = builder.config(k, v)
    if master or not input_bytes:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOKOUT_DRIVER_MEMORY", "16g"))
    )
    if master and master.startswith("local"):
        # one JVM on small test data: keep post-shuffle stages multi-task
        builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def configure(spark: SparkSession) -> SparkSession:
    """Settings every query relies on; safe to call on a driver-made session.

    Python stages (forest, folds, HMAC, stateful streaming) import this package
    inside the workers: its root is put on the PYTHONPATH that Spark hands to
    them, so it need not be the driver's working directory. (On a cluster the
    package is shipped with ``--py-files`` or installed on the executors.)"""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT] + paths)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. In local mode, where one
    machine is all there is, a scratch folder serves if it is unset; elsewhere
    that is an error, as executors would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="lookout-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCHEMAS: dict[str, object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """Read a driver table; its schema is inferred once per path and then given
    explicitly, so repeated reads in one plan skip footer inference."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def task_parallelism(spark: SparkSession, per_core: int = 4) -> int:
    """Partitions for CPU-bound Python stages: the configured shuffle partitions
    (``cluster_conf`` sizes them by the input). Only in local mode at most
    ``per_core`` for each core, so that a default of 200 doesn't mean 200
    near-empty Python tasks."""
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.split("[")[0] != "local":
        return conf
    return max(1, min(conf, per_core * spark.sparkContext.defaultParallelism))
