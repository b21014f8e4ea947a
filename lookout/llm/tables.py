"""Written tables of one run, for what is read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lookout.session import ensure_checkpoint_dir


class Tables:
    """Parquet tables in a folder of the run's own below the shared checkpoint
    folder. ``put`` writes a table and returns it as read back, so that its lineage
    is cut and any executor can be lost; the table of the same name that it follows
    goes when it is complete. Frames that still read that one must not be used
    after it. Reading packs small files, so small tables make few tasks."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.written = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.folder}/{name}-{self.written}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables, as far as they are there."""
        jvm = self.spark.sparkContext._jvm
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep_only(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])
