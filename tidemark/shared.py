"""The folder that driver and executors share, and intermediate tables stored there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only on a local master, where that may
    be unset, a temporary folder takes its place; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends there."""
    return _written(df, work_dir(df.sparkSession, label))


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the rows, and lets Spark delete the write's shuffle files when it ends: else they stay until the driver
    happens to collect its garbage, and add up over the tables that a query writes."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only the building of a result reads: stored in one folder, which `drop` deletes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, work_dir(spark, label)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        return _written(df, f"{self.path}/{label}-{uuid.uuid4().hex}")

    def counted(self, df: DataFrame, label: str, condition: Column | None = None) -> tuple[DataFrame, int]:
        """The stored rows, and how many of them there are, or meet the condition: counted while they are written."""
        seen = Observation()
        n = F.count(F.lit(1)) if condition is None else F.count(F.when(condition, F.lit(1)))
        return self.stored(df.observe(seen, n.alias("n")), label), seen.get["n"]

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
