"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read again: what comes behind doesn't compute it twice, lost executors or not. It goes when the driver ends."""
    spark, where = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


class Tables:
    """Tables of a loop in the shared folder, each of which can go before the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._paths[id(out)] = where, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Tables that nothing reads any more; Spark's cleaner then drops the shuffle files of what they were made by, too."""
        for table in tables:
            where, _ = self._paths.pop(id(table))
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where), True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *tables: DataFrame) -> None:
        """Drops all others."""
        self.drop(*(t for _, t in list(self._paths.values()) if not any(t is own for own in tables)))
