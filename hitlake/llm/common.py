"""What the corpus operators share: scratch tables in the shared folder, Arrow kernels and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows that a kernel works on at once; Spark's Arrow batches are cut to this.
ROWS_AT_ONCE = 1024
#: Bytes of an Arrow batch between Spark and its workers. Spark's own bound of 64 MB, held several
#: times over on both sides for each running task, is much of a small executor.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and small Arrow batches unless the session sets its own."""
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


_memos: list[dict] = []


def memo() -> dict:
    """A table that a worker fills while it works on a partition, and empties at its end."""
    _memos.append({})
    return _memos[-1]


def give_back() -> None:
    """A worker's memos, and memory it has freed, go back to the system: idle workers live on beside busy ones."""
    for own in _memos:
        own.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation of what came before.

    Each is removed by drop(), or else when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _path(self, where: str, act: Callable) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(sc._jvm.org.apache.hadoop.fs.Path(self.root))
        act(fs, path)

    def save(self, df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{part}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of what is now written
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{part}")

    def drop(self, part: str) -> None:
        self._path(f"{self.root}/{part}", lambda fs, path: fs.delete(path, True))


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a kernel from a batch of at most ROWS_AT_ONCE rows to columns in the order of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    prepare(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = kernel(batch.slice(at, ROWS_AT_ONCE))
                if out is not None:
                    yield pa.record_batch([pa.array(out[f.name], f.type, from_pandas=False) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_rows(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], more: str = "") -> DataFrame:
    """mapInArrow that passes rows with all their columns through a kernel, which may drop rows or add the columns in `more`."""
    from pyspark.sql.types import StructType

    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield kernel(batch.slice(at, ROWS_AT_ONCE))
        give_back()

    return df.mapInArrow(run, StructType([*df.schema, *(StructType.fromDDL(more) if more else [])]))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def bucketed(columns: list[Column], seed: int) -> Column:
    """A number from 0 to 1 that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))
