"""What several corpus operators share: written intermediate tables, size-checked broadcasts, reading."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Folders written and not yet deleted, in order.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    The folder goes with ``freed`` or ``scratch``, or when the application ends. Shuffle files of what came before can
    then be freed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _made.append(path)
    gc.collect()
    jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.remove(path)


def freed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned. Only for those whose every reader has been written itself."""
    for df in tables:
        if getattr(df, "_written_at", None) in _made:
            _delete(df.sparkSession, df._written_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is written inside, but for the tables passed to the function it gives (they are returned)."""
    before, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_written_at", None))
        return df

    yield keep
    for path in [p for p in _made[before:] if p not in kept]:
        _delete(spark, path)


#: Rows of 8-byte keys that may be broadcast; beyond it the keys are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def frugal(kernel: Callable) -> Callable:
    """An Arrow kernel that takes at most 1,024 rows at a time and gives freed memory back at the end of its task.

    Spark keeps Python workers for later tasks; without this each would hold the most memory it ever had.
    """

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch], *args, **named) -> Iterator[pa.RecordBatch]:
        pieces = (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024))
        yield from kernel(pieces, *args, **named)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (one column, distinct): broadcast when counted small, else a shuffle join."""
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys.hint("shuffle_merge"), key, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
