"""What the operators of this subpackage share: the cluster's shared folder, stored tables, worker set-up."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Python workers give Arrow's buffers back to the system as soon as they are free.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system"}
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is installed as a plain folder, and keep their memory small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for k, v in WORKERS.items():
        env.setdefault(k, v)
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:  # of a batch for a worker; has no influence on results
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and the session is local
    (tests), a new one; on a cluster it is an error, as a folder of the driver's is not seen by the executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="castlake-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """df written as a table in the shared folder (or one below it) and read again: cuts the lineage, and survives lost
    executors."""
    spark = df.sparkSession
    path = f"{under or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more, and lets Spark drop the shuffle files behind them (it does
    so once the driver's references are collected)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables of one run, dropped at its end."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        dropped(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most limit bytes together; a longer text is a range of its own."""
    n, begin, total = len(texts), 0, 0
    for i in range(n):
        size = len(texts[i].as_buffer()) if texts[i].is_valid else 0
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < n:
        yield begin, n
