"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and everything runs in one process (local tests) a temporary folder is made
    and remembered in the session.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            given = kept.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            given = tempfile.mkdtemp(prefix="sitefold-")
        else:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Parquet in the shared folder survives the loss of any executor, and later
    jobs read only the columns they need. The table goes when the application
    ends, or by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing still to run reads."""
    for t in tables:
        fs, p = _hadoop(t.sparkSession, t._cut_path)
        fs.delete(p, True)


#: Rows' bytes up to which a table is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(table_: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if its counted rows are within ``most`` bytes. Give it a table made by :func:`cut`."""
    return F.broadcast(table_) if table_.count() * row_bytes <= most else table_


def unused(columns, name: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z and nothing else (unlike ``lower``, which is Unicode-wide)."""
    return F.translate(col, UPPER, LOWER)


def worker(run):
    """Has a task's Python worker, which outlives the task, give back the memory it took."""

    @functools.wraps(run)
    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return task


#: Rows and bytes of whole texts that go to a Python worker at once. Arrow buffers lie outside
#: the heap, in the executor and again in the worker.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the batch sizes, and lets workers find this package where the driver does."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
