"""Cutting lineage with a table in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; a temporary folder, one for the session, only where that is unset and all runs in one process, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sitefold-"))
    return context.getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once and read back; it survives lost executors and goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/keep-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
