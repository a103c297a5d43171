"""Windowed sums of a stream of variants.

Sums of per-site terms are additive, so a stream of variants (in files that arrive
as they are called) keeps one row of state per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import VARIANTS, Panel


def read_variant_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Variants from Parquet files as they appear in a folder."""
    r = spark.readStream.schema(VARIANTS)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def windowed_sums(variants: DataFrame, individual, window_size: int, population=None) -> DataFrame:
    """``chrom, window, sites, segregating, pi`` (a sum over sites) of tumbling windows, for batch or stream."""
    sc = Panel(variants, individual=tuple(individual)).site_counts(population)
    n, d = F.col("n0").cast("double"), F.col("d0").cast("double")
    seg = (n >= 2) & (d > 0) & (d < n)
    return sc.groupBy("chrom", F.floor(F.col("pos") / window_size).cast("long").alias("window")).agg(F.count("*").alias("sites"), F.count_if(seg).alias("segregating"), F.sum(F.when(seg, F.try_divide(2 * d * (n - d), n * (n - 1))).otherwise(0.0)).alias("pi"))
