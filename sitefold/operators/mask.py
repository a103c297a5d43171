"""Accessible intervals as a table: ``chrom, start, end`` in BED coordinates.

An interval covers the bases start + 1 .. end (1-based). There is no dense mask:
intervals are merged, and points or windows meet them through bins of a fixed
width, an equi-join that neither broadcasts nor compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def merge(intervals: DataFrame) -> DataFrame:
    """Overlapping and adjacent intervals joined up."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    i = intervals.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("end > start")
    i = i.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    i = i.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def clip(intervals: DataFrame, low: int, high: int) -> DataFrame:
    """What lies on the 1-based bases ``[low, high)``."""
    c = intervals.select("chrom", F.greatest("start", F.lit(low - 1)).alias("start"), F.least("end", F.lit(high - 1)).alias("end"))
    return c.where("end > start")


def total(intervals: DataFrame) -> int:
    """Bases covered by merged intervals."""
    return intervals.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0


def _binned(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("bin", F.explode(F.expr(f"sequence(start div {BIN}, (end - 1) div {BIN})")))


def inside(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of ``points`` (``chrom, pos``) that lie in an interval."""
    p = points.withColumn("bin", F.expr(f"(pos - 1) div {BIN}"))
    i = _binned(intervals).select(F.col("chrom").alias("_c"), F.col("bin").alias("_b"), "start", "end")
    on = (p.chrom == i._c) & (p.bin == i._b) & (p.pos > i.start) & (p.pos <= i.end)
    return p.join(i, on, "left_semi").drop("bin")


def covered(windows: DataFrame, intervals: DataFrame) -> DataFrame:
    """``window_id, bases``: accessible bases of windows ``chrom, window_id, start, end`` over ``[start, end)``."""
    w = windows.withColumn("bin", F.explode(F.expr(f"sequence((start - 1) div {BIN}, greatest((start - 1) div {BIN}, (end - 2) div {BIN}))")))
    i = _binned(intervals).select(F.col("chrom").alias("_c"), F.col("bin").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    # each bin counts its own share, so a pair that meets in several bins isn't counted twice
    low = F.greatest(F.col("start") - 1, F.col("_s"), F.col("bin") * BIN)
    high = F.least(F.col("end") - 1, F.col("_e"), (F.col("bin") + 1) * BIN)
    j = w.join(i, (w.chrom == i._c) & (w.bin == i._b))
    return j.groupBy("window_id").agg(F.sum(F.greatest(F.lit(0), high - low)).alias("bases"))
