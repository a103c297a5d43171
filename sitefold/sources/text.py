"""Text sources: VCF, population files, BED and genetic maps.

A VCF is read as lines in parallel; header lines only give the sample names. The
genotype fields of a batch of lines are decoded together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import VARIANTS, Panel, lists


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """``chrom``, or ``chrom:start-end``, 1-based and inclusive."""
    chrom, colon, span = region.partition(":")
    if not colon:
        return chrom, None, None
    low, dash, high = span.replace(",", "").partition("-")
    if not dash or int(low) > int(high):
        raise ValueError(f"bad region {region!r}")
    return chrom, int(low), int(high)


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not line:
        raise ValueError(f"{path} has no #CHROM line")
    return line[0].value.split("\t")[9:]


def _decode(call: str) -> tuple[int, int]:
    """Two alleles of a GT field; -1 where missing. A haploid call fills the first."""
    a, _, b = call.replace("|", "/").partition("/")
    return (int(a) if a.isdigit() else -1), (int(b) if b.isdigit() else -1)


def read_vcf(spark: SparkSession, path: str, region: str | None = None, samples: Sequence[str] | None = None, include_invariant: bool = False, accessible_bed: str | None = None) -> Panel:
    """Phased genotypes of a VCF (plain or compressed text).

    A region bounds positions and sets the panel's bounds; haplotypes of an individual
    lie next to each other. ``include_invariant`` counts every record as callable.
    """
    names = vcf_samples(spark, path)
    picked = [names.index(s) for s in samples] if samples is not None else list(range(len(names)))
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    head = F.split(F.substring_index("value", "\t", 2), "\t")
    v = lines.select(head[0].alias("chrom"), head[1].cast("long").alias("pos"), "value")
    low = high = None
    if region is not None:
        chrom, low, high = parse_region(region)
        v = v.where(F.col("chrom") == chrom)
        if low is not None:
            v = v.where(F.col("pos").between(low, high))

    def parse(batches):
        cache: dict[str, tuple[int, int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = []
                for line in part.column("value").to_pylist():
                    f = line.rstrip("\n").split("\t")
                    keys = f[8].split(":")
                    k = keys.index("GT") if "GT" in keys else -1
                    calls = []
                    for i in picked:
                        gt = f[9 + i].split(":")[k] if k >= 0 else "./."
                        if gt not in cache:
                            cache[gt] = _decode(gt)
                        calls.extend(cache[gt])
                    rows.append(calls)
                m = np.array(rows, np.int8).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays([part.column("chrom"), part.column("pos"), lists(m)], ["chrom", "pos", "alleles"])

    out = Panel(v.mapInArrow(parse, VARIANTS), individual=tuple(i // 2 for i in range(2 * len(picked))), samples=tuple(names[i] for i in picked), chrom_start=low, chrom_end=high)
    if include_invariant:
        out = replace(out, n_total_sites=out.num_variants)
    return out if accessible_bed is None else out.set_accessible_mask(read_bed(spark, accessible_bed), None if region is None else parse_region(region)[0])


def load_pop_file(panel: Panel, path: str, pops: Sequence[str] | None = None) -> Panel:
    """Populations from a text file of ``sample pop`` lines, whose first line is a header."""
    if panel.samples is None:
        raise ValueError("the panel has no sample names")
    rows = [r.value.split() for r in panel.spark.read.text(path).where(F.trim("value") != "").collect()][1:]
    at = {s: i for i, s in enumerate(panel.samples)}
    found: dict[str, list[int]] = {}
    for sample, pop, *_ in rows:
        if sample in at and (pops is None or pop in pops):
            found.setdefault(pop, []).extend((2 * at[sample], 2 * at[sample] + 1))
    if not found:
        raise ValueError("no sample of the file is in the panel")
    return replace(panel, pops={p: tuple(c) for p, c in found.items()})


def read_bed(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """``chrom, start, end``; blank, comment, track and browser lines are skipped, tabs or spaces separate."""
    t = spark.read.text(path).where(~F.trim("value").rlike(r"^(#|track\b|browser\b|$)"))
    f = F.split(F.trim("value"), r"\t|\s+")
    out = t.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    return out if chrom is None else out.where(F.col("chrom") == chrom)


def read_map(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """Knots (position, centimorgans) of a text file; lines that aren't numbers are skipped."""
    out = []
    for r in spark.read.text(path).collect():
        try:
            x = [float(v) for v in r.value.split()[:2]]
        except ValueError:
            continue
        if len(x) == 2:
            out.append((x[0], x[1]))
    return out


def write_panel(panel: Panel, path: str) -> None:
    """Parquet by chromosome: scans prune by chromosome and, by statistics, by position."""
    panel.variants.select("chrom", "pos", "alleles").repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def read_panel(spark: SparkSession, path: str, individual: Sequence[int], **kwargs) -> Panel:
    v = spark.read.option("basePath", path).schema("pos long, alleles array<tinyint>, chrom string").parquet(path)
    return Panel(v.select("chrom", "pos", "alleles"), individual=tuple(individual), **kwargs)


def vcf_to_store(spark: SparkSession, vcf_paths, path: str) -> None:
    """VCF files to one Parquet store; tasks take the place of worker processes."""
    for p in [vcf_paths] if isinstance(vcf_paths, str) else vcf_paths:
        read_vcf(spark, p).variants.write.mode("append").partitionBy("chrom").parquet(path)
