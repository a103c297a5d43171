"""spark-submit ... sitefold/cli.py scan VCF OUT [--pops FILE] [--window N] [--step N] [--bed FILE], or convert VCF OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    from sitefold import api

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("scan", "convert"))
    p.add_argument("vcf")
    p.add_argument("out")
    p.add_argument("--pops")
    p.add_argument("--bed")
    p.add_argument("--region")
    p.add_argument("--window", type=int, default=50_000)
    p.add_argument("--step", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        api.vcf_to_store(spark, a.vcf, a.out)
        return
    panel = api.read_vcf(spark, a.vcf, a.region)
    if a.pops:
        panel = api.load_pop_file(panel, a.pops)
    if a.bed:
        panel = panel.set_accessible_mask(api.read_bed(spark, a.bed))
    names = list(panel.pops)
    one = ("pi", "theta_w", "tajimas_d", "segregating_sites", "garud_h1", "garud_h12", "haplotype_count")
    two = ("fst", "dxy", "da") if len(names) > 1 else ()
    api.windowed_analysis(panel, a.window, a.step, one + two, names).write.mode("overwrite").parquet(f"{a.out}/windows")
    rows = []
    for name in names:
        s = api.diversity_stats(panel, name, ("pi", "theta_w", "tajimas_d", "segregating_sites", "singletons"))
        rows += [(name, k, float(v)) for k, v in s.items()]
    for i, x in enumerate(names):
        for y in names[:i]:
            rows += [(f"{y},{x}", k, float(v)) for k, v in api.divergence_stats(panel, y, x, ("fst", "dxy", "da")).items()]
    spark.createDataFrame(rows, "population string, statistic string, value double").write.mode("overwrite").parquet(f"{a.out}/scalars")
    from sitefold.operators.sfs import sfs_table

    for k, name in enumerate(names):
        sfs_table(panel, name).write.mode("overwrite").parquet(f"{a.out}/sfs/{k}-{name}")


if __name__ == "__main__":
    main()
