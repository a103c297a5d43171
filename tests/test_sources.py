import numpy as np
import pytest

from sitefold.operators import diversity
from sitefold.operators.panel import VARIANTS, Panel
from sitefold.sources import arrays, text
from sitefold.streaming import windows as stream

VCF = """##fileformat=VCFv4.2
##contig=<ID=1>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1
1\t100\t.\tA\tC\t.\t.\t.\tGT\t1|1\t0|1
1\t200\t.\tA\tC\t.\t.\t.\tDP:GT\t3:1|0\t4:./.
2\t50\t.\tA\tC\t.\t.\t.\tGT\t0/1\t0|0
"""


@pytest.fixture
def vcf(tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text(VCF)
    return str(p)


def test_vcf(spark, vcf, tmp_path):
    p = text.read_vcf(spark, vcf)
    h, pos, chrom = p.to_numpy()
    assert chrom == ["1", "1", "2"] and pos.tolist() == [100, 200, 50]
    assert h.T.tolist() == [[1, 1, 0, 1], [1, 0, -1, -1], [0, 1, 0, 0]]
    r = text.read_vcf(spark, vcf, region="1:100-150", samples=["s1"])
    assert r.to_numpy()[0].T.tolist() == [[0, 1]] and (r.chrom_start, r.chrom_end) == (100, 150)
    pops = tmp_path / "pops.txt"
    pops.write_text("sample pop\ns0 x\ns1\ty\nother z\n")
    q = text.load_pop_file(p, str(pops))
    assert dict(q.pops) == {"x": (0, 1), "y": (2, 3)}
    text.vcf_to_store(spark, vcf, str(tmp_path / "store"))
    assert text.read_panel(spark, str(tmp_path / "store"), p.individual).num_variants == 3


def test_bed_and_map(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("# c\ntrack name=x\nbrowser y\n\n1\t0\t10\textra\n1 20 30\n2\t5\t6\n")
    assert sorted(tuple(r) for r in text.read_bed(spark, str(bed)).collect()) == [("1", 0, 10), ("1", 20, 30), ("2", 5, 6)]
    assert text.read_bed(spark, str(bed), "2").count() == 1
    m = tmp_path / "map.txt"
    m.write_text("pos cM\n0 0\n100 1.5\n")
    assert text.read_map(spark, str(m)) == [(0.0, 0.0), (100.0, 1.5)]
    with pytest.raises(ValueError):
        text.parse_region("1:20-10")


@pytest.mark.parametrize("layout", ["vcz", "flat"])
def test_array_stores_round_trip(spark, tmp_path, layout, monkeypatch):
    rng = np.random.default_rng(0)
    h = rng.integers(-1, 2, (6, 25)).astype(np.int8)
    p = Panel.from_numpy(spark, h, np.arange(25) * 10 + 1, samples=("a", "b", "c"))
    path = str(tmp_path / "s")
    arrays.write_store(p, path, layout)
    assert arrays.detect_layout(path) == layout
    q = arrays.read_store(spark, path)
    assert (q.to_numpy()[0] == h).all() and q.samples == ("a", "b", "c")
    assert arrays.read_store(spark, path, "1:11-31").num_variants == 3
    with pytest.raises(ValueError):
        arrays.write_store(p, path, "other")


def test_chunks_and_parts_of_arrays(tmp_path):
    x = np.arange(70).reshape(35, 2)
    arrays.write_array(str(tmp_path / "x"), x, 8)
    assert (arrays.read_array(str(tmp_path / "x")) == x).all()
    assert (arrays.read_array(str(tmp_path / "x"), slice(5, 19)) == x[5:19]).all()


def test_grouped_store_needs_a_region(spark, tmp_path):
    p = Panel.from_numpy(spark, [[0, 1], [1, 1]], [5, 9])
    arrays.write_store(p, str(tmp_path / "g" / "7"), "flat")
    assert arrays.detect_layout(str(tmp_path / "g")) == "grouped"
    assert arrays.read_store(spark, str(tmp_path / "g"), "7:1-6").num_variants == 1
    with pytest.raises(ValueError):
        arrays.read_store(spark, str(tmp_path / "g"))


def test_panel_store_prunes(spark, tmp_path):
    p = Panel.from_numpy(spark, [[0, 1, 1], [1, 1, 0]], [5, 9, 4], chrom=["1", "1", "2"])
    text.write_panel(p, str(tmp_path / "p"))
    q = text.read_panel(spark, str(tmp_path / "p"), p.individual)
    plan = q.between(1, 6, "1").variants._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "PushedFilters: [IsNotNull(pos)" in plan
    assert q.between(1, 6, "1").num_variants == 1


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2, (8, 60)).astype(np.int8)
    p = Panel.from_numpy(spark, h, np.arange(60) * 50)
    src = str(tmp_path / "in")
    p.variants.repartition(4).write.parquet(src)
    q = stream.windowed_sums(stream.read_variant_stream(spark, src, 1), p.individual, 1000)
    query = q.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.window, r.sites, round(r.pi, 9)) for r in spark.table("sums").collect())
    want = sorted((r.window, r.sites, round(r.pi, 9)) for r in stream.windowed_sums(p.variants, p.individual, 1000).collect())
    assert got == want and abs(sum(x[2] for x in got) - diversity.pi(p, span_normalize=False)) < 1e-6


def test_command_line(spark, vcf, tmp_path):
    from sitefold import api, cli

    pops = tmp_path / "pops.txt"
    pops.write_text("sample pop\ns0 x\ns1 y\n")
    cli.main(["scan", vcf, str(tmp_path / "out"), "--pops", str(pops), "--window", "100", "--region", "1:1-300"])
    w = spark.read.parquet(str(tmp_path / "out" / "windows"))
    assert w.count() == 3 and {"pi", "fst", "garud_h1"} <= set(w.columns)
    scalars = {(r.population, r.statistic): r.value for r in spark.read.parquet(str(tmp_path / "out" / "scalars")).collect()}
    assert scalars["x", "segregating_sites"] == 1 and ("x,y", "dxy") in scalars
    cli.main(["convert", vcf, str(tmp_path / "store")])
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    assert callable(api.ihs) and callable(api.lostruct)
