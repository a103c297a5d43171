import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.operators import decomposition, distance, divergence, diversity, fstats, haplotypes, ld, mask, moments, panel, relatedness, resampling, scans, sfs, windows
from sitefold.operators.panel import Panel


def matrix(n_hap=12, n_var=40, missing=0.0, seed=1):
    rng = np.random.default_rng(seed)
    h = (rng.random((n_hap, n_var)) < rng.random(n_var)).astype(np.int8)
    h[rng.random(h.shape) < missing] = -1
    return h, np.cumsum(rng.integers(1, 300, n_var))


@pytest.fixture(scope="module")
def complete(spark):
    h, pos = matrix()
    return Panel.from_numpy(spark, h, pos, partitions=3, pops={"a": tuple(range(6)), "b": tuple(range(6, 12))}), h, pos


@pytest.fixture(scope="module")
def holes(spark):
    h, pos = matrix(missing=0.2, seed=2)
    return Panel.from_numpy(spark, h, pos, partitions=3, pops={"a": tuple(range(6)), "b": tuple(range(6, 12))}), h, pos


def test_panel_round_trip_and_errors(spark, holes):
    p, h, pos = holes
    back, at, _ = p.to_numpy()
    assert (back == h).all() and (at == pos).all() and p.shape == h.shape
    for bad in (np.zeros((0, 0)), np.zeros(3)):
        with pytest.raises(ValueError):
            Panel.from_numpy(spark, bad, [])
    with pytest.raises(ValueError):
        p.columns("nobody")
    with pytest.raises(ValueError):
        p.get_span("accessible")
    assert p.get_span() == pos[-1] - pos[0] + 1


def test_subsets_and_missing_counts(holes):
    p, h, pos = holes
    assert (p.subset([3, 1, 7]).to_numpy()[1] == pos[[1, 3, 7]]).all()
    lo, hi = int(pos[5]), int(pos[10])
    assert (p.between(lo, hi).to_numpy()[1] == pos[5:10]).all()
    assert (p.count_missing(1) == (h < 0).sum(axis=1)).all() and p.count_missing() == (h < 0).sum()
    assert p.count_called() == (h >= 0).sum() and (p.is_called(1) == (h >= 0).all(axis=1)).all()
    assert p.is_missing().where("missing").count() == (h < 0).sum()
    assert p.exclude_missing_sites(["a"]).num_variants == (h[:6] >= 0).all(axis=0).sum()
    assert (p.population("b").to_numpy()[0] == h[6:]).all()
    assert p.calls().where("allele > 0").count() == (h > 0).sum()


def test_dosages_go_both_ways(holes):
    p, h, _ = holes
    g = panel.dosages(p)
    want = np.where((h[0::2] < 0) | (h[1::2] < 0), -1, (h[0::2] > 0).astype(int) + (h[1::2] > 0))
    got = np.array([r.g for r in g.orderBy("pos").collect()]).T
    assert (got == want).all()
    again = panel.dosages(panel.from_dosages(g, len(want)))
    assert (np.array([r.g for r in again.orderBy("pos").collect()]).T == want).all()


def direct_thetas(h):
    out = dict.fromkeys(("pi", "watterson", "theta_h", "theta_l"), 0.0)
    s = 0
    for col in h.T:
        n, d = (col >= 0).sum(), (col > 0).sum()
        if n >= 2 and 0 < d < n:
            s += 1
            out["pi"] += 2 * d * (n - d) / (n * (n - 1))
            out["watterson"] += 1 / sum(1 / i for i in range(1, n))
            out["theta_h"] += 2 * d * d / (n * (n - 1))
            out["theta_l"] += d / (n - 1)
    return out, s


@pytest.mark.parametrize("pop", [None, "a"])
def test_diversity_with_missing_calls(holes, pop):
    p, h, _ = holes
    want, s = direct_thetas(h if pop is None else h[:6])
    assert diversity.segregating_sites(p, pop) == s
    for name, f in (("pi", diversity.pi), ("watterson", diversity.theta_w), ("theta_h", diversity.theta_h), ("theta_l", diversity.theta_l)):
        assert math.isclose(f(p, pop, False), want[name], rel_tol=1e-12)
    assert math.isclose(diversity.pi(p, pop), want["pi"] / p.get_span(), rel_tol=1e-12)
    d, h_ = diversity.tajimas_d(p, pop), diversity.fay_wus_h(p, pop)
    assert diversity.zeng_dh(p, pop) == (d * h_ if d < 0 and h_ < 0 else 0.0)
    ex = h if pop is None else h[:6]
    full = ex[:, (ex >= 0).all(axis=0)]
    assert math.isclose(diversity.pi(p, pop, False, "exclude"), direct_thetas(full)[0]["pi"], abs_tol=1e-12)


def test_frequency_spectrum(holes):
    p, h, _ = holes
    fs = diversity.FrequencySpectrum(p)
    assert fs.n_sites == h.shape[1] and math.isclose(fs.theta(lambda n: diversity.weight_vector("pi", n)), fs.theta("pi"))
    n = fs.suggest_projection_n(0.5)
    assert fs.project(n).sum() <= fs.n_sites and set(fs.all_tests()) == {"tajimas_d", "fay_wu_h", "normalized_fay_wu_h", "zeng_e"}
    padded = diversity.FrequencySpectrum(p, n_total_sites=1000)
    assert sum(s.sum() for s in padded.sfs_by_n.values()) == 1000
    assert (sfs.sfs(p) == diversity.allele_frequency_spectrum(p)[: len(sfs.sfs(p))]).all()


def test_spectra(complete):
    p, h, _ = complete
    d = h.sum(axis=0)
    assert (sfs.sfs(p) == np.bincount(d, minlength=13)).all()
    assert (sfs.sfs_folded(p) == np.bincount(np.minimum(d, 12 - d), minlength=7)).all()
    j = sfs.joint_sfs(p, "a", "b")
    assert j.sum() == 40 and (j.sum(axis=1) == np.bincount(h[:6].sum(axis=0), minlength=7)).all()
    assert (sfs.sfs_scaled(p) == sfs.sfs(p) * np.arange(13)).all()
    assert sfs.fold_sfs([1, 2, 3, 4, 5, 6], 5).tolist() == [7, 7, 7]
    assert sfs.fold_sfs([1, 2, 3, 4, 5], 4).tolist() == [1 + 4, 2 + 3]
    assert sfs.fold_joint_sfs(np.ones((6, 6)), 5, 5).sum() == 36


def test_divergence_by_hand(spark):
    p = Panel.from_numpy(spark, [[0, 0], [0, 1], [1, 1], [1, 1]], [10, 20], pops={"x": (0, 1), "y": (2, 3)})
    # p1 = 0, .5 and p2 = 1, 1
    assert math.isclose(divergence.dxy(p, "x", "y", span_normalize=False), (1 + 0.5) / 2)
    assert math.isclose(divergence.fst_hudson(p, "x", "y"), (0.5 + 0.25 - 0.25) / (0.5 + 0.25))
    assert divergence.fst_hudson(p, "x", "x") <= 0
    m, names = divergence.pairwise_fst(p)
    assert m[0, 1] == m[1, 0] == divergence.fst_hudson(p, "x", "y") and names == ["x", "y"]
    same = Panel.from_numpy(spark, [[1], [1], [1], [1]], [5], pops={"x": (0, 1), "y": (2, 3)})
    assert divergence.fst_hudson(same, "x", "y") == 0.0
    s = divergence.distance_based_stats(p, "x", "y")
    assert s["dxy_min"] == 1 and s["snn"] == 1.0 - 0 or 0 <= s["snn"] <= 1


def test_f_statistics_and_resampling(spark):
    h, pos = matrix(20, 60, 0.1, 5)
    p = Panel.from_numpy(spark, h, pos, pops={k: tuple(range(5 * i, 5 * i + 5)) for i, k in enumerate("abcd")})
    f3, se, z, vb, vj = fstats.average_patterson_f3(p, "c", "a", "b", 10)
    assert len(vb) == len(vj) == 6 and math.isclose(z, f3 / se)
    t = fstats.patterson_f3(p, "c", "a", "b").orderBy("pos").toPandas()
    ok = ~(t.t.isna() | t.b.isna())
    assert math.isclose(f3, t.t[ok].sum() / t.b[ok].sum(), rel_tol=1e-9)
    v = np.array([1.0, 4.0, 2.0, 7.0])
    est, err, _ = resampling.block_jackknife(v, np.mean)
    assert math.isclose(est, v.mean()) and math.isclose(err, v.std(ddof=1) / 2)
    est, err2, _ = resampling.block_jackknife(v, np.mean, weights=np.ones(4))
    assert math.isclose(err2, err, rel_tol=1e-9)
    with pytest.raises(ValueError):
        resampling.block_jackknife(v, np.mean, weights=[1, 1, 0, 1])
    a, b = (resampling.block_bootstrap(v, np.mean, n_replicates=50, rng=3) for _ in "ab")
    assert a[1] == b[1] and len(a[2]) == 50


@pytest.mark.parametrize("width", [1, 150, 1000, 100_000])
def test_pairs_are_all_pairs_once(holes, width):
    p, h, pos = holes
    got = {(r.pos_i, r.pos_j): (r.n11, r.n10, r.n01, r.n00) for r in ld.pairs(p, width).collect()}
    want = {}
    for i in range(len(pos)):
        for j in range(i + 1, len(pos)):
            if pos[j] - pos[i] <= width:
                a, b = h[:, i], h[:, j]
                ok = (a >= 0) & (b >= 0)
                want[pos[i], pos[j]] = tuple(int(((a[ok] > 0) == x)[((b[ok] > 0) == y)].sum()) for x in (1, 0) for y in (1, 0))
    assert got == want
    if width == 100_000:
        assert {(r.pos_i, r.pos_j) for r in ld.pairs(p).collect()} == set(want)


def test_linkage_summaries(complete):
    p, h, pos = complete
    seg = (h.sum(axis=0) > 0) & (h.sum(axis=0) < 12)
    r2 = np.corrcoef(h[:, seg].T) ** 2
    assert math.isclose(ld.zns(p, estimator="r2"), r2[np.triu_indices(len(r2), 1)].mean(), rel_tol=1e-6)
    m = ld.ld_matrix(p, estimator="r2")
    assert np.allclose(m + np.eye(len(m)), r2)
    k = len(r2)
    best = 0
    for s in range(3, k - 1):
        left, right, cross = m[:s, :s], m[s:, s:], m[:s, s:]
        within = (left.sum() + right.sum()) / 2 / (s * (s - 1) / 2 + (k - s) * (k - s - 1) / 2)
        best = max(best, within / cross.mean())
    assert math.isclose(ld.omega(p, estimator="r2"), best, rel_tol=1e-6)
    long = {(r.pos_i, r.pos_j): r.r2 for r in ld.pairwise_r2(p).collect()}
    at = pos[seg]
    assert math.isclose(long[at[0], at[3]], r2[0, 3], rel_tol=1e-6)
    kept = ld.locate_unlinked(p, 20, 5, 0.2)
    assert kept.dtype == bool and 0 < kept.sum() < len(kept)
    v = ld.windowed_r_squared(p, [0, 500, 2000], [50]).orderBy("bin").collect()
    near = [r2[i, j] for i in range(k) for j in range(i + 1, k) if at[j] - at[i] < 500]
    assert math.isclose(v[0].p50, np.percentile(near, 50), rel_tol=1e-6) and v[0].pairs == len(near)


def test_two_locus_sums_by_recombination_equal_those_by_distance(complete):
    p, *_ = complete
    a = moments.compute_ld_statistics(p, ["a", "b"], bp_bins=[0, 300, 1000])
    b = moments.compute_ld_statistics(p, ["a", "b"], r_bins=[0, 3e-6, 1e-5], genetic_map=[(0, 0.0), (1_000_000, 1.0)])
    for x, y in zip(a["sums"], b["sums"]):
        assert np.allclose(x, y)
    assert len(a["stats"][0]) == 15 and len(a["sums"]) == 3
    g = moments.compute_ld_statistics(p, ["a"], bp_bins=[0, 1000], use_genotypes=True)
    assert len(g["sums"][0]) == 3
    with pytest.raises(ValueError):
        moments.compute_ld_statistics(p, ["a"], r_bins=[0, 1])


def test_haplotype_identity(spark):
    h = np.array([[0, 0, 1], [0, 0, 1], [0, 1, 1], [1, 1, 0]])
    p = Panel.from_numpy(spark, h, [1, 2, 3], partitions=2)
    assert diversity.haplotype_count(p) == 3 and math.isclose(diversity.haplotype_diversity(p), (1 - (0.25 + 2 / 16)) * 4 / 3)
    h1, h12, h123, h2 = haplotypes.garud_h(p)
    assert math.isclose(h1, 0.375) and math.isclose(h12, 0.75**2 + 1 / 16) and math.isclose(h123, 1.0) and math.isclose(h2, 0.125 / 0.375)
    # a missing call agrees with the first haplotype it can
    assert haplotypes.cluster_labels(np.array([[0, -1], [0, 1], [0, 0], [1, 1]])).tolist() == [0, 0, 1, 2]
    assert ld.mu_ld_of(np.array([[0, 0, 1, 1], [0, 0, 1, 1]])) == 1.0


def brute_runs(h, v):
    n = h.shape[0]
    out = {}
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while k <= v and not (h[i, v - k] != h[j, v - k] and h[i, v - k] >= 0 and h[j, v - k] >= 0):
                k += 1
            out[i, j] = k
    return out


@pytest.mark.parametrize(("missing", "segment", "edges"), [(0.0, 1_024, True), (0.15, 8, True), (0.15, 8, False)])
def test_nsl_and_ihs_by_brute_force(spark, missing, segment, edges, monkeypatch):
    for name, x in (("SEGMENT", segment), ("BLOCK", 24), ("BLOCKS_PER_TASK", 2)):
        monkeypatch.setattr(scans, name, x)
    h, pos = matrix(8, 25, missing, 7)
    if not edges:  # a pair that never differs, so its run passes several segments
        h[1] = h[0]
    p = Panel.from_numpy(spark, h, pos)
    got = {r.pos: r.nsl for r in scans.nsl(p).collect()}
    ihs = {r.pos: r.ihs for r in scans.ihs(p, include_edges=edges, min_maf=0.0).collect()}
    back = h[:, ::-1]
    gaps = np.diff(pos).astype(float)
    for v in range(25):
        sl, area = {0: 0.0, 1: 0.0}, {0: 0.0, 1: 0.0}
        for allele in (0, 1):
            for m, at, g in ((h, v, gaps[:v][::-1]), (back, 24 - v, gaps[v:])):
                runs = [k for (i, j), k in brute_runs(m, at).items() if m[i, at] == m[j, at] == allele]
                sl[allele] += np.mean(runs) if runs else np.nan
                n = len(runs)
                if not n:
                    area[allele] = np.nan
                    continue
                ehh = [sum(r > k for r in runs) / n for k in range(len(g) + 1)]
                for k in range(1, len(g) + 1):
                    area[allele] += g[k - 1] * (ehh[k] + ehh[k - 1]) / 2
                    if ehh[k] <= 0.05:
                        break
                else:
                    area[allele] += 0.0 if edges or ehh[0] <= 0.05 else np.nan
        with np.errstate(all="ignore"):
            for found, want in ((got[pos[v]], np.log(sl[1] / sl[0])), (ihs[pos[v]], np.log(area[1] / area[0]))):
                assert np.isnan(found) and not np.isfinite(want) or math.isclose(found, want, rel_tol=1e-9, abs_tol=1e-12)


def test_gaps_edges_and_blocks_of_pairs(spark, monkeypatch):
    assert scans.gaps_between([1, 11, 50_011, 300_000]).tolist() == [10, 20_000, -1]
    assert scans.gaps_between([1, 101], accessible=[(0, 50)]).tolist() == [50]
    h, pos = matrix(9, 20, 0.0, 3)
    p = Panel.from_numpy(spark, h, pos, pops={"a": (0, 1, 2, 3), "b": (4, 5, 6, 7, 8)})
    whole = {r.pos: r.nsl for r in scans.nsl(p).collect()}
    monkeypatch.setattr(scans, "BLOCK", 20)
    parts = {r.pos: r.nsl for r in scans.nsl(p).collect()}
    assert all(np.isnan(whole[k]) and np.isnan(parts[k]) or math.isclose(whole[k], parts[k], rel_tol=1e-12) for k in whole)
    assert scans.xpnsl(p, "a", "b").count() == scans.xpehh(p, "a", "b").count() == 20
    e = scans.ehh_decay(p)
    assert len(e) == 20 and (np.diff(e) <= 0).all() and len(scans.ehh_decay(p, truncate=True)) <= 20


def test_standard_scores():
    x = np.array([1.0, 2.0, np.nan, 3.0])
    assert np.isclose(np.nanmean(scans.standardize(x)), 0) and np.isclose(np.nanstd(scans.standardize(x)), 1)
    z, edges = scans.standardize_by_allele_count(np.arange(20.0), np.repeat([2, 4, 6, 8], 5), n_bins=4)
    assert np.isfinite(z).all() and (np.diff(edges) > 0).all()


def test_windows_overlap_are_empty_and_have_gaps(spark):
    h = np.array([[0, 1, 0, 1], [1, 1, 0, 1], [0, 0, 1, 0], [1, 0, 1, 1]])
    p = Panel.from_numpy(spark, h, [1, 12, 15, 95], chrom_start=1, chrom_end=100)
    w = windows.windowed_analysis(p, 10, statistics=("pi", "segregating_sites", "tajimas_d")).orderBy("window_id").toPandas()
    assert list(w.columns[:6]) == list(windows.PREFIX) and len(w) == 10
    assert w.n_variants.tolist() == [1, 2, 0, 0, 0, 0, 0, 0, 0, 1] and w.pi[2] == 0 and np.isnan(w.tajimas_d[0])
    assert w.end.tolist()[-1] == 100 and w.start.tolist()[:2] == [1, 11]
    over = windows.windowed_analysis(p, 10, 5, statistics=("n_variants",)).toPandas()
    assert over.n_variants.sum() == 2 * 4 - 1  # the first window's first half is in one only
    sparse = windows.windowed_analysis(p, 5, 50, statistics=("n_variants",)).toPandas()
    assert sorted(sparse.n_variants) == [0, 1]
    wa = windows.WindowedAnalyzer(window_size=10, statistics=["pi"])
    assert wa.compute(p).count() == 3 and sum(map(len, wa.compute_streaming(p, 2))) == 3


def test_windowed_callables_and_matrix_statistics(complete):
    p, h, pos = complete

    def mean_allele(m, at):
        return m.mean()

    w = windows.windowed(p, windows.WindowParams("snp", 10), ("haplotype_count", "dist_var", "daf_hist", mean_allele)).orderBy("window_id").toPandas()
    assert len(w) == 4 and np.allclose(w.mean_allele, [h[:, k : k + 10].mean() for k in range(0, 40, 10)])
    assert np.allclose(w[[f"daf_bin_{i}" for i in range(20)]].sum(axis=1), 1)
    assert w.haplotype_count[0] == len(np.unique(h[:, :10], axis=0))


def test_masks(spark):
    iv = spark.createDataFrame([("1", 0, 10), ("1", 5, 20), ("1", 100_000, 200_000), ("2", 0, 5)], "chrom string, start long, end long")
    m = mask.merge(iv)
    assert sorted(tuple(r) for r in m.collect()) == [("1", 0, 20), ("1", 100_000, 200_000), ("2", 0, 5)]
    pts = spark.createDataFrame([("1", 1), ("1", 20), ("1", 21), ("1", 150_000), ("2", 6)], "chrom string, pos long")
    assert sorted(r.pos for r in mask.inside(pts, m).collect()) == [1, 20, 150_000]
    w = spark.createDataFrame([("1", 0, 1, 31), ("1", 1, 90_001, 210_001), ("2", 2, 1, 4)], "chrom string, window_id long, start long, end long")
    assert {r.window_id: r.bases for r in mask.covered(w, m).collect()} == {0: 20, 1: 100_000, 2: 3}
    p = Panel.from_numpy(spark, [[0, 1, 1], [1, 0, 1]], [1, 50, 150_000]).set_accessible_mask(iv, "1")
    assert p.num_variants == 2 and p.get_span() == 100_020 and p.remove_accessible_mask().num_variants == 3
    with pytest.raises(ValueError):
        p.set_accessible_mask(iv, "9")


def test_distances_and_relatedness(holes):
    p, h, _ = holes
    d = distance.pairwise_diffs(p)
    k = 0
    for i in range(12):
        for j in range(i + 1, 12):
            ok = (h[i] >= 0) & (h[j] >= 0)
            assert math.isclose(d[k], (h[i][ok] != h[j][ok]).mean(), rel_tol=1e-6)
            k += 1
    e = distance.pairwise_distance(p)
    ok = (h[0] >= 0) & (h[1] >= 0)
    assert math.isclose(e[0], math.sqrt((h[0][ok] != h[1][ok]).sum() * 40 / ok.sum()), rel_tol=1e-6)
    assert len(distance.pairwise_distance(p, "hamming")) == 66 and len(distance.dist_moments(p)) == 3
    s = relatedness.ibs(p)
    assert s.shape == (6, 6) and (np.diag(s) == 1).all() and np.allclose(s, s.T)
    g = relatedness.grm(p)
    assert np.allclose(g, g.T)


def test_components(complete):
    p, h, _ = complete
    coords, share = decomposition.pca(p, 3, scaler=None)
    x = h - h.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(coords), np.abs(u[:, :3] * s[:3]), atol=1e-6) and np.allclose(share, s[:3] ** 2 / (s**2).sum())
    fast, _ = decomposition.randomized_pca(p, 3, scaler=None, n_iter=4, random_state=0)
    assert np.allclose(np.abs(fast), np.abs(coords), atol=1e-4)
    d = distance.pairwise_distance(p)
    again, _ = decomposition.pcoa(d, 3)
    assert np.allclose(np.abs(again), np.abs(coords), atol=1e-5)


def test_local_pca_and_lostruct(complete):
    p, h, _ = complete
    found = decomposition.LocalPCAResult.collect(decomposition.local_pca_jackknife(p, window_size=10, n_blocks=2))
    assert found.n_windows == 4 and found.n_samples == 12 and found.to_lostruct_matrix().shape == (4, 1 + 2 + 24)
    c = np.cov(h[:, :10] - h[:, :10].mean(axis=0))
    assert np.allclose(found.eigvals[0], np.sort(np.linalg.eigvalsh(c))[::-1][:2]) and math.isclose(found.sumsq[0], (c**2).sum())
    d = decomposition.pc_dist((found.eigvals, found.eigvecs))
    full = [np.einsum("k,ki,kj->ij", v / np.abs(v).sum(), u, u) for v, u in zip(found.eigvals, found.eigvecs)]
    assert np.allclose(d, [[np.linalg.norm(a - b) for b in full] for a in full], atol=1e-7)
    r = decomposition.lostruct(p, window_size=10, corner_prop=0.3)
    assert r.mds.shape == (4, 2) and r.corner_indices.shape[1] == 3


def test_enclosing_circle():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 30):
        x = rng.standard_normal((n, 2))
        c, r = decomposition.enclosing_circle(x)
        d = np.linalg.norm(x - c, axis=1)
        assert d.max() <= r + 1e-9 and (n == 1 or (np.abs(d - r) < 1e-6).sum() >= 2)


def test_one_pass_equals_many(holes):
    p, *_ = holes
    names = ("fst_hudson", "fst_nei", "fst_wc", "dxy", "da", "pi1", "pi2")
    for span in (True, False):
        got = divergence.divergence_stats(p, "a", "b", names, span_normalize=span)
        for s in names:
            assert math.isclose(got[s], divergence.divergence_stats(p, "a", "b", (s,), span_normalize=span)[s], rel_tol=1e-12), s
    for name, s in diversity.frequency_spectra(p, ["a", "b"]).items():
        assert math.isclose(s.test("pi", "watterson"), diversity.tajimas_d(p, name), rel_tol=1e-12)


def test_statistics_of_dosages(complete):
    p, h, _ = complete
    g = h[0::2] + h[1::2]
    f, n = diversity.diplotype_frequency_spectrum(p)
    assert n == len(np.unique(g, axis=0)) and math.isclose(haplotypes.garud_h(p, diploid=True)[0], (f**2).sum())
    seg = (h.sum(axis=0) > 0) & (h.sum(axis=0) < 12)
    with np.errstate(all="ignore"):
        r2 = np.nan_to_num(np.corrcoef(g[:, seg].T) ** 2)
    assert math.isclose(ld.zns(p, kind="geno"), r2[np.triu_indices(len(r2), 1)].mean(), rel_tol=1e-6)
    assert ld.omega(p, kind="geno") > 0
    w = windows.windowed(p, windows.WindowParams("snp", 10), ("mean_r2", "ld_decay")).toPandas()
    assert np.allclose(w.mean_r2, w.ld_decay, equal_nan=True)


def test_older_names_and_blocks(spark):
    from sitefold.operators import diversity, scans
    from sitefold.operators.panel import Panel

    rng = np.random.default_rng(9)
    p = Panel.from_numpy(spark, rng.integers(0, 2, (8, 30)), np.arange(1, 31) * 10)

    with pytest.warns(DeprecationWarning):
        assert p.diversity() == diversity.pi(p) and p.watersons_theta() == diversity.theta_w(p)
        assert p.Tajimas_D() == diversity.tajimas_d(p) and (p.allele_frequency_spectrum() == diversity.allele_frequency_spectrum(p)).all()


def test_segments_of_two_chromosomes(spark, monkeypatch):
    """Runs end with a chromosome, and pass any number of segments within it."""
    rng = np.random.default_rng(10)
    h = rng.integers(-1, 2, (9, 70))
    h[3] = h[7]
    pos = np.concatenate((np.arange(1, 31), np.arange(1, 41))) * 10
    p = Panel.from_numpy(spark, h, pos, chrom=["1"] * 30 + ["2"] * 40, pops={"a": (0, 1, 2, 3), "b": (4, 5, 6, 7, 8)})
    one = {name: [tuple(r) for r in f.orderBy("chrom", "pos").collect()] for name, f in scans_of(p).items()}
    decay = scans.ehh_decay(p)
    assert np.allclose(decay, scans.ehh_decay_of(h.T)) and np.allclose(decay[-1], 1 / 36)
    for name, x in (("SEGMENT", 4), ("BLOCK", 20), ("BLOCKS_PER_TASK", 2)):
        monkeypatch.setattr(scans, name, x)
    for name, f in scans_of(p).items():
        for got, want in zip([tuple(r) for r in f.orderBy("chrom", "pos").collect()], one[name], strict=True):
            assert got[:2] == want[:2] and np.isclose(got[2], want[2], equal_nan=True), name
    assert np.allclose(scans.ehh_decay(p), decay) and np.allclose(scans.ehh_decay(p, truncate=True), decay)
    want = np.concatenate([scans.nsl_matrix(x.T) for x in (h[:, :30], h[:, 30:])])
    assert np.allclose([x[2] for x in one["nsl"]], want, equal_nan=True)


def scans_of(p) -> dict:
    x = p.variants.select("chrom", "pos", (F.col("pos") / 7).alias("x"))
    return {"nsl": scans.nsl(p), "xpnsl": scans.xpnsl(p, "a", "b"), "ihs": scans.ihs(p, min_maf=0.0), "xpehh": scans.xpehh(p, "a", "b", map_pos=x, include_edges=True)}


def test_scans_of_few_haplotypes_and_sites(spark):
    one = Panel.from_numpy(spark, np.array([[0, 1, 1]]), [1, 2, 3])
    assert np.isnan([r.nsl for r in scans.nsl(one).collect()]).all() and np.isnan([r.ihs for r in scans.ihs(one).collect()]).all()
    assert scans.ehh_decay(one).tolist() == [0.0, 0.0, 0.0]
    none = one.between(10, 20)
    assert scans.nsl(none).count() == scans.ihs(none).count() == 0 and len(scans.ehh_decay(none)) == 0


def test_lengths_of_blocks_with_several_alleles():
    rng = np.random.default_rng(4)
    m = rng.integers(-1, 4, (30, 9)).astype(np.int8)
    m[:, 5] = m[:, 2]
    got = sum(scans.length_sums(m, lo, min(lo + 4, 9)) for lo in (0, 4, 8))
    for v in range(30):
        runs = brute_runs(m.T, v)
        zero, one = ([k for (i, j), k in runs.items() if m[v, i] == m[v, j] and (m[v, i] == 0, m[v, i] > 0)[x]] for x in (0, 1))
        assert got[v].tolist() == [sum(zero), len(zero), sum(one), len(one), sum(runs.values())]


def test_long_runs_are_tallied_coarsely_beyond_the_stop():
    """A pair that never differs on 6,000 sites changes no area, the stop being before."""
    rng = np.random.default_rng(6)
    m = rng.integers(0, 2, (6_000, 12)).astype(np.int8)
    m[:, 1] = m[:, 0]
    last, at = np.zeros((12, 12), np.int64), 6_000
    for v, row in enumerate(m):
        last[row[:, None] != row] = v + 1
    last[np.tril_indices(12)] = scans.ABSENT
    everyone, gaps = np.arange(12), np.ones(5_999)
    exact = np.bincount((at - last)[np.triu_indices(12, 1)])
    assert len(exact) == 6_001
    for share in (0.0, 0.05, 0.2):
        assert np.isclose(scans._integral(scans._tally([(0, 12, last)], everyone, at, share), gaps, share, True), scans._integral(exact, gaps, share, True))
    assert len(scans._tally([(0, 12, last)], everyone, at, 0.05)) == 1_025
