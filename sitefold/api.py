"""The public functions in one place."""

from __future__ import annotations

from .functions.popmath import fu_covariance, project_sfs, projection_matrix
from .functions.twolocus import compute_ld_statistics, d_prime, dd_between, dd_within, dz, generate_stat_specs, het_names, ld_names, pi2, r, r_squared
from .functions.twolocus import dd as dd_counts
from .operators import decomposition, distance, divergence, diversity, fstats, haplotypes, ld, mask, moments, panel, relatedness, resampling, scans, sfs, windows
from .operators.decomposition import LocalPCAResult, LostructResult, corners, local_pca, local_pca_jackknife, lostruct, pc_dist, pca, pcoa, randomized_pca
from .operators.distance import dist_kurt, dist_moments, dist_skew, dist_var, pairwise_diffs, pairwise_diffs_diploid, pairwise_diffs_haploid, pairwise_distance
from .operators.divergence import (
    da,
    dd,
    dd_rank,
    distance_based_stats,
    divergence_stats,
    dxy,
    dxy_components,
    dxy_min,
    fst,
    fst_hudson,
    fst_nei,
    fst_weir_cockerham,
    gmin,
    pairwise_distance_matrix,
    pairwise_fst,
    pbs,
    pi_within_population,
    snn,
    zx,
)
from .operators.diversity import (
    FrequencySpectrum,
    allele_frequency_spectrum,
    daf_histogram,
    diplotype_frequency_spectrum,
    diversity_stats,
    fay_wus_h,
    haplotype_count,
    haplotype_diversity,
    heterozygosity_expected,
    heterozygosity_observed,
    inbreeding_coefficient,
    max_daf,
    mu_sfs,
    mu_var,
    neutrality_tests,
    normalized_fay_wus_h,
    pi,
    pi_components,
    segregating_sites,
    singleton_count,
    tajimas_d,
    theta_h,
    theta_l,
    theta_w,
    zeng_dh,
    zeng_e,
)
from .operators.fstats import average_patterson_d, average_patterson_f3, moving_patterson_d, moving_patterson_f3, patterson_d, patterson_f2, patterson_f3
from .operators.haplotypes import garud_h
from .operators.ld import (
    iter_pairs_within_distance,
    ld_by_distance,
    locate_unlinked,
    mu_ld,
    omega,
    pairs,
    pairwise_ld,
    pairwise_r2,
    rogers_huff_r,
    rogers_huff_r_squared,
    sigma_d2_geno,
    windowed_r_squared,
    zns,
)
from .operators.panel import Panel, dosages, from_dosages
from .operators.relatedness import grm, ibs
from .operators.resampling import block_bootstrap, block_jackknife
from .operators.scans import ehh_decay, ihs, moving_garud_h, nsl, standardize, standardize_by_allele_count, xpehh, xpnsl
from .operators.sfs import (
    fold_joint_sfs,
    fold_sfs,
    joint_sfs_folded,
    joint_sfs_folded_scaled,
    joint_sfs_scaled,
    scale_joint_sfs,
    scale_joint_sfs_folded,
    scale_sfs,
    scale_sfs_folded,
    sfs_folded,
    sfs_folded_scaled,
    sfs_scaled,
)
from .operators.windows import WindowedAnalyzer, WindowParams, windowed, windowed_analysis, windowed_statistics, windowed_statistics_fused, windowed_statistics_fused_chunked
from .sources.arrays import detect_layout, read_store, write_store
from .sources.text import load_pop_file, parse_region, read_bed, read_map, read_panel, read_vcf, vcf_to_store, write_panel

compute_sigma_ij = fu_covariance

__all__ = [n for n in dir() if not n.startswith("_")]
