import itertools
import math

import numpy as np
import pytest

from sitefold.functions import popmath, twolocus


@pytest.mark.parametrize("n", [3, 4, 7, 20, 51])
def test_variance_of_pi_and_watterson_is_tajimas(n):
    a1, a2 = popmath.harmonics(n)
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    e1, e2 = (b1 - 1 / a1) / a1, (b2 - (n + 2) / (a1 * n) + a2 / a1**2) / (a1**2 + a2)
    for s in (3, 10, 100):
        assert math.isclose(popmath.neutrality_variance("pi", "watterson", n, s), e1 * s + e2 * s * (s - 1), rel_tol=1e-9)


def test_estimators_agree_under_the_neutral_spectrum():
    n = 12
    expected = np.zeros(n + 1)
    expected[1:n] = 1 / np.arange(1, n)
    for name in ("pi", "watterson", "theta_h", "theta_l", "minus_eta1", "minus_eta1_star"):
        assert math.isclose(expected @ popmath.weight_vector(name, n), 1.0, rel_tol=1e-9), name


def test_projection():
    m = popmath.projection_matrix(9, 4)
    assert np.allclose(m.sum(axis=0), 1)
    assert np.allclose(popmath.project_sfs([0, 0, 0, 0, 0, 0, 0, 0, 0, 1], 9, 4), [0, 0, 0, 0, 1])
    with pytest.raises(ValueError):
        popmath.projection_matrix(4, 5)


def brute(statistic, kind, counts, pops):
    """The mean over all ordered draws of distinct samples, population by population."""
    gametes = (twolocus.HAPLOTYPES if kind == "hap" else twolocus.DOSAGES).gametes
    scale = 1.0 if kind == "hap" else 2.0
    draws = {"dd": (2, 2), "dz": (2, 1, 1), "pi2": (1, 1, 1, 1)}[statistic]
    need: dict = {}
    slots = []
    for p, k in zip(pops, draws):
        slots.append([(p, need.setdefault(p, 0) + i) for i in range(k)])
        need[p] += k
    people = {p: np.repeat(np.arange(len(counts[p])), counts[p]) for p in need}
    total, n = 0.0, 0
    for pick in itertools.product(*(itertools.permutations(range(len(people[p])), need[p]) for p in need)):
        of = {p: [people[p][i] for i in x] for p, x in zip(need, pick)}
        g = [[gametes[:, of[p][i]] for p, i in s] for s in slots]
        d = lambda s: scale * (s[0][0] * s[1][3] - s[0][1] * s[1][2])
        pa, pb = (lambda x: x[0] + x[1]), (lambda x: x[0] + x[2])
        if statistic == "dd":
            v = d(g[0]) * d(g[1])
        elif statistic == "dz":
            v = d(g[0]) * (1 - 2 * pa(g[1][0])) * (1 - 2 * pb(g[2][0]))
        else:
            het = lambda f, x, y: (f(x) * (1 - f(y)) + f(y) * (1 - f(x))) / 2
            v = het(pa, g[0][0], g[1][0]) * het(pb, g[2][0], g[3][0])
        total, n = total + v, n + 1
    return total / n


@pytest.mark.parametrize("kind,types", [("hap", 4), ("geno", 9)])
@pytest.mark.parametrize("statistic,pops", [("dd", (0, 0)), ("dd", (0, 1)), ("dz", (0, 0, 0)), ("dz", (0, 1, 0)), ("dz", (0, 1, 1)), ("pi2", (0, 0, 0, 0)), ("pi2", (0, 1, 0, 1)), ("pi2", (0, 0, 1, 1)), ("pi2", (0, 1, 1, 1))])
def test_unbiased_estimates_are_means_over_draws(kind, types, statistic, pops):
    rng = np.random.default_rng(hash((kind, statistic, pops)) % 1000)
    counts = [np.bincount(rng.integers(0, types, 5), minlength=types) for _ in range(2)]
    got = twolocus.Counts([c[None, :] for c in counts]).value(kind, statistic, pops)[0]
    assert math.isclose(got, brute(statistic, kind, counts, pops), rel_tol=1e-9, abs_tol=1e-12)


def test_single_population_closed_form_and_small_samples():
    c = np.array([[10, 5, 3, 2], [8, 6, 4, 2], [1, 1, 1, 0]])
    n = c.sum(axis=1)
    a, b, d, e = c.T
    want = (a * (a - 1) * e * (e - 1) + b * (b - 1) * d * (d - 1) - 2 * a * b * d * e) / np.where(n > 3, n * (n - 1) * (n - 2) * (n - 3), 1)
    assert np.allclose(twolocus.dd(c)[:2], want[:2]) and twolocus.dd(c)[2] == 0


@pytest.mark.parametrize("pops,count", [(1, 3), (2, 15), (3, 45), (4, 105)])
def test_names_and_weights(pops, count):
    names = twolocus.ld_names(pops)
    assert len(names) == len(set(names)) == count
    for _, forms in twolocus.generate_stat_specs(pops):
        assert math.isclose(sum(w for *_, w in forms), 1.0)


def test_r_and_d_prime():
    c = np.array([[5, 0, 0, 5], [5, 5, 0, 0], [2, 3, 4, 1]])
    assert np.allclose(twolocus.r_squared(c)[0], 1) and np.isnan(twolocus.r_squared(c)[1])
    assert np.isclose(twolocus.d_prime(c)[0], 1) and twolocus.r(c)[2] < 0
