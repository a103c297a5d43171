"""Unbiased two-locus statistics of one or several populations.

A statistic is a polynomial in the frequencies of two-locus types: four for
haplotypes, nine for pairs of dosages. Its unbiased estimate replaces each monomial
by falling factorials of counts over those of the sample size, population by
population. Polynomials are built once by multiplication, so every combination of
populations follows from D, 1 - 2p, 1 - 2q, p(1 - p) and q(1 - q).

Types, in order: haplotypes 11, 10, 01, 00; dosages 22, 21, 20, 12, 11, 10, 02,
01, 00. For dosages D is the composite disequilibrium.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np

Poly = dict  # ((population, type), ...) sorted -> coefficient


def _linear(pop: int, coefficients) -> Poly:
    return {((pop, k),): float(c) for k, c in enumerate(coefficients) if c}


def _add(*terms: tuple[float, Poly]) -> Poly:
    out: dict = defaultdict(float)
    for w, p in terms:
        for k, c in p.items():
            out[k] += w * c
    return {k: c for k, c in out.items() if c}


def _mul(*polys: Poly) -> Poly:
    out: Poly = {(): 1.0}
    for p in polys:
        acc: dict = defaultdict(float)
        for (k1, c1), (k2, c2) in product(out.items(), p.items()):
            acc[tuple(sorted(k1 + k2))] += c1 * c2
        out = acc
    return {k: c for k, c in out.items() if c}


#: Share of each type in: the four gametes 11, 10, 01, 00.
_HAP = np.eye(4)
_GENO = np.array([[a * b, a * (1 - b), (1 - a) * b, (1 - a) * (1 - b)] for a in (1, 0.5, 0) for b in (1, 0.5, 0)]).T


class Loci:
    """The building blocks for haplotypes or dosages."""

    def __init__(self, gametes: np.ndarray, scale: float):
        self.gametes, self.types, self.scale = gametes, gametes.shape[1], scale

    def d(self, pop: int) -> Poly:
        x11, x10, x01, x00 = (_linear(pop, g) for g in self.gametes)
        return _add((self.scale, _mul(x11, x00)), (-self.scale, _mul(x10, x01)))

    def p(self, pop: int, locus: int) -> Poly:
        g = self.gametes
        return _linear(pop, g[0] + g[1] if locus == 0 else g[0] + g[2])

    def q(self, pop: int, locus: int) -> Poly:
        g = self.gametes
        return _linear(pop, g[2] + g[3] if locus == 0 else g[1] + g[3])

    def dd(self, i: int, j: int) -> Poly:
        return _mul(self.d(i), self.d(j))

    def dz(self, i: int, j: int, k: int) -> Poly:
        skew = lambda pop, locus: _add((1, self.q(pop, locus)), (-1, self.p(pop, locus)))
        return _mul(self.d(i), skew(j, 0), skew(k, 1))

    def pi2(self, i: int, j: int, k: int, m: int) -> Poly:
        het = lambda a, b, locus: _add((0.5, _mul(self.p(a, locus), self.q(b, locus))), (0.5, _mul(self.q(a, locus), self.p(b, locus))))
        return _mul(het(i, j, 0), het(k, m, 1))


HAPLOTYPES, DOSAGES = Loci(_HAP, 1.0), Loci(_GENO, 2.0)


@lru_cache(maxsize=None)
def polynomial(kind: str, statistic: str, pops: tuple[int, ...]) -> tuple:
    """Monomials by sample sizes: ``((population, degree), ...), [(coefficient, ((population, type, power), ...))]``."""
    loci = {"hap": HAPLOTYPES, "geno": DOSAGES}[kind]
    poly = getattr(loci, statistic)(*pops)
    groups: dict = defaultdict(list)
    for key, c in poly.items():
        degree: dict = defaultdict(int)
        power: dict = defaultdict(int)
        for pop, t in key:
            degree[pop] += 1
            power[pop, t] += 1
        groups[tuple(sorted(degree.items()))].append((c, tuple((a, b, n) for (a, b), n in sorted(power.items()))))
    return tuple(groups.items())


class Counts:
    """Counts of types of many pairs, by population, with their falling factorials."""

    def __init__(self, by_pop: list[np.ndarray], n: list[np.ndarray] | None = None):
        self.by_pop = [np.asarray(c, float) for c in by_pop]
        self.n = [c.sum(axis=1) for c in self.by_pop] if n is None else [np.asarray(x, float) for x in n]
        self._known: dict = {}

    def falling(self, pop: int, t: int, power: int) -> np.ndarray:
        key = pop, t, power
        if key not in self._known:
            x = self.by_pop[pop][:, t]
            self._known[key] = x if power == 1 else self.falling(pop, t, power - 1) * (x - power + 1)
        return self._known[key]

    def value(self, kind: str, statistic: str, pops: tuple[int, ...], divide: bool = True) -> np.ndarray:
        """The estimate for each pair; 0 where a sample is too small."""
        total = np.zeros(len(self.by_pop[0]))
        for degrees, monomials in polynomial(kind, statistic, tuple(pops)):
            part = np.zeros_like(total)
            for c, factors in monomials:
                term = c
                for f in factors:
                    term = term * self.falling(*f)
                part = part + term
            if divide:
                base = np.ones_like(total)
                for pop, degree in degrees:
                    for k in range(degree):
                        base = base * (self.n[pop] - k)
                ok = np.all([self.n[pop] >= degree for pop, degree in degrees], axis=0)
                part = np.divide(part, base, out=np.zeros_like(part), where=ok & (base != 0))
            total = total + part
        return total


def dd(counts, populations=None, n_valid=None, kind="hap") -> np.ndarray:
    return _single(counts, "dd", populations or (0, 0), n_valid, kind)


def dz(counts, populations=None, n_valid=None, kind="hap") -> np.ndarray:
    return _single(counts, "dz", populations or (0, 0, 0), n_valid, kind)


def pi2(counts, populations=None, n_valid=None, kind="hap") -> np.ndarray:
    return _single(counts, "pi2", populations or (0, 0, 0, 0), n_valid, kind)


def dd_within(counts, n_valid=None) -> np.ndarray:
    return dd(counts, None, n_valid)


def dd_between(counts, pop1: int, pop2: int, n_valid=None) -> np.ndarray:
    return dd(counts, (pop1, pop2), n_valid)


def _single(counts, statistic, pops, n_valid, kind):
    by_pop = [counts] if isinstance(counts, np.ndarray) and counts.ndim == 2 else list(counts)
    return Counts(by_pop, None if n_valid is None else [n_valid] if not isinstance(n_valid, (list, tuple)) else n_valid).value(kind, statistic, tuple(pops))


def sigma_d2(counts, kind="hap") -> np.ndarray:
    """DD over pi2 of each pair; NaN where pi2 is 0."""
    c = Counts([counts])
    num, den = (c.value(kind, s, p) for s, p in (("dd", (0, 0)), ("pi2", (0, 0, 0, 0))))
    return np.divide(num, den, out=np.full(len(num), np.nan), where=den != 0)


def _marginals(counts, n_valid):
    c = np.asarray(counts, float)
    n = c.sum(axis=1) if n_valid is None else np.asarray(n_valid, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        pa, pb = (c[:, 0] + c[:, 1]) / n, (c[:, 0] + c[:, 2]) / n
        return c[:, 0] / n - pa * pb, pa, pb


def r(counts, n_valid=None) -> np.ndarray:
    """Signed correlation; NaN where a site is monomorphic."""
    d, pa, pb = _marginals(counts, n_valid)
    den = pa * (1 - pa) * pb * (1 - pb)
    return np.divide(d, np.sqrt(np.maximum(den, 0)), out=np.full(len(d), np.nan), where=den > 0)


def r_squared(counts, n_valid=None) -> np.ndarray:
    return r(counts, n_valid) ** 2


def d_prime(counts, n_valid=None) -> np.ndarray:
    """Lewontin's D'; NaN where a site is monomorphic."""
    d, pa, pb = _marginals(counts, n_valid)
    top = np.where(d >= 0, np.minimum(pa * (1 - pb), (1 - pa) * pb), np.minimum(pa * pb, (1 - pa) * (1 - pb)))
    return np.divide(d, top, out=np.full(len(d), np.nan), where=top > 0)


def compute_ld_statistics(counts, statistics=("dd", "dz", "pi2"), populations=None, n_valid=None) -> dict:
    make = {"dd": dd, "dz": dz, "pi2": pi2}
    simple = {"r": r, "r_squared": r_squared, "d_prime": d_prime}
    return {s: make[s](counts, populations, n_valid) if s in make else simple[s](counts, n_valid) for s in statistics}


# -- names and symmetries of several populations -----------------------------------


def _dd_keys(n):
    return [(i, j) for i in range(n) for j in range(i, n)]


def _dz_keys(n):
    return [(i, j, k) for i in range(n) for j in range(n) for k in range(j, n)]


def _pi2_keys(n):
    return [(i, j, k, m) for i in range(n) for j in range(i, n) for k in range(i, n) for m in range(k, n) if not (k == i and m < j)]


def ld_names(num_pops: int) -> list[str]:
    """DD_i_j, Dz_i_j_k and pi2_i_j_k_l, each symmetric combination once."""
    name = lambda head, key: "_".join([head, *map(str, key)])
    return [name("DD", k) for k in _dd_keys(num_pops)] + [name("Dz", k) for k in _dz_keys(num_pops)] + [name("pi2", k) for k in _pi2_keys(num_pops)]


def het_names(num_pops: int) -> list[str]:
    return [f"H_{i}_{j}" for i in range(num_pops) for j in range(i, num_pops)]


def generate_stat_specs(num_pops: int) -> list[tuple[str, list[tuple[str, tuple[int, ...], float]]]]:
    """Each named statistic as weighted raw ones: the mean over the orderings it stands for."""
    out = []
    for name in ld_names(num_pops):
        head, *key = name.split("_")
        key = tuple(map(int, key))
        if head == "DD":
            forms = [key]
        elif head == "Dz":
            i, j, k = key
            forms = sorted({(i, j, k), (i, k, j)})
        else:
            i, j, k, m = key
            forms = sorted({(*a, *b) for x, y in (((i, j), (k, m)), ((k, m), (i, j))) for a in (x, x[::-1]) for b in (y, y[::-1])})
        out.append((name, [(head.lower(), f, 1 / len(forms)) for f in forms]))
    return out


def all_statistics(counts: Counts, num_pops: int, kind: str = "hap") -> np.ndarray:
    """Pairs by named statistics; each raw statistic is computed once."""
    raw: dict = {}
    cols = []
    for _, forms in generate_stat_specs(num_pops):
        col = 0.0
        for head, pops, w in forms:
            if (head, pops) not in raw:
                raw[head, pops] = counts.value(kind, head, pops)
            col = col + w * raw[head, pops]
        cols.append(col)
    return np.stack(cols, axis=1)
