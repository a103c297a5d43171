"""The data model: one row per variant, with an array of alleles.

``variants`` has ``chrom string, pos bigint, alleles array<tinyint>``; allele 0 is
the reference, 1 and above alternatives, -1 a missing call. Which haplotype belongs
to which individual and population is small and lives on the driver. Restricting
positions, samples or sites gives a new panel; nothing is computed until asked.

Per-site counts are taken in Arrow batches with numpy, without a shuffle: a batch
of alleles is cut into int8 matrices of a bounded size, however large the cohort.
Everything additive builds on them with DataFrame aggregates.

Alleles may be made from smaller rows (:class:`Source`); then those rows are what
is indexed, filtered and shuffled, and alleles are made in the task that uses them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANTS = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("alleles", T.ArrayType(T.ByteType()))])
MISSING = -1
#: Calls of a matrix at a time; a few copies of it are in memory at once.
PIECE = 4 << 20


def allele_matrix(column) -> np.ndarray:
    """Variants by haplotypes from an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int8)


def lists(matrix: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list column from a matrix."""
    matrix = np.ascontiguousarray(matrix)
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * m, m) if m else np.zeros(n + 1), pa.int32()), pa.array(matrix.ravel(), kind or pa.from_numpy_dtype(matrix.dtype)))


def pieces(batches, matrix, width: int):
    """Slices of Arrow batches, each with its matrix of about :data:`PIECE` calls."""
    step = max(1, PIECE // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, matrix(part)


def pick(m: np.ndarray, cols) -> np.ndarray:
    """Columns of a matrix; of one that lies by column, whole columns are copied."""
    return m.T.take(cols, axis=0).T if m.flags.f_contiguous else m[:, cols]


def tally(x: np.ndarray) -> np.ndarray:
    """True entries of each row, added up as bytes."""
    y, out = x.view(np.uint8).T, np.zeros(len(x), np.int64)
    for at in range(0, len(y), 255):
        out += np.add.reduce(y[at : at + 255], axis=0, dtype=np.uint8)
    return out


@dataclass(frozen=True)
class Source:
    """Rows that alleles are made of.

    rows   ``chrom, pos`` and what ``make`` reads
    make   of haplotype columns (None: all), a function from a batch or table of rows to the matrix of variants by these columns
    kinds  of haplotype columns, their :class:`Kinds`; None if haplotypes aren't known to have any
    """

    rows: DataFrame
    make: Callable
    kinds: Callable | None = None


@dataclass(frozen=True)
class Kinds:
    """Haplotypes (or individuals) of which many are alike, so that sums over them and over their pairs go by kinds.

    kind     of each item; items of a kind have the same value wherever they are called
    hole     of each item; items of a hole miss the same calls
    misses   holes by patterns: whether a hole is missing at sites of a pattern
    make     from a batch or table of rows to values of variants by kinds
    pattern  from the same to each variant's pattern
    """

    kind: np.ndarray
    hole: np.ndarray
    misses: np.ndarray
    make: Callable
    pattern: Callable

    @property
    def width(self) -> int:
        """Values of a variant, of kinds and of holes."""
        return self.count + len(self.misses)

    @property
    def count(self) -> int:
        return int(self.kind.max(initial=-1)) + 1

    def weights(self) -> np.ndarray:
        """Items by kind and hole."""
        k, h = self.count, len(self.misses)
        return np.bincount(self.kind * h + self.hole, minlength=k * h).reshape(k, h)

    def individuals(self, first, second) -> Kinds:
        """Of the individuals that have these items; their values are the two alleles, ``2 * (x > 0) + (y > 0)``."""
        k, h = max(1, self.count), max(1, len(self.misses))
        pairs, kind = np.unique(self.kind[first] * k + self.kind[second], return_inverse=True)
        holes, hole = np.unique(self.hole[first] * h + self.hole[second], return_inverse=True)
        x, y, make = pairs // k, pairs % k, self.make

        def both(t):
            m = (make(t) > 0).view(np.int8)
            return 2 * pick(m, x) + pick(m, y)

        return Kinds(kind, hole, self.misses[holes // h] | self.misses[holes % h], both, self.pattern)


def called_sums(x: np.ndarray, at: np.ndarray, kinds: Kinds, weights: np.ndarray) -> np.ndarray:
    """Per variant, the sum over called items of their kinds' values (small integers)."""
    exact = np.float32 if int(weights.sum()) * int(x.max(initial=1)) < 1 << 24 else np.float64
    by_hole = x.astype(exact) @ weights.astype(exact)
    return (by_hole * ~kinds.misses.T[at]).sum(axis=1, dtype=np.float64).astype(np.int64)


def called_items(at: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Called items of each variant."""
    return (~kinds.misses.T @ np.bincount(kinds.hole, minlength=len(kinds.misses)))[at]


@dataclass(frozen=True)
class Panel:
    """Phased haplotypes of a cohort.

    individual   the individual of each haplotype, in column order
    pops         haplotype columns by population; populations may overlap
    chrom_start, chrom_end   1-based inclusive bounds, if known
    n_total_sites            callable sites, invariant ones included, if known
    mask         merged accessible intervals ``chrom, start, end`` (1-based inclusive)
    """

    variants: DataFrame
    individual: tuple[int, ...]
    pops: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    chrom_start: int | None = None
    chrom_end: int | None = None
    n_total_sites: int | None = None
    mask: DataFrame | None = None
    samples: tuple[str, ...] | None = None
    unmasked: Panel | None = None
    source: Source | None = None

    def __post_init__(self):
        if not isinstance(self.pops, Mapping) or not all(isinstance(v, (list, tuple)) for v in self.pops.values()):
            raise ValueError("pops must map names to lists of haplotype columns")
        if not self.pops:
            object.__setattr__(self, "pops", {"all": tuple(range(len(self.individual)))})

    # -- construction -----------------------------------------------------------

    @classmethod
    def from_numpy(cls, spark: SparkSession, haplotypes, positions, *, chrom="1", partitions: int | None = None, **kwargs) -> Panel:
        """From a haplotypes-by-variants matrix; adjacent rows form an individual unless told otherwise."""
        h = np.asarray(haplotypes, np.int8)
        if h.ndim != 2 or not h.size:
            raise ValueError("haplotypes must be a non-empty matrix")
        if h.shape[1] != len(positions):
            raise ValueError("a position is needed for each variant")
        chroms = [chrom] * h.shape[1] if isinstance(chrom, str) else [str(c) for c in chrom]
        t = pa.table({"chrom": pa.array(chroms, pa.string()), "pos": pa.array(np.asarray(positions, np.int64)), "alleles": lists(h.T)})
        df = spark.createDataFrame(t, VARIANTS)
        kwargs.setdefault("individual", tuple(i // 2 for i in range(h.shape[0])))
        return cls(variants=df.repartition(partitions) if partitions else df, **kwargs)

    @classmethod
    def made(cls, source: Source, individual: tuple[int, ...], **kwargs) -> Panel:
        """A panel whose alleles are made of a source's rows where they are needed."""
        return cls(_alleles(source, len(individual)), individual=individual, source=source, **kwargs)

    def to_numpy(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Haplotypes by variants, positions and chromosomes, in order. For cohorts that fit."""
        t = self.variants.select("chrom", "pos", "alleles").orderBy("chrom", "pos").toArrow()
        return allele_matrix(t["alleles"]).T, t["pos"].to_numpy(), t["chrom"].to_pylist()

    # -- shape --------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.variants.sparkSession

    @property
    def num_haplotypes(self) -> int:
        return len(self.individual)

    @property
    def num_individuals(self) -> int:
        return len(set(self.individual))

    @property
    def num_variants(self) -> int:
        return self.rows.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_haplotypes, self.num_variants

    @property
    def positions(self) -> DataFrame:
        return self.rows.select("chrom", "pos")

    @property
    def rows(self) -> DataFrame:
        """What stands for the variants where they are filtered or moved."""
        return self.variants if self.source is None else self.source.rows

    def matrix(self, population=None) -> Callable:
        """From a batch or table of :attr:`rows` to variants by the population's haplotypes; for use in tasks."""
        cols = None if population is None else np.array(self.columns(population), np.int64)
        if self.source is not None:
            return self.source.make(cols)
        return lambda t: allele_matrix(t.column("alleles")) if cols is None else allele_matrix(t.column("alleles"))[:, cols]

    @property
    def has_accessible_mask(self) -> bool:
        return self.mask is not None

    @property
    def has_invariant_info(self) -> bool:
        return self.n_total_sites is not None

    @property
    def n_callable_sites(self) -> int | None:
        return self.n_total_sites

    def columns(self, population: str | Sequence[int] | None = None) -> tuple[int, ...]:
        """Haplotype columns of a population, by name or as given."""
        if population is None:
            return tuple(range(self.num_haplotypes))
        if isinstance(population, str):
            if population not in self.pops:
                raise ValueError(f"population {population!r} is not among {sorted(self.pops)}")
            return tuple(self.pops[population])
        return tuple(int(i) for i in population)

    def kinds(self, population=None) -> Kinds | None:
        """The kinds of a population's haplotypes, if the panel's source knows any."""
        if self.source is None or self.source.kinds is None:
            return None
        return self.source.kinds(np.array(self.columns(population), np.int64))

    # -- restrictions -------------------------------------------------------------

    def with_variants(self, variants: DataFrame) -> Panel:
        return replace(self, variants=variants, source=None)

    def with_rows(self, rows: DataFrame) -> Panel:
        """The panel with some of its :attr:`rows`, or with more columns to them."""
        if self.source is None:
            return self.with_variants(rows)
        source = replace(self.source, rows=rows)
        return replace(self, variants=_alleles(source, self.num_haplotypes), source=source)

    def population(self, population) -> Panel:
        """The haplotypes of one population, with ``all`` as the only one."""
        cols = self.columns(population)
        source = Source(self.rows if self.source is not None else self.variants.select("chrom", "pos", "alleles"), self._make_of(cols), self._kinds_of(cols))
        chosen = replace(self, variants=_alleles(source, len(cols)), source=source, individual=tuple(self.individual[i] for i in cols), pops={}, samples=None)
        # rows that hold alleles get shorter where they are read; made ones aren't made yet
        return chosen if self.source is not None else replace(chosen, source=None)

    def _make_of(self, cols) -> Callable:
        """``make`` of a source for a choice of the haplotypes, itself open to a choice."""
        given, cols = self, np.array(cols, np.int64)
        if given.source is not None:
            make = given.source.make
            return lambda of: make(cols if of is None else cols[of])
        return lambda of: lambda t: allele_matrix(t.column("alleles"))[:, cols if of is None else cols[of]]

    def _kinds_of(self, cols) -> Callable | None:
        kinds, cols = None if self.source is None else self.source.kinds, np.array(cols, np.int64)
        return None if kinds is None else lambda of: kinds(cols if of is None else cols[of])

    def at(self, positions: DataFrame) -> Panel:
        """The variants at given ``chrom, pos``."""
        return self.with_rows(self.rows.join(positions.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi"))

    def subset(self, indices: Iterable[int]) -> Panel:
        """Variants by their index in order of chromosome and position."""
        wanted = self.spark.createDataFrame([(int(i),) for i in indices], "variant_idx long")
        return self.with_rows(self.with_index().rows.join(F.broadcast(wanted), "variant_idx", "left_semi").drop("variant_idx"))

    def between(self, low: int, high: int, chrom: str | None = None) -> Panel:
        """Positions from ``low``, and below ``high``; a Parquet scan prunes by them."""
        if low >= high:
            raise ValueError("low must be below high")
        v = self.rows.where((F.col("pos") >= low) & (F.col("pos") < high))
        return replace(self.with_rows(v if chrom is None else v.where(F.col("chrom") == chrom)), chrom_start=low, chrom_end=high - 1)

    def indexed(self) -> DataFrame:
        """The variants with ``variant_idx``, their rank by chromosome and position."""
        return self.with_index().variants

    def with_index(self) -> Panel:
        """The panel whose rows have ``variant_idx``, their rank by chromosome and position.

        Rows are range-partitioned and sorted; a partition's first index is the sum
        of the counts before it, so nothing goes through a single task.
        """
        v = self.variants.select("chrom", "pos", "alleles") if self.source is None else self.rows.drop("variant_idx")
        names = v.columns
        v = v.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
        v = v.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
        from ..plans.storage import keep

        v = keep(v)
        sizes = {r["_p"]: r["count"] for r in v.groupBy("_p").count().collect()}
        first, at = {}, 0
        for p in sorted(sizes):
            first[p] = at
            at += sizes[p]
        starts = F.create_map(*[F.lit(x) for p in first for x in (p, first[p])]) if first else F.create_map(F.lit(0), F.lit(0))
        v = v.select(*names, (F.element_at(starts, F.col("_p")) + F.col("_i")).cast("long").alias("variant_idx"))
        # a small table comes back in few parts, and alleles are made by part
        return self.with_rows(v if self.source is None else v.repartition(self.spark.sparkContext.defaultParallelism))

    def where_counts(self, keep, population=None) -> Panel:
        """Sites for which ``keep(alleles matrix)`` is true; no shuffle."""
        width, matrix = len(self.columns(population)), self.matrix(population)
        rows = self.variants.select("chrom", "pos", "alleles") if self.source is None else self.rows

        def run(batches):
            for b, m in pieces(batches, matrix, width):
                yield b.filter(pa.array(keep(m)))

        return self.with_rows(rows.mapInArrow(run, rows.schema))

    def biallelic(self) -> Panel:
        """Sites with both 0 and 1 and nothing above; missing calls aside."""
        return self.where_counts(lambda m: (m <= 1).all(axis=1) & (m == 0).any(axis=1) & (m == 1).any(axis=1))

    def exclude_missing_sites(self, populations: Sequence[str] | None = None) -> Panel:
        """Sites without a missing call, of the given populations or of all haplotypes."""
        cols = None if populations is None else sorted({c for p in populations for c in self.columns(p)})
        return self.where_counts(lambda m: (m >= 0).all(axis=1), cols)

    def most_called(self, population=None) -> Panel:
        """Sites at which as many haplotypes are called as at any site: the complete ones, if there are some."""
        n = self.site_counts(population).agg(F.max("n0")).first()[0]
        return self.where_counts(lambda m: tally(m >= 0) == n, population)

    def filter_variants_by_missing(self, max_missing_freq: float = 0.1) -> Panel:
        return self.where_counts(lambda m: (m < 0).mean(axis=1) <= max_missing_freq)

    # -- accessibility ------------------------------------------------------------

    def set_accessible_mask(self, intervals: DataFrame, chrom: str | None = None) -> Panel:
        """Keep accessible sites only. ``intervals`` has ``chrom, start, end`` in BED coordinates."""
        from .mask import clip, inside, merge, total

        merged = merge(intervals if chrom is None else intervals.where(F.col("chrom") == chrom))
        if self.chrom_start is not None and self.chrom_end is not None:
            merged = clip(merged, self.chrom_start, self.chrom_end + 1)
        n = total(merged)
        if not n:
            raise ValueError("no accessible interval")
        base = self.unmasked if self.unmasked is not None else self
        return replace(self.with_rows(inside(base.rows, merged)), mask=merged, n_total_sites=n, unmasked=base)

    def remove_accessible_mask(self) -> Panel:
        base = self.unmasked if self.unmasked is not None else self
        return replace(self.with_rows(base.rows), mask=None, n_total_sites=None, unmasked=None)

    def get_span(self, mode: str = "auto") -> float:
        """Bases that rates are divided by.

        auto: accessible bases, else callable sites, else the bounds, else last minus
        first position plus one; or one of accessible, per_base, per_variant, callable.
        """
        if mode not in ("auto", "accessible", "per_base", "total", "per_variant", "sites", "callable"):
            raise ValueError(f"unknown span {mode!r}")
        if mode == "accessible" and self.mask is None:
            raise ValueError("no accessible mask is set")
        if mode == "callable" and self.n_total_sites is None:
            raise ValueError("the number of callable sites is not known")
        if mode in ("per_variant", "sites"):
            return self.num_variants
        if mode in ("accessible", "callable") or mode == "auto" and self.n_total_sites is not None:
            return self.n_total_sites
        if self.chrom_start is not None and self.chrom_end is not None:
            return self.chrom_end - self.chrom_start + 1
        low, high = self.rows.agg(F.min("pos"), F.max("pos")).first()
        return 0 if low is None else high - low + 1

    # -- counts -------------------------------------------------------------------

    def site_counts(self, *populations, diploid: bool = False, keep: Sequence[str] = ()) -> DataFrame:
        """Per site and population k: ``n{k}`` called, ``d{k}`` derived (any alternative).

        With ``diploid``, over individuals with both alleles called in the population:
        ``m{k}`` individuals, ``h{k}`` heterozygotes, ``a{k}`` derived alleles.
        """
        cols = [list(self.columns(p)) for p in (populations or (None,))]
        # one matrix with the populations side by side
        ends = np.cumsum([0] + [len(c) for c in cols]).tolist()
        pairs = [diploid_columns([self.individual[i] for i in c], range(len(c))) for c in cols] if diploid else []
        names = [f"{x}{k}" for k in range(len(cols)) for x in "nd"] + [f"{x}{k}" for k in range(len(pairs)) for x in "mha"]
        kinds = [self.kinds(c) for c in cols]
        matrix = self.matrix([i for c in cols for i in c])
        kept_names = ("chrom", "pos", *keep)

        def table(b, out):
            return pa.RecordBatch.from_arrays([b.column(c) for c in kept_names] + [pa.array(x.astype(np.int32)) for x in out], [*kept_names, *names])

        def run_by_kinds(batches):
            weights = [k.weights() for k in kinds]
            both = [k.individuals(*p) for k, p in zip(kinds, pairs)]
            weights_of_both = [k.weights() for k in both]
            # a piece has the kinds' values as bytes and as floats
            for b, _ in pieces(batches, lambda t: None, 4 * max(k.width for k in [*kinds, *both])):
                out, more = [], []
                for k, w in zip(kinds, weights):
                    at = k.pattern(b)
                    out += [called_items(at, k), called_sums(k.make(b) > 0, at, k, w)]
                for k, w in zip(both, weights_of_both):
                    g, at = k.make(b), k.pattern(b)
                    het = (g == 1) | (g == 2)
                    more += [called_items(at, k), called_sums(het, at, k, w), called_sums((g == 3) * np.int8(2) + het, at, k, w)]
                yield table(b, out + more)

        def run(batches):
            for b, m in pieces(batches, matrix, ends[-1]):
                each = [m[:, lo:hi] for lo, hi in zip(ends, ends[1:])]
                out = [x for part in each for x in (tally(part >= 0), tally(part > 0))]
                for part, (first, second) in zip(each, pairs):
                    x, y = pick(part, first), pick(part, second)
                    both, x, y = (x >= 0) & (y >= 0), x > 0, y > 0
                    out += [tally(both), tally(both & (x != y)), tally(both & x) + tally(both & y)]
                yield table(b, out)

        rows = self.rows if self.source is not None else self.variants.select("chrom", "pos", "alleles", *keep)
        kept = T.StructType([f for f in rows.schema.fields if f.name in ("chrom", "pos", *keep)])
        schema = T.StructType([kept[c] for c in ("chrom", "pos", *keep)] + [T.StructField(n, T.IntegerType()) for n in names])
        return rows.mapInArrow(run if None in kinds else run_by_kinds, schema)

    def complete_only(self, *populations) -> Panel:
        """Sites without a missing call in any of the populations (for ``missing_data='exclude'``)."""
        cols = sorted({c for p in (populations or (None,)) for c in self.columns(p)})
        return self.where_counts(lambda m: (m >= 0).all(axis=1), cols)

    def calls(self) -> DataFrame:
        """The long view: ``chrom, pos, hap, individual, allele``."""
        who = F.array(*[F.lit(int(i)) for i in self.individual])
        long = self.variants.select("chrom", "pos", F.posexplode("alleles").alias("hap", "allele"))
        return long.withColumn("individual", F.element_at(who, F.col("hap") + 1))

    # -- missing calls ------------------------------------------------------------

    def count_missing(self, axis: int | None = None):
        """Missing calls: in all, per variant (0, a DataFrame) or per haplotype (1, an array)."""
        return self._tally(axis, True)

    def count_called(self, axis: int | None = None):
        return self._tally(axis, False)

    def is_missing(self, axis: int | None = None):
        """Which calls are missing; with an axis, whether any is."""
        if axis is None:
            return self.calls().select("chrom", "pos", "hap", (F.col("allele") < 0).alias("missing"))
        found = self.count_missing(axis)
        return found.select("chrom", "pos", (F.col("n") > 0).alias("missing")) if axis == 0 else found > 0

    def is_called(self, axis: int | None = None):
        """The negation of :meth:`is_missing`: with an axis, whether none is missing."""
        found = self.is_missing(axis)
        return ~found if axis == 1 else found.withColumn("called", ~F.col("missing")).drop("missing")

    def _tally(self, axis, missing: bool):
        width, matrix, kinds = self.num_haplotypes, self.matrix(), self.kinds()
        rows = self.variants.select("chrom", "pos", "alleles") if self.source is None else self.rows
        test = (lambda m: m < 0) if missing else (lambda m: m >= 0)
        if kinds is not None:
            return self._tally_by_kinds(axis, missing, kinds)
        if axis == 0:

            def per_site(batches):
                for b, m in pieces(batches, matrix, width):
                    n = tally(test(m))
                    yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), pa.array(n)], ["chrom", "pos", "n"])

            return rows.mapInArrow(per_site, "chrom string, pos long, n long")

        def per_hap(batches):
            total = None
            for _, m in pieces(batches, matrix, width):
                n = test(m).sum(axis=0)
                total = n if total is None else total + n
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], ["hap", "n"])

        rows = rows.mapInArrow(per_hap, "hap long, n long").groupBy("hap").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(self.num_haplotypes, np.int64)
        for r in rows:
            out[r.hap] = r.n
        return out if axis == 1 else int(out.sum())

    def _tally_by_kinds(self, axis, missing: bool, kinds: Kinds):
        """A haplotype misses what its hole misses, so sites are counted by pattern."""
        width = self.num_haplotypes

        def per_site(batches):
            for b in batches:
                n = called_items(kinds.pattern(b), kinds)
                yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), pa.array(width - n if missing else n)], ["chrom", "pos", "n"])

        if axis == 0:
            return self.rows.mapInArrow(per_site, "chrom string, pos long, n long")

        def patterns(batches):
            total = np.zeros(kinds.misses.shape[1], np.int64)
            for b in batches:
                total += np.bincount(kinds.pattern(b), minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pattern", "n"])

        sites = np.zeros(kinds.misses.shape[1], np.int64)
        for r in self.rows.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
            sites[r.pattern] = r.n
        out = ((kinds.misses if missing else ~kinds.misses) @ sites)[kinds.hole]
        return out if axis == 1 else int(out.sum())

    def summarize_missing_data(self) -> dict:
        per_hap = self.count_missing(1)
        site = self.count_missing(0)
        n_hap = self.num_haplotypes
        s = site.agg(F.count("*"), F.count_if(F.col("n") > 0), F.max("n")).first()
        total = s[0] * n_hap
        return {
            "total_calls": total,
            "missing_calls": int(per_hap.sum()),
            "missing_freq_overall": float(per_hap.sum() / total) if total else 0.0,
            "n_variants": s[0],
            "variants_with_missing": s[1],
            "max_missing_freq_variant": (s[2] or 0) / n_hap,
            "max_missing_freq_haplotype": float(per_hap.max() / s[0]) if s[0] else 0.0,
        }

    # -- older names of statistics ------------------------------------------------

    def diversity(self, population=None, span_normalize=True) -> float:
        return self._older("pi")(self, population, span_normalize)

    def watersons_theta(self, population=None, span_normalize=True) -> float:
        return self._older("theta_w")(self, population, span_normalize)

    def Tajimas_D(self, population=None) -> float:
        return self._older("tajimas_d")(self, population)

    def allele_frequency_spectrum(self, population=None) -> np.ndarray:
        return self._older("allele_frequency_spectrum")(self, population)

    @staticmethod
    def _older(name: str):
        from . import diversity

        warnings.warn(f"use diversity.{name}", DeprecationWarning, stacklevel=3)
        return getattr(diversity, name)

    def n_segregating_sites(self) -> int:
        return self.site_counts().where("d0 > 0 AND d0 < n0").count()

    def n_invariant_sites(self) -> int | None:
        return None if self.n_total_sites is None else self.n_total_sites - self.n_segregating_sites()


def diploid_columns(individual: Sequence[int], cols: Sequence[int]) -> tuple[list[int], list[int]]:
    """First and second haplotype of each individual that has both among ``cols``."""
    by: dict[int, list[int]] = {}
    for c in cols:
        by.setdefault(individual[c], []).append(c)
    both = [v for v in by.values() if len(v) == 2]
    return [v[0] for v in both], [v[1] for v in both]


def dosages(panel: Panel, population=None) -> DataFrame:
    """``chrom, pos, g`` with g the array of dosages 0, 1, 2 or -1 by individual; phase is lost."""
    rows, matrix, width = dosage_rows(panel, population)

    def run(batches):
        for b, g in pieces(batches, matrix, 2 * width):
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), lists(g)], ["chrom", "pos", "g"])

    return rows.mapInArrow(run, "chrom string, pos long, g array<tinyint>")


def dosage_rows(panel: Panel, population=None, individuals: slice = slice(None)) -> tuple[DataFrame, Callable, int]:
    """The panel's rows, what makes variants by individuals' dosages of them in a task, and the number of individuals."""
    first, second = (x[individuals] for x in diploid_columns(panel.individual, panel.columns(population)))
    k, matrix = len(first), panel.matrix([*first, *second])

    def dosage(t):
        m = matrix(t)
        x, y = m[:, :k], m[:, k:]
        return np.where((x < 0) | (y < 0), np.int8(-1), (x > 0).view(np.int8) + (y > 0).view(np.int8))

    return panel.variants.select("chrom", "pos", "alleles") if panel.source is None else panel.rows, dosage, k


def _alleles(source: Source, width: int) -> DataFrame:
    """The variants of a source, and their index if its rows have one."""
    schema = T.StructType([*VARIANTS.fields, *[f for f in source.rows.schema.fields if f.name == "variant_idx"]])
    matrix, rest = source.make(None), [f.name for f in schema.fields[3:]]

    def run(batches):
        for b, m in pieces(batches, matrix, width):
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), lists(m), *[b.column(c) for c in rest]], schema.names)

    return source.rows.mapInArrow(run, schema)


def from_dosages(genotypes: DataFrame, n_individuals: int, **kwargs) -> Panel:
    """A panel whose individuals carry (g >= 1, g >= 2); the phase is made up."""

    def run(batches):
        for b in batches:
            g = allele_matrix(b.column("g"))
            h = np.where(g < 0, -1, np.stack((g >= 1, g >= 2), axis=2).transpose(2, 0, 1)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), lists(np.stack((h[0], h[1]), axis=2).reshape(len(g), -1))], ["chrom", "pos", "alleles"])

    return Panel(genotypes.select("chrom", "pos", "g").mapInArrow(run, VARIANTS), individual=tuple(i // 2 for i in range(2 * n_individuals)), **kwargs)
