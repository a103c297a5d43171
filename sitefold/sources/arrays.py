"""Chunked array stores of the Zarr 2 kind, with raw, zlib, gzip or zstd chunks.

Three layouts are known: ``vcz`` (call_genotype, variant_position, variant_contig,
contig_id, sample_id), ``flat`` (calldata/GT, variants/POS, samples) and ``grouped``
(a flat group per chromosome). Chunks along variants are read by separate tasks.
"""

from __future__ import annotations

import gzip
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..operators.panel import VARIANTS, Panel, lists
from .text import parse_region


def _meta(path: str) -> dict:
    with open(os.path.join(path, ".zarray")) as f:
        return json.load(f)


def _unpacked(raw: bytes, compressor: dict | None) -> bytes:
    name = (compressor or {}).get("id")
    if name is None:
        return raw
    if name == "zlib":
        return zlib.decompress(raw)
    if name == "gzip":
        return gzip.decompress(raw)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"chunks compressed by {name!r} can't be read here")


def read_array(path: str, rows: slice | None = None) -> np.ndarray:
    """An array, or some of its rows, from its chunks."""
    meta = _meta(path)
    if meta.get("filters"):
        return _read_objects(path, meta)
    shape, chunks, dtype = meta["shape"], meta["chunks"], np.dtype(meta["dtype"])
    lo, hi, _ = (rows or slice(None)).indices(shape[0])
    fill = meta.get("fill_value")
    out = np.full([hi - lo, *shape[1:]], 0 if fill in (None, "") else fill, dtype)
    sep = meta.get("dimension_separator", ".")
    grid = [range(lo // chunks[0], -(-hi // chunks[0]))] + [range(-(-s // c)) for s, c in zip(shape[1:], chunks[1:])]
    for index in np.ndindex(*map(len, grid)):
        at = [g[i] for g, i in zip(grid, index)]
        file = os.path.join(path, sep.join(map(str, at)))
        if not os.path.exists(file):
            continue
        with open(file, "rb") as f:
            block = np.frombuffer(_unpacked(f.read(), meta.get("compressor")), dtype).reshape(chunks, order=meta.get("order", "C"))
        start = [a * c for a, c in zip(at, chunks)]
        a, b = max(lo, start[0]), min(hi, start[0] + chunks[0])
        dst = [slice(a - lo, b - lo)] + [slice(s, min(s + c, n)) for s, c, n in zip(start[1:], chunks[1:], shape[1:])]
        src = [slice(a - start[0], b - start[0])] + [slice(0, d.stop - d.start) for d in dst[1:]]
        out[tuple(dst)] = block[tuple(src)]
    return out


def _read_objects(path: str, meta: dict) -> np.ndarray:
    """Strings of a one-dimensional array whose filter is json2."""
    if [f.get("id") for f in meta["filters"]] != ["json2"]:
        raise ValueError("only the json2 filter is known")
    out: list = []
    for k in range(-(-meta["shape"][0] // meta["chunks"][0])):
        with open(os.path.join(path, str(k)), "rb") as f:
            *items, _, _ = json.loads(_unpacked(f.read(), meta.get("compressor")))
        out += items
    return np.array(out[: meta["shape"][0]], object)


def write_array(path: str, data: np.ndarray, chunk_rows: int = 10_000) -> None:
    os.makedirs(path, exist_ok=True)
    data = np.asarray(data)
    if data.dtype.kind in "OU":
        data = data.astype("U")
    chunks = [min(chunk_rows, max(1, data.shape[0])), *data.shape[1:]]
    meta = {"zarr_format": 2, "shape": list(data.shape), "chunks": chunks, "dtype": data.dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": "" if data.dtype.kind == "U" else 0, "order": "C", "filters": None}
    with open(os.path.join(path, ".zarray"), "w") as f:
        json.dump(meta, f)
    for k in range(-(-data.shape[0] // chunks[0])):
        block = np.zeros(chunks, data.dtype)
        part = data[k * chunks[0] : (k + 1) * chunks[0]]
        block[: len(part)] = part
        name = ".".join([str(k)] + ["0"] * (data.ndim - 1))
        with open(os.path.join(path, name), "wb") as f:
            f.write(zlib.compress(np.ascontiguousarray(block).tobytes(), 1))


def _group(path: str) -> None:
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, ".zgroup"), "w") as f:
        json.dump({"zarr_format": 2}, f)


def detect_layout(path: str) -> str:
    """``vcz``, ``flat`` or ``grouped``."""
    has = lambda *x: os.path.exists(os.path.join(path, *x, ".zarray"))
    if has("call_genotype"):
        return "vcz"
    if has("calldata", "GT"):
        return "flat"
    if any(has(x, "calldata", "GT") for x in os.listdir(path)):
        return "grouped"
    raise ValueError(f"{path} has no layout that is known")


def read_store(spark: SparkSession, path: str, region: str | None = None) -> Panel:
    """A store as a panel; a region is 1-based and inclusive, and picks the group of a grouped store."""
    layout = detect_layout(path)
    chrom, low, high = parse_region(region) if region else (None, None, None)
    base = path
    if layout == "grouped":
        if chrom is None:
            raise ValueError("a grouped store needs a region")
        base = os.path.join(path, chrom)
    gt, where = (os.path.join(base, "call_genotype"), "variant_position") if layout == "vcz" else (os.path.join(base, "calldata", "GT"), "variants/POS")
    pos = read_array(os.path.join(base, where)).astype(np.int64)
    if layout == "vcz":
        names = [str(x) for x in read_array(os.path.join(base, "contig_id"))]
        contig = read_array(os.path.join(base, "variant_contig"))
        if chrom is None and len(np.unique(contig)) > 1:
            raise ValueError("a store of several contigs needs a region")
        chroms = np.array(names, object)[contig]
    else:
        chroms = np.full(len(pos), chrom or "1", object)
    keep = np.ones(len(pos), bool) if chrom is None else chroms == chrom
    if low is not None:
        keep &= (pos >= low) & (pos <= high)
    meta = _meta(gt)
    step, n_hap = meta["chunks"][0], 2 * meta["shape"][1]
    # a row per chunk travels; tasks read the genotypes themselves, from a path all machines see
    tasks = [(k, min(k + step, len(pos))) for k in range(0, len(pos), step) if keep[k : k + step].any()]
    wanted = spark.createDataFrame([(a, b) for a, b in tasks], "a long, b long").repartition(max(1, len(tasks)))

    def load(batches):
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                m = read_array(gt, slice(a, b)).reshape(b - a, n_hap).astype(np.int8)[keep[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(chroms[a:b][keep[a:b]].tolist(), pa.string()), pa.array(pos[a:b][keep[a:b]]), lists(m)], ["chrom", "pos", "alleles"])

    names = os.path.join(base, "sample_id" if layout == "vcz" else "samples")
    samples = tuple(str(x) for x in read_array(names)) if os.path.exists(os.path.join(names, ".zarray")) else None
    return Panel(wanted.mapInArrow(load, VARIANTS), individual=tuple(i // 2 for i in range(n_hap)), samples=samples, chrom_start=low, chrom_end=high)


def write_store(panel: Panel, path: str, format: str = "vcz", contig_name: str | None = None) -> None:
    """One store in the ``vcz`` or ``flat`` layout, from the driver; Parquet is the way for large panels."""
    if format not in ("vcz", "flat"):
        raise ValueError(f"unknown format {format!r}")
    h, pos, chrom = panel.to_numpy()
    order = np.argsort(np.array(panel.individual), kind="stable")
    gt = h[order].T.reshape(len(pos), -1, 2)
    samples = np.array(panel.samples if panel.samples is not None else [f"s{i}" for i in range(gt.shape[1])], "U")
    _group(path)
    if format == "vcz":
        names = sorted(set(chrom)) if contig_name is None else [contig_name]
        write_array(os.path.join(path, "call_genotype"), gt.astype(np.int8))
        write_array(os.path.join(path, "call_genotype_mask"), gt < 0)
        write_array(os.path.join(path, "variant_position"), pos.astype(np.int32))
        write_array(os.path.join(path, "variant_contig"), np.array([0 if contig_name else names.index(c) for c in chrom], np.int32))
        write_array(os.path.join(path, "contig_id"), np.array(names, "U"))
        write_array(os.path.join(path, "sample_id"), samples)
    else:
        for g in ("calldata", "variants"):
            _group(os.path.join(path, g))
        write_array(os.path.join(path, "calldata", "GT"), gt.astype(np.int8))
        write_array(os.path.join(path, "variants", "POS"), pos.astype(np.int32))
        write_array(os.path.join(path, "samples"), samples)
