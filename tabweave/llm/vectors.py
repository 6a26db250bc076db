"""Unit vectors of an embedding table, and small bounded fits on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import keep


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Binary vectors of doubles as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def binary_rows(m: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(m, "<f8").tobytes()
    w = 8 * m.shape[1]
    return pa.array([raw[i * w : (i + 1) * w] for i in range(len(m))], pa.binary())


def unit_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Written table (row, vec_id, unit) of ``vectors`` (vec_id, embedding), and their dimension.

    ``unit`` is the vector over its length, as doubles; null where the vector takes no part:
    null, empty or zero, with null or non-finite components, or of another dimension than the
    most frequent one.
    """
    sizes = vectors.select(F.size("embedding").alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            flat = lists.flatten()
            n = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([-1 if x is None else len(x) for x in lists.to_pylist()])
            good = n == dim
            starts = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
            values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
            m = np.zeros((len(n), dim))
            if good.any():
                m[good] = values[(starts[good][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
            good &= np.isfinite(m).all(axis=1)
            m[~good] = 0
            top = np.abs(m).max(axis=1)
            good &= top > 0
            m[good] /= top[good][:, None]
            m[good] /= np.sqrt((m[good] * m[good]).sum(axis=1))[:, None]
            raw = m.astype("<f8").tobytes()
            unit = [raw[i * 8 * dim : (i + 1) * 8 * dim] if g else None for i, g in enumerate(good.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(unit, pa.binary())], names=["row", "vec_id", "unit"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return keep(rows.mapInArrow(run, "row long, vec_id long, unit binary"), "units"), dim


def sample_units(units: DataFrame, dim: int, n: int, seed: int = 11) -> np.ndarray:
    """At most ``n`` unit vectors, those with the smallest hashes: a bounded sample for fitting."""
    got = units.filter("unit is not null").select("unit", F.xxhash64(F.lit(seed), "unit", "row").alias("h")).orderBy("h").limit(n).collect()
    return np.frombuffer(b"".join(r["unit"] for r in got), "<f8").reshape(-1, dim)


def means(points: np.ndarray, k: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres of a bounded sample (numpy, blocks of rows)."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(turns):
        best = nearest(points, centres)[0]
        for j in range(points.shape[1]):
            total = np.bincount(best, weights=points[:, j], minlength=len(centres))
            centres[:, j] = np.where((n := np.bincount(best, minlength=len(centres))) > 0, total / np.maximum(n, 1), centres[:, j])
    return centres


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.maximum(d, 0, out=d)


def nearest(x: np.ndarray, y: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of ``y``."""
    index, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), block):
        d = square_distances(x[a : a + block], y)
        index[a : a + block] = d.argmin(axis=1)
        dist[a : a + block] = d.min(axis=1)
    return index, dist
