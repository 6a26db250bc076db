"""Counts, means and products of all pairs of many columns, as matrix products of Arrow batches.

A task holds one set of p x p matrices per group (a fold, say) whatever its rows; a shuffle brings the
tasks' matrices to a few more tasks that merge them as they stream in, and the driver merges what these hold.
Merging is that of means and centred sums, so large offsets lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that merge what the scan's tasks have summed up.
MERGERS = 16


@dataclass
class CoMoments:
    """For columns a, b over the rows in which both are known: ``n``, mean of a, sum of centred products, sum of centred squares of a."""

    n: np.ndarray
    mean: np.ndarray
    products: np.ndarray
    squares: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> CoMoments:
        """Of a batch, one column a column; NaN is unknown."""
        known = ~np.isnan(x)
        m = known.astype(float)
        at = np.where(known.any(axis=0), np.where(known, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1), 0.0)
        z = np.where(known, x - at, 0.0)
        n, s = m.T @ m, z.T @ m
        some = np.maximum(n, 1)
        return CoMoments(n, at[:, None] + s / some, z.T @ z - s * s.T / some, (z * z).T @ m - s * s / some)

    def __add__(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        d = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        some = np.maximum(n, 1)
        mean = np.where(self.n == 0, other.mean, self.mean + d * other.n / some)
        both = self.n * other.n / some
        return CoMoments(n, mean, self.products + other.products + d * d.T * both, self.squares + other.squares + d * d * both)

    def correlations(self) -> np.ndarray:
        """Pairwise-complete Pearson correlations; NaN for under two rows or a constant column."""
        scale = np.sqrt(self.squares * self.squares.T)
        ok = (self.n > 1) & (scale > 0)
        return np.where(ok, self.products / np.where(ok, scale, 1.0), np.nan)

    def sums(self) -> np.ndarray:
        """Uncentred sums of products."""
        return self.products + self.n * self.mean * self.mean.T

    def packed(self) -> bytes:
        return np.stack([self.n, self.mean, self.products, self.squares]).tobytes()

    @staticmethod
    def unpacked(data: bytes, p: int) -> CoMoments:
        return CoMoments(*np.frombuffer(data, float).reshape(4, p, p))


def comoments(df: DataFrame, cols: Sequence[str], by: str | None = None) -> dict[Any, CoMoments]:
    """Co-moments of ``cols`` within each value of ``by`` (whole numbers, a short list such as folds; None: one group) from one scan.

    NULL and NaN count as unknown.  The driver gets ``MERGERS`` sets of matrices a group, never rows.
    """
    cols, p = list(cols), len(cols)
    group = F.lit(None).cast("bigint") if by is None else F.col(by).cast("bigint")
    rows = df.select(group.alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def emit(held: dict[int | None, CoMoments]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for g, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([part], pa.int64()), pa.array([m.packed()], pa.binary())], names=["g", "part", "body"])

    def add(held: dict, g: int | None, m: CoMoments) -> None:
        held[g] = held[g] + m if g in held else m

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, CoMoments] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            g = b.column(0).fill_null(0).to_numpy()
            for v in np.unique(g[known]).tolist():
                add(held, v, CoMoments.of(x[known & (g == v)]))
            if not known.all():
                add(held, None, CoMoments.of(x[~known]))
        yield from emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, CoMoments] = {}
        for b in batches:
            for g, body in zip(b.column("g").to_pylist(), b.column("body").to_pylist(), strict=True):
                add(held, g, CoMoments.unpacked(body, p))
        yield from emit(held)

    schema = "g long, part long, body binary"
    found: dict[Any, CoMoments] = {}
    sums = rows.mapInArrow(scan, schema).repartition(F.pmod(F.col("part"), F.lit(MERGERS)))  # fewer tasks where these are small
    for r in sums.mapInArrow(merge, schema).collect():
        add(found, r["g"], CoMoments.unpacked(bytes(r["body"]), p))
    return found


def nothing(p: int) -> CoMoments:
    return CoMoments(*np.zeros((4, p, p)))
