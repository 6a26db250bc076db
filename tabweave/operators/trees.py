"""Boosted trees of MLlib, grown many at a time over one table of bins.

MLlib grows one booster a call: each reads its rows, finds its splits and caches its own copy of the bins.  Here the rows
of all boosters over one table are binned once, in blocks of bytes; a level of a tree of all of them is one scan of the blocks,
whose tasks sum up counts and targets a bin.  Split candidates, row samples and column samples are drawn with its
generators and splits are chosen by its rules, so the trees are those that MLlib grows.

Tasks hold one block and one set of histograms; the driver holds histograms of one level, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.ml.base import Estimator, Model
from pyspark.ml.common import _py2java
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.jvm_random import BernoulliSample, JavaRandom, doubles, first_int, reservoir
from tabweave.session import materialize, new_path

#: Rows of a block.
BLOCK = 1 << 17
#: Rows of a table so small that the driver takes its blocks, and cells of one scan that it counts itself: under a tenth of a second's work.
SMALL, CELLS = 1 << 18, 10_000_000
#: Trees after which the margins of boosters that go on are written beside the bins; the blocks before are deleted.
KEPT = 8
#: Bytes of partial histograms that are summed up on the driver; more of them meet in tasks first.
DIRECT = 48 << 20
#: Tasks that sum up partial histograms.
MERGERS = 16
#: A node is pure if its targets vary by less than this share of their mean square: sums of doubles tell no more.
PURE = 1e-12


def grows(est: Estimator, df: DataFrame, vector: str = "features") -> bool:
    """Whether the estimator is a booster of the kind that is grown here: continuous columns, no weights, MLlib's usual loss."""
    if not isinstance(est, (GBTClassifier, GBTRegressor)) or est.isSet("weightCol") or est.getMinWeightFractionPerNode() or est.getMaxDepth() > 12:
        return False
    if est.isSet("validationIndicatorCol") or est.getLossType() != ("logistic" if isinstance(est, GBTClassifier) else "squared"):
        return False
    return not df.schema[vector].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal")


@dataclass(frozen=True)
class Boost:
    """A booster to grow: its estimator, the rows it is fitted on, its columns (places in the vector), label and the rows it watches.

    ``stop`` says after each tree, from the losses on the watched rows so far, how many trees to keep and whether that is final.
    """

    estimator: Estimator
    rows: Column
    columns: tuple[int, ...]
    label: str = "label"
    watch: Column | None = None
    stop: Callable[[Sequence[float]], tuple[int, bool]] | None = None


def validated(tolerance: float) -> Callable[[Sequence[float]], tuple[int, bool]]:
    """MLlib's rule for a watched booster: it ends with the first tree that lowers the loss by less than the tolerance."""

    def stop(losses: Sequence[float]) -> tuple[int, bool]:
        best, keep = losses[0], 1
        for m, now in enumerate(losses[1:], 2):
            if best - now < tolerance * max(now, 0.01):
                return keep, True
            if now < best:
                best, keep = now, m
        return keep, False

    return stop


@dataclass
class _Tree:
    """Levels of (column, last bin that goes left) by node place, and the statistics (n, sum, squares, gain) of nodes."""

    splits: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    nodes: dict[tuple[int, int], tuple[float, float, float, float]] = field(default_factory=dict)

    def values(self, depth: int) -> np.ndarray:
        """Mean by place at the depth; a leaf above has the places of all that would be below it."""
        out = np.zeros(1 << depth)
        for level, place in sorted(self.nodes):
            n, total, *_ = self.nodes[level, place]
            span = 1 << (depth - level)
            out[place * span : (place + 1) * span] = total / n if n else 0.0
        return out


def _place(splits: Sequence[dict[int, tuple[int, int]]], bins: np.ndarray) -> np.ndarray:
    """Place of each row after the levels; a node without a split sends its rows left."""
    at = np.zeros(bins.shape[1], np.uint8 if len(splits) <= 8 else np.uint16)
    for depth, level in enumerate(splits):
        right = np.zeros(len(at), bool)
        for node, (column, last) in level.items():
            go = bins[column] > last
            right |= go & (at == node) if depth else go
        at = (at << 1) | right
    return at


@dataclass(frozen=True)
class _Spec:
    """What a task needs to know of one booster at one level."""

    job: int
    mask: int
    watch: int | None
    label: int
    logistic: bool
    columns: tuple[int, ...]
    done: int  # trees before this one
    kept: int | None  # place of the written margins
    before: tuple  # (splits, values by place) of the trees since then, values times their weights
    splits: tuple  # levels of this tree so far
    slots: dict[int, int]  # place of an open node -> slot
    sample: tuple[float, int] | None  # rate and seed of the row sample


def _packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


class Boosters:
    """Boosters over one table, all grown together; ``grow`` may be called again to add trees."""

    def __init__(self, table: DataFrame, jobs: Sequence[Boost], vector: str = "features", pool: Callable | None = None):
        self.spark, self.jobs = table.sparkSession, list(jobs)
        # Equal conditions are one mask; a mask, a number of bins and a seed have one set of candidates.
        self._run = pool or (lambda spark, tasks: [t() for t in tasks])
        self._masks: dict[str, tuple[int, Column]] = {}
        self._labels: dict[str, int] = {}
        for j in self.jobs:
            self._mask(j.rows)
            if j.watch is not None:
                self._mask(j.watch)
            self._labels.setdefault(j.label, len(self._labels))
        found = self._thresholds(table, vector)
        width = self.width = len(next(iter(found.values())))
        self.edges = [np.unique(np.concatenate([t[f] for t in found.values()])) for f in range(width)]
        self.bins = max(len(e) for e in self.edges) + 1
        self.allowed = {key: [np.isin(e, t[f]) for f, e in enumerate(self.edges)] for key, t in found.items()}
        self.trees: list[list[_Tree]] = [[] for _ in self.jobs]
        self.losses: list[list[float]] = [[] for _ in self.jobs]
        self.cut: list[int | None] = [None] * len(self.jobs)
        self._margins: tuple[int, ...] = ()  # boosters whose margins are written
        self._written = [0] * len(self.jobs)  # trees in the written margins
        self._old: str | None = None
        self._read(self._pack(table, vector))

    def _read(self, blocks: DataFrame) -> None:
        self.blocks, self._parts = blocks, blocks.rdd.getNumPartitions()
        self._rows = sum(r["n"] for r in blocks.select("n").collect())
        self._held = [r.asDict() for r in blocks.collect()] if self._rows <= SMALL else None

    def _mask(self, rows: Column) -> int:
        return self._masks.setdefault(rows._jc.toString(), (len(self._masks), rows))[0]

    def _candidates(self, j: Boost) -> tuple:
        return self._mask(j.rows), j.estimator.getMaxBins(), j.estimator.getSeed()

    def _count(self, table: DataFrame) -> dict[int, int]:
        """Rows by mask of the boosters; a label that cannot be learnt from is an error."""
        seen: dict[str, Column] = {}
        for j in self.jobs:
            y, bad = F.col(j.label), F.col(j.label).isNull() | F.isnan(F.col(j.label).cast("double"))
            if isinstance(j.estimator, GBTClassifier):
                bad = bad | ~y.isin(0, 1)
            m = self._mask(j.rows)
            seen[f"n{m}"] = F.count_if(j.rows).alias(f"n{m}")
            seen[f"bad{m}_{j.label}"] = F.count_if(j.rows & bad).alias(f"bad{m}_{self._labels[j.label]}")
        row = table.agg(*seen.values()).first().asDict()
        if any(v for c, v in row.items() if c.startswith("bad")):
            raise ValueError("labels must be known, and 0 or 1 for a classifier")
        if not all(v for c, v in row.items() if c.startswith("n")):
            raise ValueError("a booster has no rows to be fitted on")
        return {int(c[1:]): v for c, v in row.items() if c.startswith("n")}

    def _thresholds(self, table: DataFrame, vector: str) -> dict[tuple, list[np.ndarray]]:
        """MLlib's split candidates of every column by (mask, bins, seed), from the rows that its own sample takes."""
        counts = self._count(table)
        keys = list(dict.fromkeys(self._candidates(j) for j in self.jobs))
        share = {(m, b, s): min(1.0, max(b * b, 10_000) / counts[m]) for m, b, s in keys}
        at = {m: i for i, m in enumerate(dict.fromkeys(m for m, _, _ in keys))}
        conditions = [c for m, c in self._masks.values() if m in at]
        order = [m for m, _ in self._masks.values() if m in at]
        rows = table.select(vector_to_array(vector).alias("x"), *[F.coalesce(c, F.lit(False)).alias(f"m{m}") for m, c in zip(order, conditions, strict=True)])

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            samples = [BernoulliSample(share[k], first_int(k[2]), part) for k in keys]
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                inside = {m: np.flatnonzero(b.column(f"m{m}").to_numpy(zero_copy_only=False)) for m in order}
                for i, (k, sample) in enumerate(zip(keys, samples, strict=True)):
                    taken = x[inside[k[0]][sample.take(len(inside[k[0]]))]]
                    if len(taken):
                        yield _part(i, taken.shape[1], taken)

        picked: dict[int, list[np.ndarray]] = {}
        for b in rows.mapInArrow(pick, _PART).toArrow().to_batches():
            for i, width, body in zip(b.column("job").to_pylist(), b.column("part").to_pylist(), b.column("body"), strict=True):
                picked.setdefault(i, []).append(np.frombuffer(body.as_buffer(), float).reshape(-1, width))
        out = {}
        for i, k in enumerate(keys):
            x = np.concatenate(picked[i])
            out[k] = [_thresholds(x[:, f], min(k[1], counts[k[0]]) - 1, share[k] * counts[k[0]]) for f in range(x.shape[1])]
        return out

    def _pack(self, table: DataFrame, vector: str) -> DataFrame:
        masks, labels = [c for _, c in self._masks.values()], list(self._labels)
        rows = table.select(
            vector_to_array(vector).alias("x"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)],
            *[F.coalesce(c, F.lit(False)).alias(f"m{i}") for i, c in enumerate(masks)],
        )
        edges, width, kind = self.edges, self.width, np.uint8 if self.bins <= 256 else np.uint16
        n_masks, n_labels = len(masks), len(labels)

        def block(part: int, batches: list[pa.RecordBatch], seen: np.ndarray) -> pa.RecordBatch:
            t = pa.Table.from_batches(batches).combine_chunks()
            n = t.num_rows
            x = t.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            bins = np.stack([np.searchsorted(e, x[:, f]).astype(kind) for f, e in enumerate(edges)]) if width else np.zeros((0, n), kind)
            y = np.stack([t.column(f"y{i}").to_numpy().astype(float) for i in range(n_labels)])
            m = np.stack([t.column(f"m{i}").to_numpy(zero_copy_only=False).astype(bool) for i in range(n_masks)])
            firsts = seen.copy()
            seen += m.sum(axis=1)
            cells = [[part], [n], [firsts.tobytes()], [bins.tobytes()], [y.tobytes()], [b"".join(_packed(v) for v in m)], [b""]]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=_COLUMNS)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, n, seen = TaskContext.get().partitionId(), [], 0, np.zeros(n_masks, np.int64)
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    n += b.num_rows
                if n >= BLOCK:
                    yield block(part, held, seen)
                    held, n = [], 0
            if held:
                yield block(part, held, seen)

        return materialize(rows.mapInArrow(pack, _SCHEMA), "bins")

    # --- growing ------------------------------------------------------------------------

    def grow(self, rounds: dict[int, int]) -> None:
        """Grow boosters (by number) to so many trees, or to where they stop."""
        while at := [j for j, n in rounds.items() if self.cut[j] is None and (len(self.trees[j]) < n or (self.jobs[j].stop and len(self.losses[j]) < n))]:
            going = [j for j in at if len(self.trees[j]) - self._written[j] >= KEPT and len(self.trees[j]) < rounds[j]]
            if going:
                self._keep(at)
            self._tree(at, {j for j in at if len(self.trees[j]) >= rounds[j]})

    def _tree(self, jobs: list[int], last: set[int]) -> None:
        """One more tree for each booster; those in ``last`` have all and only learn the loss of the last one."""
        fresh = {j: _Tree() for j in jobs}
        draw = {j: JavaRandom(self.jobs[j].estimator.getSeed() + len(self.trees[j])) for j in jobs}
        opened = {j: [0] for j in jobs}  # places of open nodes, in the order in which MLlib takes them
        level = 0
        while todo := [j for j in jobs if opened[j]]:
            specs = [self._spec(j, fresh[j], [] if j in last else opened[j], level == 0) for j in todo]
            specs = [s for s in specs if s.slots or s.watch is not None]
            found = self._histograms(specs) if specs else {}
            for j in todo:
                counts, sums, squares, loss = found.get(j, (None,) * 4)
                if level == 0 and self.jobs[j].stop and self.trees[j]:
                    self.losses[j].append(loss[1] / loss[0] if loss[0] else math.nan)
                    keep, final = self.jobs[j].stop(self.losses[j])
                    if final or j in last:
                        self.cut[j] = keep
                if j in last or self.cut[j] is not None:
                    fresh[j], opened[j] = None, []
                    continue
                opened[j] = self._split(j, fresh[j], level, opened[j], counts, sums, squares, draw[j])
            level += 1
        for j in jobs:
            if fresh[j] is not None:
                self.trees[j].append(fresh[j])

    def _weight(self, j: int, t: int) -> float:
        return 1.0 if t == 0 else self.jobs[j].estimator.getStepSize()

    def _before(self, j: int) -> tuple:
        return tuple((tuple(tree.splits), tree.values(len(tree.splits)) * self._weight(j, t)) for t, tree in enumerate(self.trees[j]) if t >= self._written[j])

    def _spec(self, j: int, tree: _Tree, opened: list[int], first: bool) -> _Spec:
        job, est = self.jobs[j], self.jobs[j].estimator
        rate = est.getSubsamplingRate()
        return _Spec(
            j, self._mask(job.rows), self._mask(job.watch) if job.watch is not None and first and self.trees[j] else None, self._labels[job.label],
            isinstance(est, GBTClassifier), tuple(job.columns), len(self.trees[j]), self._margins.index(j) if j in self._margins else None, self._before(j),
            tuple(tree.splits), {p: i for i, p in enumerate(opened)}, (rate, est.getSeed() + len(self.trees[j])) if rate < 1.0 else None,
        )

    def _histograms(self, specs: list[_Spec]) -> dict[int, tuple[np.ndarray, ...]]:
        """Per booster the counts and sums of targets by (slot, column, bin), sums of squares by slot, and (rows, loss) of the watched."""
        shape = _Shape(self.width, self.bins, len(self._masks), len(self._labels), len(self._margins))
        size = {s.job: 2 * len(s.slots) * len(s.columns) * self.bins + len(s.slots) + 2 for s in specs}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s.job: np.zeros(size[s.job]) for s in specs}
            some = False
            for b in batches:
                for row in b.to_pylist():
                    some = True
                    _add(held, specs, shape, row)
            if some:
                part = TaskContext.get().partitionId()
                for j, h in held.items():
                    yield _part(j, part, h)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for j, body in zip(b.column("job").to_pylist(), b.column("body"), strict=True):
                    h = np.frombuffer(body.as_buffer(), float)
                    held[j] = held[j] + h if j in held else h
            for j, h in held.items():
                yield _part(j, 0, h)

        total = {s.job: np.zeros(size[s.job]) for s in specs}
        if self._held is not None and self._rows * sum(len(s.columns) for s in specs) <= CELLS:
            for row in self._held:
                _add(total, specs, shape, row)
            return self._cut(specs, total)
        sums = self.blocks.mapInArrow(scan, _PART)
        if 8 * sum(size.values()) * self._parts > DIRECT:
            sums = sums.repartition(MERGERS, "job").mapInArrow(merge, _PART)
        for r in sums.toArrow().to_batches():
            for j, body in zip(r.column("job").to_pylist(), r.column("body"), strict=True):
                total[j] += np.frombuffer(body.as_buffer(), float)
        return self._cut(specs, total)

    def _cut(self, specs: list[_Spec], total: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
        out = {}
        for s in specs:
            cells, k = (len(s.slots), len(s.columns), self.bins), len(s.slots) * len(s.columns) * self.bins
            t = total[s.job]
            out[s.job] = t[:k].reshape(cells), t[k : 2 * k].reshape(cells), t[2 * k : -2], t[-2:]
        return out

    def _split(self, j: int, tree: _Tree, level: int, opened: list[int], counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, draw: JavaRandom) -> list[int]:
        """Split the open nodes by MLlib's rules and give the places of the nodes open at the next level."""
        job, est = self.jobs[j], self.jobs[j].estimator
        allowed, columns = self.allowed[self._candidates(job)], job.columns
        n, total = counts[:, 0].sum(axis=1), sums[:, 0].sum(axis=1)
        whole = level == est.getMaxDepth()
        least, gain_least = max(est.getMinInstancesPerNode(), 1), est.getMinInfoGain()
        per_node = _columns_of(est.getFeatureSubsetStrategy(), len(columns))
        inner, splits = [], {}
        usable = np.zeros((len(columns), self.bins), bool)
        for i, c in enumerate(columns):
            usable[i, : len(allowed[c])] = allowed[c]
        for slot, place in enumerate(opened):
            size, s = n[slot], total[slot]
            mean = s / size if size else 0.0
            impurity = (squares[slot] - s * s / size) / size if size else 0.0
            tree.nodes[level, place] = (size, s, squares[slot], 0.0)
            # A child is a leaf at the full depth or if it is pure; the root is always tried.
            if whole or (level and impurity <= PURE * squares[slot] / max(size, 1.0)):
                continue
            order = reservoir(len(columns), per_node, draw.long()) if per_node < len(columns) else range(len(columns))
            left, left_sum = np.cumsum(counts[slot], axis=1), np.cumsum(sums[slot], axis=1)
            right, right_sum = size - left, s - left_sum
            ok = usable & (left >= least) & (right >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, (left_sum**2 / left + right_sum**2 / right - s * mean) / size, -np.inf)
            gain[gain < gain_least] = -np.inf
            best = gain.argmax(axis=1)
            top = max(order, key=lambda c: gain[c, best[c]], default=None)
            if top is None or not gain[top, best[top]] > 0:
                continue
            tree.nodes[level, place] = (size, s, squares[slot], float(gain[top, best[top]]))
            splits[place] = (columns[top], int(best[top]))
            inner.append(place)
            if level + 1 == est.getMaxDepth():  # leaves: their statistics are those of the two sides
                for side, k, v in ((0, left, left_sum), (1, right, right_sum)):
                    tree.nodes[level + 1, 2 * place + side] = (float(k[top, best[top]]), float(v[top, best[top]]), math.nan, 0.0)
        if splits:
            tree.splits.append(splits)
        if level + 1 == est.getMaxDepth():
            return []
        # Children go on a stack, left before right, and are taken from its top.
        return [p for place in reversed(inner) for p in (2 * place + 1, 2 * place)]

    def _keep(self, jobs: list[int]) -> None:
        """Write the margins of boosters that go on; blocks written for the same end before are deleted."""
        jobs = [j for j in range(len(self.jobs)) if j in jobs or (j in self._margins and self.cut[j] is None)]
        shape = _Shape(self.width, self.bins, len(self._masks), len(self._labels), len(self._margins))
        added = [(self._margins.index(j) if j in self._margins else None, self._before(j)) for j in jobs]

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    bins, margins = shape.bins(row), shape.margins(row)
                    out = [_margin(bins, None if i is None else margins[i], before) for i, before in added]
                    kept = pa.array([np.stack(out).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[pa.array([row[c]], _SCHEMA_ARROW[c]) for c in _COLUMNS[:-1]], kept], names=_COLUMNS)

        path = new_path(self.spark, "margins")
        self.blocks.mapInArrow(keep, _SCHEMA).write.parquet(path)
        self._read(self.spark.read.schema(self.blocks.schema).parquet(path))
        if self._old:
            to = self.spark._jvm.org.apache.hadoop.fs.Path(self._old)
            to.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(to, True)
        self._old, self._margins = path, tuple(jobs)
        for j in jobs:
            self._written[j] = len(self.trees[j])

    # --- models -------------------------------------------------------------------------

    def models(self, jobs: Sequence[int] | None = None) -> list[Model]:
        return self._run(self.spark, [lambda j=j: self.model(j) for j in (range(len(self.jobs)) if jobs is None else jobs)])

    def model(self, j: int) -> Model:
        """The booster as MLlib's model, cut to the trees that its watched rows liked best."""
        job, sc = self.jobs[j], SparkContext._active_spark_context
        jvm, gateway = sc._jvm, sc._gateway
        trees = self.trees[j][: self.cut[j]] if self.cut[j] is not None else self.trees[j]
        own, logistic = {c: i for i, c in enumerate(job.columns)}, isinstance(job.estimator, GBTClassifier)
        kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
        grown, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
        uid = job.estimator.uid
        for t, tree in enumerate(trees):
            root = _java_tree(jvm, sc, tree, self.edges, own)
            grown[t], weights[t] = kind(f"dtr_{uid}_{t}", root, len(own)), self._weight(j, t)
        if logistic:
            out = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, grown, weights, len(own), 2))
        else:
            out = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, grown, weights, len(own)))
        for p in job.estimator.params:
            if job.estimator.isSet(p) and out.hasParam(p.name):
                out.set(out.getParam(p.name), job.estimator.getOrDefault(p))
        out._transfer_params_to_java()
        return out


_COLUMNS = ["part", "n", "firsts", "bins", "labels", "masks", "margins"]
_SCHEMA = "part long, n long, firsts binary, bins binary, labels binary, masks binary, margins binary"
_SCHEMA_ARROW = dict(zip(_COLUMNS, [pa.int64(), pa.int64(), *[pa.binary()] * 5], strict=True))
_PART = "job long, part long, body binary"


def _part(job: int, part: int, body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([job], pa.int64()), pa.array([part], pa.int64()), pa.array([body.tobytes()], pa.binary())], names=["job", "part", "body"])


@dataclass(frozen=True)
class _Shape:
    """How the parts of a block are read."""

    width: int
    n_bins: int
    n_masks: int
    n_labels: int
    n_margins: int

    def bins(self, row: dict) -> np.ndarray:
        return np.frombuffer(row["bins"], np.uint8 if self.n_bins <= 256 else np.uint16).reshape(self.width, row["n"])

    def labels(self, row: dict) -> np.ndarray:
        return np.frombuffer(row["labels"], float).reshape(self.n_labels, row["n"])

    def mask(self, row: dict, i: int) -> np.ndarray:
        size = -(-row["n"] // 8)
        return np.unpackbits(np.frombuffer(row["masks"], np.uint8)[i * size : (i + 1) * size], count=row["n"]).astype(bool)

    def margins(self, row: dict) -> np.ndarray:
        return np.frombuffer(row["margins"], float).reshape(self.n_margins, row["n"])


def _margin(bins: np.ndarray, start: np.ndarray | None, before: tuple) -> np.ndarray:
    out = np.zeros(bins.shape[1]) if start is None else start.copy()
    for splits, values in before:
        out += values[_place(splits, bins)]
    return out


def _add(held: dict[int, np.ndarray], specs: list[_Spec], shape: _Shape, row: dict) -> None:
    """Add one block to the histograms of every booster."""
    bins, labels, margins, nb = shape.bins(row), shape.labels(row), shape.margins(row), shape.n_bins
    firsts, masks = np.frombuffer(row["firsts"], np.int64), {}
    for s in specs:
        if s.mask not in masks:
            masks[s.mask] = shape.mask(row, s.mask)
        use, y, out = masks[s.mask], labels[s.label], held[s.job]
        y = 2.0 * y - 1.0 if s.logistic else y
        margin = _margin(bins, None if s.kept is None else margins[s.kept], s.before) if s.done else None
        if s.watch is not None:
            w = shape.mask(row, s.watch)
            z = -2.0 * y[w] * margin[w] if s.logistic else y[w] - margin[w]
            out[-2] += len(z)
            out[-1] += 2.0 * np.logaddexp(0.0, z).sum() if s.logistic else (z * z).sum()
        if not s.slots:
            continue
        if s.sample:
            inside = np.flatnonzero(use)
            rate, seed = s.sample
            inside = inside[doubles(seed + row["part"] + 1, int(firsts[s.mask]), len(inside)) < rate]
        else:
            inside = np.flatnonzero(use)
        place = _place(s.splits, bins)[inside]
        slots = np.full(1 << len(s.splits), -1, np.int64)
        slots[list(s.slots)] = list(s.slots.values())
        slot = slots[place]
        if (slots < 0).any():
            inside, slot = inside[slot >= 0], slot[slot >= 0]
        y = y[inside]
        if margin is None:
            target = y
        else:
            m = margin[inside]
            target = 4.0 * y / (1.0 + np.exp(2.0 * y * m)) if s.logistic else 2.0 * (y - m)
        k, cells = len(s.slots), len(s.slots) * nb
        base, size = slot * nb, k * len(s.columns) * nb
        counts, sums = out[:size].reshape(k, len(s.columns), nb), out[size : 2 * size].reshape(k, len(s.columns), nb)
        cell = np.empty_like(base)
        for i, c in enumerate(s.columns):
            np.add(base, bins[c][inside], out=cell)
            counts[:, i] += np.bincount(cell, minlength=cells).reshape(k, nb)
            sums[:, i] += np.bincount(cell, target, cells).reshape(k, nb)
        out[2 * size : -2] += np.bincount(slot, target * target, k)


def _columns_of(strategy: str, n: int) -> int:
    """Columns that a node of a lone tree may split on, by MLlib's names and numbers."""
    named = {"auto": n, "all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    try:
        return min(int(strategy), n)
    except ValueError:
        return math.ceil(float(strategy) * n)


def _thresholds(sample: np.ndarray, most: int, expected: float) -> np.ndarray:
    """At most about ``most`` cuts between the values of a sample at even counts, where MLlib puts them.

    Zeros are not counted but are what is missing to the ``expected`` size of the sample.
    """
    values, counts = np.unique(sample[sample != 0.0], return_counts=True)
    if not len(values):
        return np.zeros(0)
    counts, known = counts.astype(float), int(counts.sum())
    if expected - known > 2.0**-52 * known * 100:
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - known)
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) <= most:
        return between
    out, stride = [], expected / (most + 1)
    target, now = stride, counts[0]
    for i in range(1, len(values)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _java_tree(jvm, sc: SparkContext, tree: _Tree, edges: list[np.ndarray], own: dict[int, int]):
    """Root node of MLlib's tree; two leaves of the same value become one, as MLlib prunes."""
    tree_ns, impurity_ns = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity
    keys = sorted(tree.nodes)
    flat = np.array([[n, s, 0.0 if math.isnan(q) else q] for n, s, q, _ in (tree.nodes[k] for k in keys)]).ravel()
    stats, at = _py2java(sc, DenseVector(flat)).values(), {k: i for i, k in enumerate(keys)}

    def node(level: int, place: int):
        n, s, q, gain = tree.nodes[level, place]
        i, mean = at[level, place], s / n if n else 0.0
        impurity = (q - s * s / n) / n if n and not math.isnan(q) else -1.0
        calc = impurity_ns.VarianceCalculator(jvm.java.util.Arrays.copyOfRange(stats, 3 * i, 3 * i + 3), int(n))
        split = tree.splits[level].get(place) if level < len(tree.splits) else None
        if split is not None:
            (left, a), (right, b) = node(level + 1, 2 * place), node(level + 1, 2 * place + 1)
            if a is not None and a == b:
                mean = a
            else:
                column, last = split
                cut = tree_ns.ContinuousSplit(own[column], float(edges[column][last]))
                return tree_ns.InternalNode(mean, impurity, gain, left, right, cut, calc), None
        return tree_ns.LeafNode(mean, impurity, calc), mean

    return node(0, 0)[0]
