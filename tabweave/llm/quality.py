"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.common import batches_by_bytes, coded_words, column_of, gram_hashes, keep, query, table, trimmed

WORD_BITS = 13
RANK = 8
#: Labelled documents the model is fitted on at most: those with the smallest hashes.
SAMPLE = 16_000
SHARDS, ROUNDS, PASSES, BATCH = 8, 5, 3, 64
RATE, DECAY = 0.1, 1e-5
#: Levels that each statistic is also cut into, so that its effect need not be a straight line.
LEVELS = 8
STATISTICS = ("letters", "capitals", "digits", "spaces", "lines", "marks", "symbols", "beyond_ascii", "word_length", "log_words", "distinct_words", "distinct_pairs", "symbol_words")
WIDTH = (1 << WORD_BITS) + len(STATISTICS) * (1 + LEVELS)

_LETTER, _CAPITAL, _DIGIT, _SPACE, _LINE, _MARK, _SYMBOL, _BEYOND = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    for chars, kind in (
        (range(97, 123), _LETTER), (range(65, 91), _CAPITAL), (range(48, 58), _DIGIT), (b" \t\r\v\f", _SPACE), (b"\n", _LINE), (b".,;:!?'\"-()", _MARK), (range(128, 256), _BEYOND),
    ):
        out[list(chars)] = kind
    return out


_CLASS = _classes()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets per text, feature numbers, values.  Whole texts are read; null and empty ones have their statistics only."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    offsets, codes, hashes = coded_words(texts)
    words = np.diff(offsets)
    cuts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    kinds = _CLASS[raw]
    size = np.maximum(np.diff(cuts), 1)
    stats = np.zeros((n, len(STATISTICS)))
    for kind in range(8):
        run = np.concatenate([[0], np.cumsum(kinds == kind)])
        stats[:, kind] = (run[cuts[1:]] - run[cuts[:-1]]) / size
    doc = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    stats[:, 8] = np.minimum(np.diff(cuts) / some / 20, 3)
    stats[:, 9] = np.log1p(words) / 10

    def distinct(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        pair = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
        return np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n)

    word_hash = hashes[codes]
    stats[:, 10] = distinct(word_hash, doc) / some
    pairs = gram_hashes(word_hash, 2)
    inside = doc[1:] == doc[:-1]
    stats[:, 11] = np.where(words > 1, distinct(pairs[inside], doc[1:][inside]) / np.maximum(words - 1, 1), 1)
    first = np.flatnonzero((kinds != _SPACE) & (kinds != _LINE))
    last = first[np.append(np.diff(first) != 1, True)] if len(first) else first
    odd = last[kinds[last] == _SYMBOL]
    stats[:, 12] = np.bincount(np.searchsorted(cuts, odd, side="right") - 1, minlength=n)[:n] / some if len(odd) else 0
    # words: damped counts, each row of length one
    cell = (doc << WORD_BITS) | (word_hash & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    cell, count = np.unique(cell, return_counts=True)
    owner, value = cell >> WORD_BITS, np.log1p(count)
    value = value / np.sqrt(np.bincount(owner, weights=value * value, minlength=n))[owner]
    level = np.clip((np.sqrt(np.clip(stats, 0, 1)) * LEVELS).astype(np.int64), 0, LEVELS - 1)
    base = 1 << WORD_BITS
    k = len(STATISTICS)
    rows = np.concatenate([owner, np.repeat(np.arange(n), k), np.repeat(np.arange(n), k)])
    number = np.concatenate([cell & (base - 1), np.tile(base + np.arange(k), n), (base + k + np.arange(k) * LEVELS + level).ravel()])
    value = np.concatenate([value, stats.ravel(), np.full(n * k, 0.3)])
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return ends, number[order].astype(np.int32), value[order].astype(np.float32)


@dataclass
class Machine:
    """score(x) = bias + w.x + sum over factors of ((v.x)^2 - (v^2).(x^2)) / 2, linear in the number of features."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Machine:
        return cls(0.0, np.zeros(WIDTH, np.float32), np.random.default_rng(seed).normal(0, 0.05, (WIDTH, RANK)).astype(np.float32))

    def margins(self, ends: np.ndarray, number: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[number] * value[:, None]
        starts = ends[:-1]
        sums = np.add.reduceat(vx, starts, axis=0)
        pair = 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[number] * value, starts) + pair, sums

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias], self.w, self.v.ravel()]).astype("<f4").tobytes()

    @classmethod
    def from_array(cls, a: np.ndarray) -> Machine:
        return cls(float(a[0]), a[1 : 1 + WIDTH].astype(np.float32), a[1 + WIDTH :].reshape(WIDTH, RANK).astype(np.float32))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -40, 40)))


def _descend(m: Machine, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int) -> Machine:
    """Passes of adaptive gradient steps over a shard's rows."""
    rng = np.random.default_rng(seed)
    g_bias, g_w, g_v = 1.0, np.full(WIDTH, 1.0, np.float32), np.full((WIDTH, RANK), 1.0, np.float32)
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in part])])
            number, value = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            y = np.array([p[2] for p in part])
            margin, sums = m.margins(ends, number, value)
            slope = ((_probability(margin) - y) / len(part)).astype(np.float32)
            row = np.repeat(np.arange(len(part)), np.diff(ends))
            touched, at_ = np.unique(number, return_inverse=True)
            e = slope[row] * value
            dw = np.bincount(at_, weights=e, minlength=len(touched)).astype(np.float32) + DECAY * m.w[touched]
            dv = np.zeros((len(touched), RANK), np.float32)
            np.add.at(dv, at_, e[:, None] * (sums[row] - m.v[number] * value[:, None]))
            dv += DECAY * m.v[touched]
            # the accumulators start at one and gradients are small: scale them up together
            g_w[touched] += (50 * dw) ** 2
            g_v[touched] += (50 * dv) ** 2
            m.w[touched] -= RATE * 50 * dw / np.sqrt(g_w[touched])
            m.v[touched] -= RATE * 50 * dv / np.sqrt(g_v[touched])
            d = float(slope.sum())
            g_bias += (50 * d) ** 2
            m.bias -= RATE * 50 * d / g_bias**0.5
    return m


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` rows of ``labelled`` (doc_id, text, label 0/1, spread: a hash that picks rows and deals them).

    Shards descend on their own from the shared state, and their states are averaged after each
    round; a round returns ``SHARDS`` states of fixed size.  No rows: the untrained
    machine, which scores 0.5 or so.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches_by_bytes(batches, "text", 4 << 20):
            ends, number, value = features(column_of(data, "text"))
            cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            cols = [column_of(data, c) for c in ("label", "spread")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([number[a:z].astype("<i4").tobytes() for a, z in cut], pa.binary()), pa.array([value[a:z].astype("<f4").tobytes() for a, z in cut], pa.binary())], names=["label", "spread", "number", "value"])

    rows = keep(labelled.select("text", "label", "spread").mapInArrow(trimmed(extract), "label int, spread long, number binary, value binary"), "features")
    shards = keep(rows.withColumn("shard", F.pmod("spread", F.lit(SHARDS)).cast("int")).repartition(SHARDS, "shard").sortWithinPartitions("shard", "spread"), "fit")
    state = np.frombuffer(Machine.new().to_bytes(), "<f4")

    def descend(start: np.ndarray, turn: int):
        def run(group: pa.Table) -> pa.Table:
            order = np.lexsort((group.column("label").to_numpy(), group.column("spread").to_numpy()))
            number, value, label = (group.column(c).to_pylist() for c in ("number", "value", "label"))
            part = [(np.frombuffer(number[i], "<i4"), np.frombuffer(value[i], "<f4"), label[i]) for i in order]
            m = _descend(Machine.from_array(start.copy()), part, turn)
            return pa.table({"n": pa.array([len(part)], pa.int64()), "state": pa.array([m.to_bytes()], pa.binary())})

        return run

    for turn in range(ROUNDS):
        got = shards.groupBy("shard").applyInArrow(descend(state, turn), "n long, state binary").collect()
        if got:
            state = _average(got)
    return Machine.from_array(state)


def _average(got: list) -> np.ndarray:
    total = sum(g["n"] for g in got)
    return sum(g["n"] / total * np.frombuffer(g["state"], "<f4").astype(np.float64) for g in sorted(got, key=lambda g: (g["n"], g["state"]))).astype("<f4")


def score(docs: DataFrame, m: Machine, name: str = "score") -> DataFrame:
    """Add the probability of label 1 of each whole text; null texts count as empty."""
    state = np.frombuffer(m.to_bytes(), "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.from_array(state)
        for data in batches_by_bytes(batches, "text", 4 << 20):
            margin, _ = machine.margins(*features(column_of(data, "text")))
            columns = {c: column_of(data, c) for c in data.schema.names} | {name: pa.array(_probability(margin))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = T.StructType([*[f for f in docs.schema if f.name != name], T.StructField(name, T.DoubleType())])
    return docs.drop(name).mapInArrow(trimmed(run), schema)


def held_out() -> Column:
    """Documents whose labels are never learnt from: crc32 of the doc_id as text, modulo 3, is 1 (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on labelled documents that aren't held out.  Documents whose labels disagree count as the larger one."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).filter(~held_out())
    spread = F.xxhash64(F.lit(23), "doc_id")
    picked = keep(known.withColumn("spread", spread).orderBy("spread", "doc_id").limit(sample).withColumnRenamed("doc_id", "_id"), "sample")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "label", "spread")
    return fit(rows, sample)


@query("op3_factorisation_machine")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    m = fit_on_labels(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), m)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
