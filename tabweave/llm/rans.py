"""Token ids as files of entropy-coded blocks: static range asymmetric numeral system, interleaved lanes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import batches_by_bytes, column_of, keep, query, table, trimmed
from tabweave.llm.tokens import encoder
from tabweave.session import new_path

SCALE_BITS = 20
LANES = 2048
#: Tokens of a block and between two checkpoints inside it.
BLOCK_TOKENS = 1 << 19
CHECKPOINT_TOKENS = 1 << 17
MAGIC = b"RNS1"
_LOW = np.uint64(1 << 32)
_HEAD = struct.Struct("<4sIIIIIII")


class Table:
    """Shared frequencies: ``freq`` sums to 2**SCALE_BITS, every id has at least one."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbol

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Counts scaled to the total, at least one each; the largest remainders get what is left."""
        room = (1 << SCALE_BITS) - len(counts)
        exact = counts.astype(np.float64) * (room / max(1, int(counts.sum())))
        freq = np.floor(exact).astype(np.int64)
        short = room - int(freq.sum())
        best = np.argsort(-(exact - freq), kind="stable")
        freq[best[: short % len(counts)]] += 1
        freq += short // len(counts)
        return cls(freq + 1)

    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, tab: Table, lanes: int = LANES, every: int = CHECKPOINT_TOKENS) -> bytes:
    """One self-contained block: head, checkpoints (lane states and place in the stream), words, checksums.

    Token i belongs to lane i mod lanes.  All lanes move together, last tokens first, so that
    the decoder reads forward.  A checkpoint holds what a decoder needs to begin there.
    """
    n, lanes = len(ids), max(1, min(lanes, len(ids)))
    steps = -(-n // lanes)
    per = max(1, every // lanes)
    freq, cum = tab.freq[ids], tab.cum[ids]
    state = np.full(lanes, _LOW, np.uint64)
    limit_shift = np.uint64(64 - SCALE_BITS)
    out, written, points = [], 0, {}
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * lanes : (s + 1) * lanes], cum[s * lanes : (s + 1) * lanes]
        x = state[: len(f)]
        over = (x >> limit_shift) >= f  # x >= f << (64 - SCALE_BITS)
        words = (x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
        out.append(words)
        written += len(words)
        x[over] >>= np.uint64(32)
        q = x // f
        x[:] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + c
        if s % per == 0:
            points[s] = (written, state.copy())
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    marks = b"".join(struct.pack("<II", s, written - w) + st.astype("<u8").tobytes() for s, (w, st) in sorted(points.items()))
    body = marks + stream.tobytes()
    head = _HEAD.pack(MAGIC, n, lanes, per, len(points), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), tab.crc())
    return head + struct.pack("<I", zlib.crc32(head + body)) + body


def decode_block(block: bytes, tab: Table, first: int = 0) -> np.ndarray:
    """Ids of a block from checkpoint ``first`` on; wrong bytes, tables or ids raise ValueError."""
    magic, n, lanes, per, n_points, n_words, ids_crc, table_crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size + 4 :]
    if magic != MAGIC or table_crc != tab.crc() or struct.unpack_from("<I", block, _HEAD.size)[0] != zlib.crc32(body, zlib.crc32(block[: _HEAD.size])):
        raise ValueError("damaged block or another frequency table")
    if not n:
        return np.zeros(0, np.uint32)
    width = 8 + 8 * lanes
    step, at = struct.unpack_from("<II", body, first * width)
    state = np.frombuffer(body, "<u8", lanes, first * width + 8).astype(np.uint64)
    stream = np.frombuffer(body, "<u4", n_words, n_points * width).astype(np.uint64)
    symbol, mask = tab.symbol, np.uint64((1 << SCALE_BITS) - 1)
    out = np.empty(n - step * lanes, np.uint16)
    done = 0
    for s in range(step, -(-n // lanes)):
        x = state[: min(lanes, n - s * lanes)]
        slot = x & mask
        got = symbol[slot]
        out[done : done + len(got)] = got
        done += len(got)
        x[:] = tab.freq[got] * (x >> np.uint64(SCALE_BITS)) + slot - tab.cum[got]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << np.uint64(32)) | stream[at : at + len(low)]
        at += len(low)
    ids = out.astype(np.uint32)
    if first == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids differ from those that were written")
    return ids


def _tokenize(docs: DataFrame, path: str, end_id: int, n_parts: int) -> DataFrame:
    """Documents in doc_id order over range partitions: part, place, doc_id, inside (ids of the part before it), n, ids.

    Each part also has one row of place -1 with the counts of its ids.
    """
    names = ["part", "place", "doc_id", "inside", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path, False), TaskContext.get().partitionId()
        counts, seen, inside = np.zeros(1 << 16, np.int64), 0, 0
        for data in batches_by_bytes(batches, "text", 4 << 20):
            ends, ids = enc.texts(column_of(data, "text"))
            n = np.diff(ends) + 1
            flat = np.full(int(n.sum()), end_id, np.uint16)
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            counts += np.bincount(flat, minlength=1 << 16)
            cuts = np.concatenate([[0], np.cumsum(n)])
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((cuts * 2).astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(seen + np.arange(len(n))), column_of(data, "doc_id"), pa.array(inside + cuts[:-1]), pa.array(n), raw.cast(pa.binary())], names=names
            )
            seen, inside = seen + len(n), inside + int(cuts[-1])
        tail = [pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([inside], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(tail, names=names)

    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = ranged.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id")
    return keep(ranged.mapInArrow(trimmed(run), "part int, place long, doc_id long, inside long, n long, ids binary"), "ids")


def _sum_counts(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, dict[int, int]]:
    """Counts of all ids, and tokens of each part.  The driver gets one number an id and one a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for raw in b.column("ids").to_pylist():
                total += np.frombuffer(raw, "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    marks = tokens.filter("place = -1")
    counts = np.zeros(vocabulary, np.int64)
    for r in marks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts, {r["part"]: r["n"] for r in marks.select("part", "n").collect()}


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 0, vocabulary: int = 50_257, n_parts: int | None = None) -> None:
    """Encode documents in ascending doc_id order (nulls first) into block files under ``folder``.

    ``folder/table`` has the frequency table shared by all blocks, ``folder/blocks`` one row a
    block: the place of its first id among all, the documents in it (doc_id and length, whole
    documents only) and its bytes.  Parquet is the container, as Spark writes it to any
    shared store; every block decodes by itself.  Texts cross one shuffle, to be ordered;
    ids cross none.
    """
    spark = docs.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = _tokenize(docs, path, end_id, n_parts)
    counts, per_part = _sum_counts(tokens, vocabulary)
    freq = Table.of_counts(counts).freq.astype(np.uint32)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    base, before = {}, 0
    for part in sorted(per_part):
        base[part] = before
        before += per_part[part]
    names = ["first", "n", "doc_ids", "lengths", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(freq)

        def block(rows: pa.Table) -> pa.RecordBatch:
            raw = column_of(rows, "ids")
            ids = np.frombuffer(b"".join(raw.to_pylist()), "<u2")
            first = base[rows.column("part")[0].as_py()] + rows.column("inside")[0].as_py()
            one = pa.array([0, rows.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, column_of(rows, c)) for c in ("doc_id", "n")]
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(ids)]), *lists, pa.array([encode_block(ids, shared)], pa.binary())], names=names)

        # Rows of a part come in order; a task may read the rest of a part, or several parts.
        held, size, last = [], 0, None
        for b in batches:
            part, place, n = b.column("part").to_numpy(), b.column("place").to_numpy(), b.column("n").to_numpy()
            follows = np.empty(len(n), bool)
            follows[1:] = (part[1:] == part[:-1]) & (place[1:] == place[:-1] + 1)
            follows[0] = last == (part[0], place[0] - 1)
            at = 0
            for i in range(len(n)):
                if (not follows[i] or size >= BLOCK_TOKENS) and size:
                    yield block(pa.Table.from_batches([*held, b.slice(at, i - at)]).combine_chunks())
                    held, size, at = [], 0, i
                size += int(n[i])
            held.append(b.slice(at))
            last = (part[-1], place[-1])
        if size:
            yield block(pa.Table.from_batches(held).combine_chunks())

    kind = "first long, n long, doc_ids array<long>, lengths array<long>, bytes binary"
    tokens.filter("place >= 0").mapInArrow(trimmed(run), kind).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    freq = np.array([r["freq"] for r in spark.read.parquet(f"{folder}/table").orderBy("id").collect()], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(freq)
        for b in batches:
            for i in range(b.num_rows):
                data = decode_block(b.column("bytes")[i].as_py(), shared).astype("<u4")
                docs, n = b.column("doc_ids")[i].values, b.column("lengths")[i].values.to_numpy()
                cuts = np.concatenate([[0], np.cumsum(n)])
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((cuts * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([docs, pa.array(b.column("first")[i].as_py() + cuts[:-1]), pa.array(n), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


@query("op7_rans_blocks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "rans")
    write_ids(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
