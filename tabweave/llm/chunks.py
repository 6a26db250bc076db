"""Documents in chunks of coded words, and questions that chunks put to hash fragments.

Statistics over all n-grams would move a row for every position of the corpus.  Here a
chunk (some megabytes of whole documents) first sums up what it holds, sends every n-gram
once to the fragment that owns its hash range, as one compressed array a fragment, and
gets one small answer for each n-gram it sent.  An n-gram that a third of all documents
share is thus one entry a chunk, no matter how often it occurs.  Chunks and answers are written
tables, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import batches_by_bytes, coded_words, column_of, keep, keep_in_buckets, trim, trimmed

CHUNK_BYTES = 4 << 20
#: Entries of a fragment, about; the number of fragments follows the corpus.
FRAGMENT_ENTRIES = 1 << 20
#: Answers up to this size are broadcast to the chunks; beyond, both are shuffled by chunk.
BROADCAST_BYTES = 48 << 20
#: Spark's own limit of buckets is 100,000.
MOST_BUCKETS = 50_000
#: Stands for a null doc_id: after all others.
NULL_ID = np.iinfo(np.int64).max


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight lie together, which suits small numbers."""
    out = [struct.pack("<I", len(arrays))]
    packer = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        data = packer.compress(planes)
        out += [struct.pack("<3sQQ", a.dtype.str[-2:].encode().ljust(3, b"\0"), len(a), len(data)), data]
    return b"".join(out)


def stretch(data: bytes) -> list[np.ndarray]:
    view, at, out = memoryview(data), 4, []
    unpacker = zstandard.ZstdDecompressor()
    for _ in range(struct.unpack_from("<I", view)[0]):
        kind, n, size = struct.unpack_from("<3sQQ", view, at)
        at += struct.calcsize("<3sQQ")
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        raw = unpacker.decompress(view[at : at + size], max_output_size=max(1, n * dtype.itemsize)) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n) if n else np.zeros(0, dtype))
        at += size
    return out


def squeeze_sorted(keys: np.ndarray, *more: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)), *more)


def stretch_sorted(data: bytes) -> list[np.ndarray]:
    gaps, *more = stretch(data)
    return [np.cumsum(gaps, dtype=np.uint64), *more]


@dataclass
class Chunk:
    """Documents of a chunk: ids, marks, token offsets, word codes, the hash of each code, and the answers so far."""

    number: int
    ids: np.ndarray
    marks: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray

    @property
    def words(self) -> np.ndarray:
        return self.hashes[self.codes]

    def doc_of(self, lengths: np.ndarray | None = None) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.offsets) if lengths is None else lengths)


def chunk_documents(docs: DataFrame, mark: Column | None = None, size: int = CHUNK_BYTES, buckets: bool = False) -> DataFrame:
    """Written table of chunks (chunk, tokens, body) of ``docs`` (doc_id, text); ``mark`` is a small number kept for each document.

    With ``buckets``, about as many as chunks, ``each_answered`` does not shuffle the bodies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for data in batches_by_bytes(batches, "text", size):
            offsets, codes, hashes = coded_words(column_of(data, "text"))
            ids = column_of(data, "doc_id").fill_null(NULL_ID).to_numpy()
            marks, keys = column_of(data, "mark").to_numpy(), column_of(data, "key").to_numpy()
            body = squeeze(ids, marks.astype(np.uint8), keys, np.diff(offsets).astype(np.uint32), codes.astype(np.uint32), hashes)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(codes)]), pa.array([body], pa.binary())], names=["chunk", "tokens", "body"])
            number += 1

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (F.lit(0) if mark is None else mark).cast("int").alias("mark"), F.xxhash64("text").alias("key"),
    )
    chunks = rows.mapInArrow(trimmed(run), "chunk long, tokens long, body binary")
    if not buckets:
        return keep(chunks, "chunks")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return keep_in_buckets(chunks, "chunks", "chunk", min(MOST_BUCKETS, max(1, -(-total // size))))


def fragments_for(chunks: DataFrame, per_token: float = 1.0) -> int:
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    return max(1, -(-int(total * per_token) // FRAGMENT_ENTRIES))


def _chunk(rows: pa.RecordBatch | pa.Table, i: int) -> Chunk:
    ids, marks, keys, lengths, codes, hashes = stretch(rows.column("body")[i].as_py())
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return Chunk(rows.column("chunk")[i].as_py(), ids, marks, keys, offsets, codes, hashes)


def each_chunk(chunks: DataFrame, fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Rows (as dicts of arrays, one dict a batch) that ``fn(chunk, {column: value})`` makes of every chunk."""
    extra = [c for c in chunks.columns if c not in ("chunk", "tokens", "body")]

    def one(b: pa.RecordBatch, i: int) -> list[pa.RecordBatch]:
        found = fn(_chunk(b, i), {c: b.column(c)[i].as_py() for c in extra})
        return [pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out)) for out in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from one(b, i)
                trim()

    return chunks.mapInArrow(run, schema)


def each_answered(chunks: DataFrame, replies: dict[str, DataFrame], fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Rows (at least one dict a chunk) that ``fn(chunk, {name: replies in order of fragments})`` makes of every chunk; bodies in buckets stay where they are, replies move."""
    names = list(replies)
    told = reduce(DataFrame.unionByName, (r.select("chunk", F.lit(i).alias("kind"), "fragment", "reply") for i, r in enumerate(replies.values())))

    def run(body: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(zip(told.column("kind").to_pylist(), told.column("fragment").to_pylist(), range(told.num_rows), strict=True))
        extra = {name: [told.column("reply")[i].as_py() for kind, _, i in rows if names[kind] == name] for name in names}
        out = [pa.table(d) for i in range(body.num_rows) for d in fn(_chunk(body, i), extra)]
        trim()
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def questions(number: int, keys: np.ndarray, more: list[np.ndarray], n_fragments: int, tag: int = 0, top: np.ndarray | None = None) -> Iterator[dict]:
    """Sorted distinct ``keys`` of a chunk, cut by the fragment that owns them: ``top``, or that of its range of hashes."""
    if top is None:
        top = (keys >> np.uint64(32)) * np.uint64(n_fragments) >> np.uint64(32)
    cuts = np.searchsorted(top, np.arange(n_fragments + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        parts = [squeeze_sorted(keys[a:z], *(m[a:z] for m in more)) for a, z in zip(cuts[some], cuts[some + 1], strict=True)]
        yield {"fragment": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), number, np.int64)), "tag": pa.array(np.full(len(some), tag, np.int32)), "part": pa.array(parts, pa.binary())}


QUESTION = "fragment int, chunk long, tag int, part binary"


def answers(asked: DataFrame, fn: Callable[[list[int], list[int], list[list[np.ndarray]]], Iterator[tuple[int, bytes]]], buckets: int = 0) -> DataFrame:
    """Written table (chunk, fragment, reply), in ``buckets`` by fragment if given: ``fn(chunks, tags, parts)`` sees all that reached one fragment."""

    def reply(group: pa.Table) -> pa.Table:
        parts = [stretch_sorted(x) for x in group.column("part").to_pylist()]
        fragment = group.column("fragment")[0].as_py()
        got = list(fn(group.column("chunk").to_pylist(), group.column("tag").to_pylist(), parts))
        return pa.table(
            {"chunk": pa.array([c for c, _ in got], pa.int64()), "fragment": pa.array([fragment] * len(got), pa.int32()), "reply": pa.array([r for _, r in got], pa.binary())}
        )

    def run(group: pa.Table) -> pa.Table:
        out = reply(group)
        trim()
        return out

    found = asked.groupBy("fragment").applyInArrow(run, "chunk long, fragment int, reply binary")
    return keep_in_buckets(found, "answers", "fragment", min(MOST_BUCKETS, buckets)) if buckets else keep(found, "answers")


def with_answers(chunks: DataFrame, replies: DataFrame, name: str, small: bool = True) -> DataFrame:
    """Chunks and their replies in order of fragments, as a column ``name`` (null: nothing was asked).

    Replies that may be ``small`` are measured and broadcast if they are; others are always shuffled.
    """
    size = (replies.agg(F.sum(F.length("reply"))).first()[0] or 0) if small else BROADCAST_BYTES + 1
    mine = replies.groupBy(F.col("chunk").alias("_chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("fragment", "reply"))), lambda x: x["reply"]).alias(name))
    return chunks.join(F.broadcast(mine) if size <= BROADCAST_BYTES else mine, F.col("chunk") == F.col("_chunk"), "left").drop("_chunk")


def joined(replies: list[bytes] | None, dtype) -> list[np.ndarray]:
    """The arrays of all replies to a chunk, end to end: in the order of the keys it asked for."""
    parts = [stretch(r) for r in replies or []]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype)]
