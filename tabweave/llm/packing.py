"""Packing documents into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import batches_by_bytes, column_of, keep, query, table, trimmed
from tabweave.llm.tokens import encoder
from tabweave.operators.ordering import row_index

SEQUENCE = 4096
END_ID = 1


def cut_documents(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of documents: doc_id, row, piece, start, length, ids_crc32 (and ids, on request).

    A document is its ids and the end id; only documents longer than ``length`` are cut, and
    their last piece may be shorter.  Null and empty texts are the end id alone.
    """
    kind = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        for data in batches_by_bytes(batches, "text", 4 << 20):
            ends, ids = enc.texts(column_of(data, "text"))
            n = np.diff(ends) + 1
            flat = np.full(int(n.sum()), end_id, np.uint32)
            at = np.cumsum(n) - n
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            count = -(-n // length)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            size = np.minimum(length, n[doc] - start)
            raw, begin = flat.tobytes(), (at[doc] + start) * 4
            crc = [zlib.crc32(memoryview(raw)[b : b + 4 * s]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]
            columns = [
                column_of(data, "doc_id").take(pa.array(doc)), column_of(data, "row").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(size), pa.array(np.array(crc, np.int64)),
            ]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(trimmed(run), kind)


def fullest(free: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Lengths, none more often than its count, whose sum is the largest not above ``free``.

    Subset sums are the bits of one integer.  ``lengths`` is in falling order; the search ends
    as soon as ``free`` itself can be reached, and walks back through the sums before each step.
    """
    mask, reach, steps = (1 << (free + 1)) - 1, 1, []
    for size in lengths:
        if size > free:
            continue
        left, many = min(counts[size], free // size), 1
        while left > 0:
            many = min(many, left)
            steps.append((size, many, reach))
            reach |= (reach << (size * many)) & mask
            left -= many
            many *= 2
            if reach >> free & 1:
                break
        if reach >> free & 1:
            break
    best, out = reach.bit_length() - 1, []
    for size, many, before in reversed(steps):
        if not before >> best & 1:
            out += [size] * many
            best -= size * many
    return out


def minimum_slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (times, [(length, how many)]): each bin is the largest length left and the fullest combination beside it.

    A combination is used as often as the counts allow before the next one is searched, so
    the work depends on the number of different lengths and not on the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v}
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        head = lengths[0]
        rest = dict(left)
        rest[head] -= 1
        inside = sorted([head, *fullest(capacity - head, [x for x in lengths if rest[x]], rest)], reverse=True)
        made = [(x, inside.count(x)) for x in dict.fromkeys(inside)]
        times = min(left[x] // n for x, n in made)
        for x, n in made:
            left[x] -= n * times
        lengths = [x for x in lengths if left[x]]
        out.append((times, made))
    return out


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to written ``pieces`` (column length, 1 .. capacity), filling as few sequences as it can.

    Only the count of each length reaches the driver (``capacity`` numbers at most).  Pieces of
    equal length are interchangeable: each gets its rank among them, and ranks are dealt
    to the bins' places by search in a table of at most a few entries a length.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    first_bin, taken = 0, dict.fromkeys(counts, 0)
    entries: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in counts}
    for times, made in minimum_slack_patterns(counts, capacity):
        offset = 0
        for size, many in made:
            entries[size].append((taken[size], many, first_bin, offset))
            taken[size] += many * times
            offset += size * many
        first_bin += times
    sizes = sorted(entries)
    begin = np.cumsum([0] + [len(entries[x]) for x in sizes])
    rank0, many, bin0, offset0 = (np.array([e[i] for x in sizes for e in entries[x]], np.int64) for i in range(4))
    spot = {x: (int(begin[i]), int(begin[i + 1])) for i, x in enumerate(sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            which = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
                rows = order[lo:hi]
                a, z = spot[int(length[rows[0]])]
                which[rows] = a + np.searchsorted(rank0[a:z], rank[rows], side="right") - 1
            inner = rank - rank0[which]
            seq = bin0[which] + inner // many[which]
            off = offset0[which] + inner % many[which] * length
            columns = {c: b.column(c) for c in b.schema.names if c != "rank"} | {"sequence_id": pa.array(seq), "offset": pa.array(off)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ranked = row_index(pieces, ["row", "piece"], ["length"], "rank")
    kind = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, kind)


def pack_documents(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Documents packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is packed, repeated rows and null ids too; other columns are ignored; an empty table gives no rows.
    """
    cut = keep(cut_documents(docs, path, length, end_id), "pieces")
    return pack(cut, length).drop("row")


@query("op8_minimum_bin_slack")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
