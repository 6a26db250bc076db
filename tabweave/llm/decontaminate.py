"""Benchmark decontamination: test n-grams as a broadcast hash set, training texts scanned window by window."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import batches_by_bytes, column_of, gram_hashes, keep, mix, query, rows_of, table, trim, words_of

SIZE = 10
#: Bytes of benchmark words in one broadcast; a larger benchmark is cut into several, searched one after another.
SLICE_BYTES = 8 << 20
#: Words of an item in one row; longer items are cut into rows that overlap by a window less one word.
PIECE_WORDS = 4_096
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _as_words() -> np.ndarray:
    """What each byte of a text becomes: A-Z lower-cased, other ASCII but a-z and 0-9 a space, all else itself."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    for first, last, shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x41, 0x5A, 32)):
        out[first : last + 1] = np.arange(first, last + 1) + shift
    return out


def normal_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text and all words, lower-cased; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is not None and data.size:
        data = pa.py_buffer(_as_words()[np.frombuffer(data, np.uint8)])
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, data], offset=texts.offset))


@dataclass
class Windows:
    """Windows of one length: sorted distinct hashes, a place in the slice that has each, and the number of its set of items."""

    hashes: np.ndarray
    place: np.ndarray
    sets: np.ndarray


@dataclass
class Slice:
    """A part of the benchmark: its vocabulary, all its words as numbers, windows by length, and the items of each set."""

    vocabulary: pa.Array
    words: np.ndarray
    windows: dict[int, Windows]
    items: list[tuple[str, ...]]
    seed: int

    def hashed(self, ids: np.ndarray, size: int) -> np.ndarray:
        return mix(gram_hashes(mix(ids.astype(np.uint64) + np.uint64(1 + (self.seed << 40))), size))

    def equal(self, ids: np.ndarray, at: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows of ``ids`` that begin at ``at`` are those of the slice at ``place``, word by word."""
        out = np.ones(len(at), bool)
        for k in range(size):
            out &= ids[at + k] == self.words[place + k]
        return out


def build_slice(pieces: pa.Table, size: int = SIZE) -> Slice:
    """The search structure of rows (item, words): words is an item's text in words with single spaces."""
    names = pieces.column("item").to_pylist()
    offsets, words = words_of(column_of(pieces, "words"))
    coded = words.dictionary_encode()
    lengths, sets = np.diff(offsets), {}
    out = Slice(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), {}, [], 0)
    sizes = [m for m in np.unique(np.minimum(lengths, size)).tolist() if m]
    while len(out.windows) < len(sizes):
        m = sizes[len(out.windows)]
        mine = np.flatnonzero(lengths >= size if m == size else lengths == m)
        n = lengths[mine] - m + 1
        first = np.arange(int(n.sum())) + np.repeat(offsets[mine] - (np.cumsum(n) - n), n)
        hashes, some, which = np.unique(out.hashed(out.words, m)[first], return_index=True, return_inverse=True)
        if not out.equal(out.words, first, first[some][which], m).all():  # different windows share a hash
            out = Slice(out.vocabulary, out.words, {}, [], out.seed + 1)
            continue
        pairs = np.unique(np.stack([which, np.repeat(mine, n)], 1), axis=0)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(hashes) + 1))
        number = [sets.setdefault(tuple(sorted({names[i] for i in pairs[a:z, 1]})), len(sets)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        out.windows[m] = Windows(hashes, first[some], np.array(number, np.int64))
    out.items = list(sets)
    return out


def _occurrences(ids: np.ndarray, offsets: np.ndarray, part: Slice) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, first words, numbers of item sets) of every window of ``part`` in texts of word numbers (-1: not in it)."""
    after = np.concatenate([[0], np.cumsum(ids < 0)])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(len(ids))
    for m, w in part.windows.items():
        at = place[: max(0, len(ids) - m + 1)]
        at = at[(at + m <= ends[at]) & (after[at + m] == after[at])]
        if not len(at):
            continue
        h = part.hashed(ids, m)[at]
        spot = np.minimum(np.searchsorted(w.hashes, h), len(w.hashes) - 1)
        hit = w.hashes[spot] == h
        at, spot = at[hit], spot[hit]
        same = part.equal(ids, at, w.place[spot], m)
        yield m, at[same], w.sets[spot[same]]


def _scan(texts: pa.Array, parts) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Word offsets per text, whether each word is hit, and the items found in each text."""
    offsets, words = normal_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.zeros(len(codes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for held in parts:
        part: Slice = held.value
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=part.vocabulary), -1).to_numpy(zero_copy_only=False)
        ids = known.astype(np.int32)[codes] if len(codes) else np.zeros(0, np.int32)
        for m, at, number in _occurrences(ids, offsets, part):
            np.add.at(step, at, 1)
            np.add.at(step, at + m, -1)
            doc = np.searchsorted(offsets, at, side="right") - 1
            for d, s in np.unique(np.stack([doc, number], 1), axis=0).tolist():
                items[d].update(part.items[s])
        if len(parts) > 1:  # a worker holds one slice at a time; the next batch reads it again from the executor's disk
            vars(held).pop("_value", None)
    return offsets, np.cumsum(step[:-1]) > 0, items


def broadcast_benchmark(benchmark: DataFrame, size: int = SIZE) -> list:
    """The windows of ``benchmark`` (item_id, text) as broadcasts of at most about ``SLICE_BYTES`` each.

    Items become rows of at most ``PIECE_WORDS`` words; their bytes are added up first, and each
    slice is collected, indexed and broadcast by itself.  So neither the driver nor a task holds more
    than one slice, whatever the size of the benchmark.
    """
    spark = benchmark.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches_by_bytes(batches, "text"):
            offsets, words = normal_words(column_of(data, "text"))
            names = column_of(data, "item")
            item, lists = [], []
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for at in range(a, max(a + 1, z - size + 1), PIECE_WORDS - size + 1) if z > a else ():
                    item.append(i)
                    lists.append(" ".join(words.slice(at, min(z - at, PIECE_WORDS)).to_pylist()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(item, pa.int64())), pa.array(lists, pa.string())], names=["item", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = keep(rows.mapInArrow(cut, "item string, words string").distinct(), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 16)).first()[0] or 0
    n = rows_of(int(total), SLICE_BYTES)
    return [spark.sparkContext.broadcast(build_slice(pieces.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == i).toArrow(), size)) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """How much of each document stands in the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    One row for each row of ``docs`` (doc_id, text; other columns, whatever their names, are not read),
    repeated rows and null ids included.  Words are compared with A-Z lower-cased, punctuation apart.
    A word is hit when it stands in a run of ``size`` words that an item of ``benchmark``
    (item_id, text) also has; items of fewer words count as a whole; items without words never occur.
    Null and empty texts have no words and are clean; an item_id that several rows have is one item,
    a null one is the empty string; an empty benchmark leaves all clean.  Texts are scanned whole, of any length.

    The scan has no shuffle.  Hashes only find the candidates: words are compared.
    """
    parts = broadcast_benchmark(benchmark, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: dict[frozenset, str] = {}
        for data in batches_by_bytes(batches, "text"):
            offsets, hit, items = _scan(column_of(data, "text"), parts)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[offsets[1:]] - total[offsets[:-1]]
            for s in items:
                key = frozenset(s)
                if key not in digests:
                    digests[key] = hashlib.sha256(",".join(sorted(key)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(data, "doc_id"), pa.array(np.diff(offsets)), pa.array(n_hit), pa.array([len(s) for s in items], pa.int64()),
                    pa.array([digests[frozenset(s)] for s in items], pa.string()), pa.array(n_hit > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )
            digests = digests if len(digests) < 100_000 else {}
            trim()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, remove: str = "spans") -> DataFrame:
    """``docs`` without what it shares with ``benchmark``: hit words cut out (``spans``) or hit documents left out (``documents``).

    All columns stay as they are, whatever their names, but ``n_chars`` follows a text that is cut.  A run of
    hit words goes with what stands between it and the next word; a document left without words goes.
    Documents without a hit, null and empty texts stay unchanged; see :func:`contamination` for what is hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    parts = broadcast_benchmark(benchmark, size)
    names, place = list(docs.columns), docs.columns.index("text")
    follows = names.index("n_chars") if "n_chars" in names else -1

    def cut(text: str, hit: np.ndarray) -> str:
        starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        out, at = [], 0
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            out.append(text[at : starts[first]])
            at = starts[end]
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches_by_bytes(batches, names[place]):
            texts = column_of(data, names[place])
            offsets, hit, _ = _scan(texts, parts)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit, n = total[offsets[1:]] - total[offsets[:-1]], np.diff(offsets)
            stay = np.flatnonzero(n_hit == 0 if remove == "documents" else (n_hit == 0) | (n_hit < n))
            out = data.take(pa.array(stay))
            columns = [c.combine_chunks() for c in out.columns]
            if remove == "spans" and n_hit[stay].any():
                new = texts.take(pa.array(stay)).to_pylist()
                sizes = columns[follows].to_pylist() if follows >= 0 else []
                for i in np.flatnonzero(n_hit[stay]).tolist():
                    d = stay[i]
                    new[i] = cut(new[i], hit[offsets[d] : offsets[d + 1]])
                    if follows >= 0:
                        sizes[i] = len(new[i])
                columns[place] = pa.array(new, pa.string())
                if follows >= 0:
                    columns[follows] = pa.array(sizes, columns[follows].type)
            for b in pa.Table.from_arrays(columns, names=data.schema.names).to_batches():
                yield b
            trim()

    return docs.mapInArrow(run, docs.schema)


@query(
    "op13_benchmark_ngrams",
    r"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
    ), items AS (
        SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM items, unnest(range(1, greatest(len(w) - 8, 2))) t(i) WHERE len(w) > 0
    ), grams AS (
        SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM docs, (SELECT DISTINCT m FROM windows), unnest(range(1, len(w) - m + 2)) t(i) WHERE len(w) >= m
    ), found AS (SELECT r, i, m, item FROM grams JOIN windows USING (m, g)
    ), hits AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM found, unnest(range(0, m)) u(k)) GROUP BY r
    ), named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(a.n, 0)::BIGINT AS n_items,
           sha256(coalesce(a.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits h USING (r) LEFT JOIN named a USING (r)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
