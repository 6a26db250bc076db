"""Repeated passages across documents by sparse suffixes at content-selected positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.chunks import NULL_ID, QUESTION, Chunk, answers, chunk_documents, each_chunk, fragments_for, joined, questions, squeeze, with_answers
from tabweave.llm.common import free_names, gram_hashes, keep, mix, query, table

MIN_WORDS = 50
#: Words of the n-gram whose hash selects positions, and positions of which one is selected.
MINIMISER_WORDS, WINDOW = 8, 18
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _windows(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``size`` words inside a document: (document, first word, its retained suffix).

    The suffix is at the minimiser: the place with the smallest n-gram hash among the first
    ``WINDOW`` places of the run.  Equal runs have it at equal offsets, wherever they stand.
    """
    lengths = np.diff(chunk.offsets)
    some = np.flatnonzero(lengths >= size)
    n = lengths[some] - size + 1
    first = np.arange(int(n.sum())) + np.repeat(chunk.offsets[some] - (np.cumsum(n) - n), n)
    if not len(first):
        return first, first, first
    rank = mix(gram_hashes(chunk.words, MINIMISER_WORDS))
    best = np.lib.stride_tricks.sliding_window_view(rank, WINDOW).argmin(axis=1)
    return np.repeat(some, n), first, first + best[first]


def _summed(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in sorted order: first (smallest id and place), whether several ids have it, and each row's key number."""
    order = np.lexsort((places, ids, keys))
    k, i, p = keys[order], ids[order], places[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]  # neighbours in sorted order
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(k)) - 1
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    if not len(starts):
        return k, i, p, np.zeros(0, bool), number
    return k[starts], i[starts], p[starts], i[starts] != i[last], number


def _merge(numbers: list[int], _: list[int], parts: list) -> Iterator[tuple[int, bytes]]:
    """For each chunk and key: bit 0, several documents have it; bit 1, the first of all is this chunk's first."""
    keys, ids, places, several = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((places, ids, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(starts[1:], len(k)) - 1
    shared = (ids[order][starts] != ids[order][last]) | np.logical_or.reduceat(several[order].astype(bool), starts)
    lead = (ids[order] == ids[order][starts][group]) & (places[order] == places[order][starts][group])
    code = np.empty(len(k), np.uint8)
    code[order] = shared[group].astype(np.uint8) | (lead.astype(np.uint8) << 1)
    at = 0
    for number, p in zip(numbers, parts, strict=True):
        yield number, squeeze(code[at : at + len(p[0])])
        at += len(p[0])


def repeated_passages(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``size`` words that stand in several documents: doc_id, key, begin, end, kept.

    One row for each stretch of words [begin, end) of a document (``key``: hash of its text).
    Stretches with ``kept`` hold what occurs first in document order (doc_id, nulls last;
    then place); the others can be removed without losing any content.  A word belongs to a
    passage when one of the runs of ``size`` words around it also occurs in a document with another
    id.  Documents without such runs, empty and null texts give no row; words are compared with
    A-Z lower-cased.  Repeated rows of one doc_id are one document.

    1. Suffixes are retained at minimisers only, about one in nine places.  They are sorted by
       their first words, and neighbours are compared: a suffix no other document shares is dropped.
    2. Around each suffix left, the match is extended to the left and right: the runs that
       contain it are sorted and compared in the same way, which also finds the first.
    """
    chunks = chunk_documents(docs)
    right = size - WINDOW + 1
    n_suffixes, n_runs = fragments_for(chunks, 0.15), fragments_for(chunks, 0.5)

    def places(chunk: Chunk, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return (at - chunk.offsets[doc]).astype(np.uint32)

    def suffixes(chunk: Chunk) -> tuple:
        doc, first, anchor = _windows(chunk, size)
        at, back = np.unique(anchor, return_inverse=True)
        owner = np.searchsorted(chunk.offsets, at, side="right") - 1
        keys = mix(gram_hashes(chunk.words, right))[at] if len(at) else np.zeros(0, np.uint64)
        return doc, first, back, _summed(keys, chunk.ids[owner], places(chunk, at, owner))

    def runs(chunk: Chunk, extra: dict) -> tuple:
        doc, first, back, (*_, number) = suffixes(chunk)
        code = joined(extra["suffixes"], np.uint8)[0]
        live = (code[number[back]] & 1).astype(bool) if len(back) else np.zeros(0, bool)
        doc, first = doc[live], first[live]
        keys = mix(gram_hashes(chunk.words, size))[first] if len(first) else np.zeros(0, np.uint64)
        return doc, first, _summed(keys, chunk.ids[doc], places(chunk, first, doc))

    def ask_suffixes(chunk: Chunk, _: dict) -> Iterator[dict]:
        keys, ids, at, several, _n = suffixes(chunk)[3]
        yield from questions(chunk.number, keys, [ids, at, several.astype(np.uint8)], n_suffixes)

    def ask_runs(chunk: Chunk, extra: dict) -> Iterator[dict]:
        keys, ids, at, several, _n = runs(chunk, extra)[2]
        yield from questions(chunk.number, keys, [ids, at, several.astype(np.uint8)], n_runs)

    def spans(chunk: Chunk, extra: dict) -> Iterator[dict]:
        doc, first, (_, ids, at, _s, number) = runs(chunk, extra)
        code = joined(extra["runs"], np.uint8)[0]
        if not len(first):
            return
        mine = code[number]
        hit = (mine & 1).astype(bool)
        doc, first, number, mine = doc[hit], first[hit], number[hit], mine[hit]
        original = (mine & 2).astype(bool) & (chunk.ids[doc] == ids[number]) & (places(chunk, first, doc) == at[number])
        n = len(chunk.codes)

        def covered(starts: np.ndarray) -> np.ndarray:
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + size, -1)
            return np.cumsum(step[:-1]) > 0

        state = covered(first).astype(np.int8) + covered(first[~original])
        owner = chunk.doc_of()
        edge = np.ones(n, bool)
        edge[1:] = (state[1:] != state[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], n)
        some = state[begin] > 0
        begin, end = begin[some], end[some]
        who = owner[begin]
        base = chunk.offsets[who]
        yield {
            "doc_id": pa.array(chunk.ids[who], mask=chunk.ids[who] == NULL_ID), "key": pa.array(chunk.keys[who]),
            "begin": pa.array(begin - base), "end": pa.array(end - base), "kept": pa.array(state[begin] == 1),
        }

    found = answers(each_chunk(chunks, ask_suffixes, QUESTION), _merge)
    known = with_answers(chunks, found, "suffixes")
    first = answers(each_chunk(known, ask_runs, QUESTION), _merge)
    return each_chunk(with_answers(known, first, "runs"), spans, "doc_id long, key long, begin long, end long, kept boolean")


def remove_repeats(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """Documents without the passages that occur in an earlier document; n_chars follows the text.

    The words of a passage go with the white space behind them.  Documents without repeats
    stay as they are, and so do other columns, whatever their names; a document left without words goes.  Rows with a
    null doc_id count as one document, so what only they share stays.
    """
    found = repeated_passages(docs.select("doc_id", "text"), size).filter("not kept").distinct()
    own, key, spans_of = free_names(docs, "id", "key", "cuts")
    cuts = keep(found.groupBy(F.col("doc_id").alias(own), F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(spans_of)), "cuts")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(key))
    marked = docs.join(cuts, same, "left").drop(own, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(spans_of).to_pylist(), strict=True):
                starts = [m.start() for m in _WORD.finditer(text)]
                starts.append(len(text))
                out, at = [], 0
                for s in spans:
                    out.append(text[at : starts[s["begin"]]])
                    at = starts[s["end"]]
                texts.append("".join([*out, text[at:]]).rstrip(" \t\n\v\f\r"))
            columns = {c: b.column(c) for c in b.schema.names if c != spans_of} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = docs.select(*docs.columns).schema
    changed = marked.filter(F.col(spans_of).isNotNull()).mapInArrow(cut, schema).filter(F.length("text") > 0)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return marked.filter(F.col(spans_of).isNull()).drop(spans_of).unionByName(changed)


@query(
    "op9_sparse_suffix_repeats",
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), runs AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM words, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50
    ), shared AS (
        SELECT h, min(doc_id) AS d FROM runs GROUP BY h HAVING min(doc_id) <> max(doc_id)
    ), firsts AS (SELECT r.h, s.d, min(r.i) AS i FROM runs r JOIN shared s ON r.h = s.h AND r.doc_id = s.d GROUP BY r.h, s.d
    ), hits AS (
        SELECT r.doc_id, r.i, (r.doc_id = f.d AND r.i = f.i) AS original FROM runs r JOIN firsts f USING (h)
    ), cover AS (
        SELECT doc_id, i + k - 1 AS p, bool_and(original) AS kept FROM hits, unnest(range(0, 50)) t(k) GROUP BY doc_id, i + k - 1
    ), marked AS (
        SELECT *, p - row_number() OVER (PARTITION BY doc_id, kept ORDER BY p) AS island FROM cover
    )
    SELECT doc_id, min(p)::BIGINT AS begin_word, (max(p) + 1)::BIGINT AS end_word, kept FROM marked GROUP BY doc_id, kept, island
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"), "kept")
