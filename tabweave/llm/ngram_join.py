"""Jaccard join of word n-gram sets by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.chunks import BROADCAST_BYTES, QUESTION, Chunk, answers, chunk_documents, each_chunk, fragments_for, joined, questions, squeeze, with_answers
from tabweave.llm.common import free_names, gram_hashes, keep, mix, query, signed, table, trimmed
from tabweave.llm.graph import components
from tabweave.operators.joins import lookup

SHINGLE_WORDS = 5
#: Fragments of the global order whose overlaps are counted apart.
ORDER_FRAGMENTS = 8
#: Hash functions by which near copies find a common centre.
CENTRES = 4
#: Logarithm of the ratio between the ends of a band of set sizes.
BAND = 0.1


def shingle_sets(chunk: Chunk, k: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of the chunk's documents, by document and hash.

    A document with fewer than ``k`` words has its whole sequence as one shingle; without words it has none.
    """
    lengths = np.diff(chunk.offsets)
    pick = np.ones(len(lengths), bool) if which is None else which
    words = chunk.words
    grams = gram_hashes(words, k)
    long = np.flatnonzero(pick & (lengths >= k))
    starts, n = chunk.offsets[long], lengths[long] - k + 1
    at = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
    doc, h = np.repeat(long, n), grams[at]
    short = np.flatnonzero(pick & (lengths < k) & (lengths > 0))
    if len(short):
        whole = [gram_hashes(words[chunk.offsets[i] : chunk.offsets[i + 1]], int(lengths[i]))[0] ^ np.uint64(0xA5A5 + int(lengths[i])) for i in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(whole, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _level(df: np.ndarray) -> np.ndarray:
    """Document frequency on a rising scale that fits one byte: 0 for a single set, exact up to 8."""
    df = np.asarray(df, np.float64)
    return np.where(df <= 8, df - 1, np.minimum(255, 7 + np.floor(6 * np.log2(df / 8)))).astype(np.uint8)


def _sets(chunks: DataFrame, k: int) -> DataFrame:
    """(chunk, doc, doc_id, n, node): node is a hash of the whole set, equal sets are one node (null: no words)."""

    def fn(chunk: Chunk, _: dict) -> Iterator[dict]:
        doc, h = shingle_sets(chunk, k)
        n = np.bincount(doc, minlength=len(chunk.ids))
        node = np.zeros(len(chunk.ids), np.uint64)
        np.add.at(node, doc, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
        node = mix(node + n.astype(np.uint64))
        yield {
            "chunk": pa.array(np.full(len(n), chunk.number)), "doc": pa.array(np.arange(len(n), dtype=np.int32)),
            "doc_id": pa.array(chunk.ids, mask=chunk.ids == np.iinfo(np.int64).max), "n": pa.array(n), "node": pa.array(node.view(np.int64), mask=n == 0),
        }

    return keep(each_chunk(chunks, fn, "chunk long, doc int, doc_id long, n long, node long"), "sets")


def _frequencies(chunks: DataFrame, k: int) -> DataFrame:
    """Each chunk's answers: the level of the document frequency of each of its distinct shingles, over one document of each node."""

    def ask(chunk: Chunk, extra: dict) -> Iterator[dict]:
        which = np.zeros(len(chunk.ids), bool)
        which[extra["mine"] or []] = True
        keys, counts = np.unique(shingle_sets(chunk, k, which)[1], return_counts=True)
        yield from questions(chunk.number, keys, [counts.astype(np.uint32)], n)

    def count(numbers: list[int], _: list[int], parts: list) -> Iterator[tuple[int, bytes]]:
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        df = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys))
        levels, at = _level(df)[back], 0
        for number, p in zip(numbers, parts, strict=True):
            yield number, squeeze(levels[at : at + len(p[0])])
            at += len(p[0])

    n = fragments_for(chunks)
    return answers(each_chunk(chunks, ask, QUESTION), count)


def _candidates(chunks: DataFrame, k: int, percent: int) -> DataFrame:
    """Sets that can have a partner at all, one a node: node, n, order (shared shingles, rarest first), skipped, centre, m0, m1, ...

    ``order`` holds (level, hash) as one number that sorts by frequency; shingles that no other
    set has are only counted in ``skipped``.  A set needs ``percent`` of its shingles in its
    partner, so one with fewer shared shingles has none.
    """
    schema = "node long, n long, skipped long, centre double, shingles binary, " + ", ".join(f"m{i} long" for i in range(CENTRES))

    def fn(chunk: Chunk, extra: dict) -> Iterator[dict]:
        which = np.zeros(len(chunk.ids), bool)
        which[extra["mine"] or []] = True
        doc, h = shingle_sets(chunk, k, which)
        level = joined(extra["levels"], np.uint8)[0][np.searchsorted(np.unique(h), h)].astype(np.uint64)
        n, shared = np.bincount(doc, minlength=len(which)), np.bincount(doc, weights=level > 0, minlength=len(which))
        good = which & (n > 0) & (100 * shared >= percent * n)
        on = good[doc] & (level > 0)
        node = dict(zip(extra["mine"] or [], extra["nodes"] or [], strict=True))
        doc, h, level = doc[on], h[on], level[on]
        key = (level << np.uint64(55)) | (h >> np.uint64(9))
        order = np.lexsort((key, doc))
        doc, key, level = doc[order], key[order], level[order]
        ends = np.searchsorted(doc, np.arange(len(which) + 1))
        some = np.flatnonzero(good)
        if len(some):
            starts = ends[some]
            raw = key.view(np.int64)
            out = {
                "node": pa.array([node[i] for i in some.tolist()], pa.int64()), "n": pa.array(n[some]), "skipped": pa.array(n[some] - np.diff(ends)[some]),
                "centre": pa.array(np.add.reduceat(level.astype(np.float64), starts) / n[some]), "shingles": pa.array([raw[a:z].astype("<i8").tobytes() for a, z in zip(starts, ends[some + 1], strict=True)], pa.binary()),
            }
            for i in range(CENTRES):
                out[f"m{i}"] = signed(np.minimum.reduceat(mix((key << np.uint64(9)) ^ np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1)), starts))
            yield out

    return keep(each_chunk(chunks, fn, schema), "candidates")


def _segments(sets: DataFrame, n_fragments: int) -> DataFrame:
    """Vertical cut: (node, fragment, part) with each set's shingles that lie in one fragment of the global order.

    The pivots are quantiles of the order over all sets; they balance the fragments and nothing else.
    """

    def sample(batches):
        for b in batches:
            keys = [np.frombuffer(x, "<i8") for x in b.column("shingles").to_pylist()]
            values, counts = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]) >> 44, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["v", "c"])

    cells = sets.select("shingles").mapInArrow(sample, "v long, c long").groupBy("v").agg(F.sum("c").alias("c"))
    probs = [(i + 1) / n_fragments for i in range(n_fragments - 1)]
    # at most 2**19 cells reach the one buffer of the exact percentile
    found = [int(x) for x in cells.agg(F.percentile("v", probs, F.col("c"))).first()[0] or []]
    pivots = np.unique(np.array(found, np.int64)) << 44

    def cut(batches):
        for b in batches:
            node, frag, part = [], [], []
            for i, raw in zip(b.column("node").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                keys = np.frombuffer(raw, "<i8")
                ends = [0, *np.searchsorted(keys, pivots).tolist(), len(keys)]
                for f, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if z > a:
                        node.append(i)
                        frag.append(f)
                        part.append(keys[a:z].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.array(part, pa.binary())], names=["node", "fragment", "part"])

    return keep(sets.select("node", "shingles").mapInArrow(trimmed(cut), "node long, fragment int, part binary"), "segments")


def _linked(pairs: DataFrame, segments: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose Jaccard similarity is at least ``percent`` / 100.

    Overlaps are counted fragment by fragment and summed for each pair.
    """

    def overlap(batches):
        for b in batches:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            common = [len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int64())], names=["a", "b", "common"])

    left = pairs.join(segments.select(F.col("node").alias("a"), "fragment", F.col("part").alias("left")), "a")
    both = left.join(segments.select(F.col("node").alias("b"), "fragment", F.col("part").alias("right")), ["b", "fragment"])
    summed = both.select("a", "b", "left", "right").mapInArrow(trimmed(overlap), "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    sizes = sets.select("node", "n")
    sized = summed.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return sized.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def _cross_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components whose first common shingle leaves room for the overlap they need.

    Similar sets of sizes m <= n have ceil(percent (m + n) / (100 + percent)) shingles in common.  The first of them, by
    the global order, has as many in either set from itself on.  So an entry (shingle, set) bounds the sizes
    its set can meet there: the smaller set has the shingle in a short prefix, and the larger one is
    sent to the bands of the sizes in its reach.  Sets that only share something common, late in their
    order, never meet.  Pairs inside a component are known to be connected and never formed.
    """

    def prefixes(batches):
        for b in batches:
            n, skipped = b.column("n").to_numpy(), b.column("skipped").to_numpy()
            take = np.maximum(n - -(-percent * n // 100) + 1 - skipped, 0)
            raw = [np.frombuffer(x, "<i8")[:t] for x, t in zip(b.column("shingles").to_pylist(), take.tolist(), strict=True)]
            lengths = np.array([len(x) for x in raw], np.int64)
            own = np.repeat(np.arange(len(raw)), lengths)
            place = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + skipped[own]
            at, left = pa.array(own), n[own] - place
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(raw or [np.zeros(0, np.int64)])), b.column("node").take(at), b.column("n").take(at), b.column("component").take(at), pa.array(left)], names=["key", "node", "n", "component", "left"]
            )

    labelled = sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "n", "skipped", "shingles", "component")
    rows = keep(labelled.mapInArrow(trimmed(prefixes), "key long, node long, n long, component long, left long"), "prefixes")
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    rows = rows.join(several, "key")
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(BAND))
    low, high = F.ceil(F.col("n") * percent / F.lit(100)), F.least(F.col("n"), F.floor(F.col("left") * (100 + percent) / F.lit(percent)) - F.col("n"))
    probe = rows.withColumns({"low": low, "high": high}).filter("low <= high").select("*", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"))
    index = rows.filter(F.col("left") * (100 + percent) >= 2 * percent * F.col("n")).withColumn("band", band(F.col("n")))
    x, y = probe.alias("x"), index.alias("y")
    need = (F.col("x.n") + F.col("y.n")) * percent
    reach = (F.col("x.left") * (100 + percent) >= need) & (F.col("y.left") * (100 + percent) >= need) & (F.col("y.n") >= F.col("x.low"))
    once = F.struct("y.n", "y.node") < F.struct("x.n", "x.node")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & reach & once)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def jaccard_groups(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = 75) -> DataFrame:
    """Groups of documents whose ``k``-word shingle sets are linked by similarity: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links lead to.  One row a document (repeated rows too).  Null and blank texts have no shingles and stay alone; null ids are carried and never are
    a component's smallest unless all are null.  Other columns are ignored.

    1. Equal sets become one node.
    2. Chunks ask for the document frequency of their shingles; sets with too few shared ones are out.
    3. Of the sets that agree in a minimum hash, all are compared with the most central one.  This
       joins large groups of near copies by as many pairs as they have members.
    4. The other pairs, across components only, come from prefixes of the rarest-first
       order; their overlaps are counted by fragments of that order and summed.
    """
    chunks = chunk_documents(docs)
    rows = _sets(chunks, k)
    classes = keep(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("chunk", "doc")).alias("first")), "classes")
    mine = classes.groupBy(F.col("first.chunk").alias("_c")).agg(F.collect_list("first.doc").alias("mine"), F.collect_list("node").alias("nodes"))
    # two numbers a node: broadcast while that is small, else both sides are shuffled by chunk
    picked = chunks.join(F.broadcast(mine) if classes.count() * 16 <= BROADCAST_BYTES else mine, F.col("chunk") == F.col("_c"), "left").drop("_c")
    levels = _frequencies(picked, k)
    sets = _candidates(with_answers(picked, levels, "levels"), k, percent)
    segments = _segments(sets, ORDER_FRAGMENTS)
    stars = None
    for i in range(CENTRES):
        centres = sets.groupBy(f"m{i}").agg(F.max_by("node", F.struct("centre", "node")).alias("b"))
        one = sets.select(F.col("node").alias("a"), f"m{i}").join(centres, f"m{i}").filter("a <> b").select("a", "b")
        stars = one if stars is None else stars.unionByName(one)
    first = components(_linked(keep(stars.distinct(), "stars"), segments, sets, percent))
    pairs = keep(_cross_pairs(sets, first, percent), "pairs")
    more = _linked(pairs, segments, sets, percent)
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    least = final.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("found"))
    named = final.join(least, "component").select("node", "found")
    labels = keep(classes.join(named, "node", "left").select(F.col("node").alias("cls"), F.coalesce("found", "least").alias("label"), "copies"), "labels")
    out = lookup(rows, labels, {"cls": F.col("node")}, ["label"], weight="copies")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = 75) -> DataFrame:
    """Documents without those that have a smaller doc_id in their group; repeated rows of the smallest are kept once.

    Documents without words and documents with a null id are all kept; all columns, whatever their names, stay as they are.
    """
    groups = jaccard_groups(docs.select("doc_id", "text"), k, percent)
    (own,) = free_names(docs, "id")
    stay = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    rest = docs.filter(F.col("doc_id").isNull())
    kept = docs.filter(F.col("doc_id").isNotNull()).join(stay, F.col("doc_id") == F.col(own), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(rest)


@query(
    "op6_vertical_jaccard",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
    ), classes AS (
        SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, min(doc_id) AS rep, any_value(s) AS s, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
    ), grams AS (SELECT rep, n, unnest(s) AS g FROM classes
    ), links AS (
        SELECT a.rep AS x, b.rep AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
        GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
    ), label AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
    FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND c.c = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN label l ON l.rep = c.rep
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")
