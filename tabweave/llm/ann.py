"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.common import keep, query, table
from tabweave.llm.vectors import matrix, means, nearest, sample_units, square_distances, unit_vectors

#: Vectors of a list, about; and lists at most, which bounds the centroids that every task holds.
LIST_ROWS, MAX_LISTS = 512, 16_384
#: Centroids are fitted on so many vectors at most; every vector is indexed.
SAMPLE = 32_768
#: A vector goes into all lists whose centroid is at most this much farther than its nearest, ``COPIES`` at most.
BOUNDARY, COPIES = 1.08, 4
#: A query searches the lists whose centroid is at most this much farther than its nearest, and so many lists at least.
PROBE_RATIO, LEAST_LISTS = 1.12, 4
#: Links of a centroid in the graph, and rows of one side of a task's block.
LINKS, BLOCK_ROWS = 24, 2_048


def centroid_graph(centres: np.ndarray, links: int = LINKS) -> list[np.ndarray]:
    """Near neighbours of each centroid, in both directions, with one path through all so that none is cut off."""
    n = len(centres)
    out: list[set[int]] = [set() for _ in range(n)]
    for a in range(0, n, 1024):
        d = square_distances(centres[a : a + 1024], centres)
        for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, 1 : links + 1].tolist(), start=a):
            for j in row:
                out[i].add(j)
                out[j].add(i)
    for i in range(n - 1):
        out[i].add(i + 1)
        out[i + 1].add(i)
    return [np.array(sorted(x), np.int64) for x in out]


def search_graph(q: np.ndarray, centres: np.ndarray, graph: list[np.ndarray], ratio: float, entry: int = 0, floor: float = 0.0) -> np.ndarray:
    """Centroids within ``ratio`` of the nearest distance (or of ``floor``, if larger): best-first walk that ends when the front is beyond the bound."""
    seen = np.zeros(len(centres), bool)
    seen[entry] = True
    d0 = float(np.linalg.norm(q - centres[entry]))
    front, best, found = [(d0, entry)], d0, {entry: d0}
    late = 0
    while front:
        d, i = heapq.heappop(front)
        if d > max(best, floor) * ratio:
            late += 1
            if late > LINKS:  # a few steps beyond the bound, to get out of a pocket
                break
        new = graph[i][~seen[graph[i]]]
        if not len(new):
            continue
        seen[new] = True
        dist = np.sqrt(((centres[new] - q) ** 2).sum(axis=1))
        for j, dj in zip(new.tolist(), dist.tolist(), strict=True):
            found[j] = dj
            heapq.heappush(front, (dj, j))
        best = min(best, float(dist.min()))
    return np.array(sorted(j for j, d in found.items() if d <= max(best, floor) * ratio), np.int64)


def enough_lists(q: np.ndarray, hits: np.ndarray, centres: np.ndarray, own: np.ndarray, need: int) -> np.ndarray:
    """``hits`` and the next nearest lists until ``need`` vectors have their nearest centroid in them and there are a few lists; all lists at last."""
    if len(hits) >= min(LEAST_LISTS, len(centres)) and own[hits].sum() >= need:
        return hits
    order = np.argsort(square_distances(q[None, :], centres)[0], kind="stable")
    enough = int(np.searchsorted(np.cumsum(own[order]), need)) + 1
    return np.union1d(hits, order[: max(enough, LEAST_LISTS)])


def balanced(points: np.ndarray, centres: np.ndarray, turns: int = 6) -> np.ndarray:
    """Centres whose shares of the sample are between a quarter and twice the mean share, where the points allow it.

    Small clusters, above all single points, are given up to their neighbours; large ones are split. Copies of one point stay together.
    """
    target = len(points) / len(centres)
    for _ in range(turns):
        best = nearest(points, centres)[0]
        n = np.bincount(best, minlength=len(centres))
        stay = n >= max(2.0, target / 4)
        stay[n.argmax()] = True
        new = []
        for j in np.flatnonzero(stay):
            mine = points[best == j] if n[j] > 2 * target else points[:0]
            new.append(means(mine, round(n[j] / target)) if len(mine) and np.ptp(mine, axis=0).max() > 1e-9 else centres[j : j + 1])
        new = np.concatenate(new)[:MAX_LISTS]
        if len(new) == len(centres) and (new == centres).all():
            break
        centres = new
    n = np.bincount(nearest(points, centres)[0], minlength=len(centres))
    return centres[(n >= min(2, n.max()))]


def build_lists(units: DataFrame, dim: int, list_rows: int = LIST_ROWS, sample: int = SAMPLE) -> tuple[np.ndarray, float, DataFrame]:
    """Centroids, the usual distance to the nearest, and postings (list, first, row, vec_id, unit): every vector first in the list of its nearest centroid, boundary vectors in several."""
    n = units.filter("unit is not null").count()
    k = max(1, min(MAX_LISTS, -(-n // list_rows)))
    points = sample_units(units, dim, sample)
    centres = balanced(points, means(points, min(k, len(points)))) if len(points) else np.zeros((1, dim))
    # a vector at a centroid has distance 0, of which a ratio is nothing: ratios are taken of this at least
    floor = float(np.sqrt(np.median(nearest(points, centres)[1]))) if len(points) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("unit"), dim)
            for a in range(0, len(m), BLOCK_ROWS):
                d = np.sqrt(square_distances(m[a : a + BLOCK_ROWS], centres))
                near = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
                dist = np.take_along_axis(d, near, axis=1)
                row, spot = np.nonzero((dist <= np.maximum(dist[:, :1], floor) * BOUNDARY))
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, spot].astype(np.int32)), pa.array(spot == 0), b.column("row").take(at), b.column("vec_id").take(at), b.column("unit").take(at)], names=["list", "first", "row", "vec_id", "unit"])

    lists = units.filter("unit is not null").mapInArrow(run, "list int, first boolean, row long, vec_id long, unit binary")
    return centres, floor, keep(lists, "lists")


def search(units: DataFrame, dim: int, wanted: Column, k: int = 5, ratio: float = PROBE_RATIO, list_rows: int = LIST_ROWS) -> DataFrame:
    """The ``k`` nearest vectors by cosine found for the rows of ``units`` where ``wanted`` holds: query_id, rank, vec_id, score.

    Lists and probes are dealt to blocks of bounded size, so a list that holds a third of all rows, or that a third of all
    queries probe, is spread over many tasks; each block returns ``k`` rows a query.  A query goes on to the next nearest lists
    until they hold ``k`` other vectors, so it gets ``k`` rows whenever there are as many.
    """
    centres, floor, lists = build_lists(units, dim, list_rows)
    own = np.zeros(len(centres), np.int64)
    for r in lists.filter("first").groupBy("list").count().collect():  # one number a list
        own[r["list"]] = r["count"]
    graph = centroid_graph(centres)
    entry = int(nearest(centres.mean(axis=0)[None, :], centres)[0][0])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [enough_lists(q, search_graph(q, centres, graph, ratio, entry, floor), centres, own, k + 1) for q in matrix(b.column("unit"), dim)]
            at = pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits]))
            found = np.concatenate(hits).astype(np.int32) if hits else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found), b.column("row").take(at), b.column("vec_id").take(at), b.column("unit").take(at)], names=["list", "row", "vec_id", "unit"])

    probes = keep(units.filter(F.col("unit").isNotNull() & wanted).mapInArrow(probe, "list int, row long, vec_id long, unit binary"), "probes")
    # one number a list: how many blocks its vectors and its queries need
    sizes = lists.groupBy("list").count().withColumn("parts", F.expr(f"(count + {BLOCK_ROWS - 1}) div {BLOCK_ROWS}")).select("list", "parts")
    asked = probes.groupBy("list").count().withColumn("asks", F.expr(f"(count + {BLOCK_ROWS - 1}) div {BLOCK_ROWS}")).select("list", "asks")
    plan = F.broadcast(keep(sizes.join(asked, "list"), "plan"))  # MAX_LISTS rows at most

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("row"), F.col(own)).alias(f"{own}_at")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_at")
        return df.join(plan, "list").select("list", "row", "vec_id", "unit", mine, every).select("list", "parts_at", "asks_at", F.lit(side).alias("side"), "row", "vec_id", "unit")

    both = dealt(lists, "parts", "asks", 0).unionByName(dealt(probes, "asks", "parts", 1))

    def block(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        rows, ids = group.column("row").to_numpy(), group.column("vec_id").to_pylist()
        units_ = group.column("unit")
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        out: list[tuple] = []
        if len(left) and len(right):
            x = matrix(units_.take(pa.array(left)), dim)
            y = matrix(units_.take(pa.array(right)), dim)
            scores = x @ y.T
            scores[rows[left][:, None] == rows[right][None, :]] = -np.inf
            few = min(k, len(right))
            bar = np.partition(scores, len(right) - few, axis=1)[:, len(right) - few]
            who, what = np.nonzero(scores >= bar[:, None] - 1e-12)
            exact = (x[who] * y[what]).sum(axis=1)
            fine = scores[who, what] > -np.inf
            out = [(int(rows[left[i]]), ids[left[i]], int(rows[right[j]]), ids[right[j]], float(s)) for i, j, s in zip(who[fine], what[fine], exact[fine], strict=True)]
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    found = both.groupBy("list", "parts_at", "asks_at").applyInArrow(block, "query_row long, query_id long, row long, vec_id long, score double")
    once = found.groupBy("query_row", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_vectors(vectors: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """Nearest rows of ``vectors`` (vec_id, embedding) for the rows where ``wanted`` (on vec_id) holds.

    Vectors that are null, zero, with null or non-finite components or of another dimension take no part.  Ties go to the smaller
    vec_id.  A row is never its own neighbour; repeated rows are each other's.
    """
    units, dim = unit_vectors(vectors)
    return search(units, dim, wanted, k)


@query("op4_posting_lists")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)
