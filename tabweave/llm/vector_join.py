"""Near duplicates among embeddings: subspace pigeonhole join of rotated vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import keep, query, table, trimmed
from tabweave.llm.graph import components
from tabweave.llm.vectors import matrix, sample_units, square_distances, unit_vectors

BLOCKS = 4
#: Rows of a strip and of one side of a task's tile, about.
STRIP_ROWS, TILE_ROWS = 2_048, 8_192
#: Dense balls are looked for among so many vectors at most; a ball needs so many of them.
SAMPLE, DENSE = 8_192, 4
#: Distances this close to a bound count as undecided.
SLACK = 1e-9


def dense_centres(points: np.ndarray, radius: float) -> np.ndarray:
    """Centres of balls of ``radius`` that hold at least ``DENSE`` rows of a bounded sample."""
    left, out = np.ones(len(points), bool), []
    for i in range(len(points)):
        if not left[i]:
            continue
        near = left & (((points - points[i]) ** 2).sum(axis=1) <= radius * radius)
        left &= ~near
        if near.sum() >= DENSE:
            out.append(points[i])
    return np.array(out).reshape(len(out), points.shape[1] if points.ndim == 2 else 0)


def rotation(units: DataFrame, dim: int, blocks: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Principal axes of all vectors, dealt to blocks of nearly equal energy: axes, columns of each block, their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            m = matrix(b.column("unit"), dim)
            total += m.T @ m
            n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "gram"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in group.column("gram").to_pylist())
        return pa.table({"n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "gram": pa.array([total.tobytes()], pa.binary())})

    parts = units.select("unit").mapInArrow(run, "n long, gram binary")
    some = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(32)).alias("g")).applyInArrow(add, "n long, gram binary").collect()
    gram = sum((np.frombuffer(r["gram"], "<f8").reshape(dim, dim) for r in some), np.zeros((dim, dim)))
    energy, axes = np.linalg.eigh(gram)
    order = np.argsort(-energy, kind="stable")
    blocks = min(blocks, dim)
    columns: list[list[int]] = [[] for _ in range(blocks)]
    load = np.zeros(blocks)
    room = -(-dim // blocks)
    for j in order.tolist():  # the next strongest axis goes to the weakest block that has room
        b = min((b for b in range(blocks) if len(columns[b]) < room), key=lambda b: (load[b], b))
        columns[b].append(j)
        load[b] += max(energy[j], 0)
    load = np.maximum(load, load.sum() * 1e-3) if load.sum() else np.ones(blocks)
    return axes, [np.array(c) for c in columns], load / load.sum()


def block_candidates(loose: DataFrame, dim: int, squared: float) -> DataFrame:
    """Pairs of rows (a < b) that are near in at least one block of axes.

    If two vectors are within the squared distance, one block holds at most its share of
    it.  Each block is joined on its own: rows are cut into strips along the block's
    first axis and also sent to the later strips that their budget reaches; full distances
    in the block are then taken tile by tile.
    """
    n = loose.count()
    axes, columns, shares = rotation(loose, dim, BLOCKS)
    budget = squared * shares * (1 + 1e-6) + 1e-9
    reach = np.sqrt(budget)
    names = ["block", "row", "lead", "part"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("unit"), dim)
            for k, c in enumerate(columns):
                y = m @ axes[:, c]
                raw, w = y.astype("<f8").tobytes(), 8 * len(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), b.column("row"), pa.array(y[:, 0]), pa.array([raw[i * w : (i + 1) * w] for i in range(len(y))], pa.binary())], names=names)

    rows = keep(loose.select("row", "unit").mapInArrow(trimmed(project), "block int, row long, lead double, part binary"), "blocks")
    strips = max(1, -(-n // STRIP_ROWS))
    probs = [(i + 1) / strips for i in range(strips - 1)]
    edges = [np.array([], float) for _ in columns]
    if probs:
        for r in rows.groupBy("block").agg(F.percentile_approx("lead", probs, 20 * strips).alias("e")).collect():
            edges[r["block"]] = np.unique(r["e"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, lead = b.column("block").to_numpy(), b.column("lead").to_numpy()
            home, last = np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64)
            for k, e in enumerate(edges):
                on = block == k
                home[on] = np.searchsorted(e, lead[on], side="right")
                last[on] = np.searchsorted(e, lead[on] + reach[k], side="right")
            count = last - home + 1
            at = np.repeat(np.arange(len(lead)), count)
            where = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + home[at]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("block").take(take), pa.array(where.astype(np.int32)), pa.array(where == home[at]), b.column("row").take(take), b.column("part").take(take)], names=["block", "strip", "home", "row", "part"])

    placed = keep(rows.mapInArrow(trimmed(strip), "block int, strip int, home boolean, row long, part binary"), "strips")
    sizes = placed.groupBy("block", "strip").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n"))
    plan = keep(sizes.select("block", "strip", F.expr(f"(h + {TILE_ROWS - 1}) div {TILE_ROWS}").alias("hs"), F.expr(f"(n + {TILE_ROWS - 1}) div {TILE_ROWS}").alias("ns")), "tiles")
    joined = placed.join(plan, ["block", "strip"])
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    owners = joined.filter("home").select("block", "strip", F.pmod(F.xxhash64("row"), "hs").alias("i"), spread("ns").alias("j"), F.lit(True).alias("owner"), "home", "row", "part")
    others = joined.filter("hs > 0").select("block", "strip", spread("hs").alias("i"), F.pmod(F.xxhash64("row"), "ns").alias("j"), F.lit(False).alias("owner"), "home", "row", "part")

    def tile(group: pa.Table) -> pa.Table:
        k = group.column("block")[0].as_py()
        owner = group.column("owner").to_numpy()
        row, home = group.column("row").to_numpy(), group.column("home").to_numpy()
        part = group.column("part").combine_chunks()
        left, right = np.flatnonzero(owner), np.flatnonzero(~owner)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            width = len(columns[k])
            x, y = matrix(part.take(pa.array(left)), width), matrix(part.take(pa.array(right)), width)
            # -|x - y|^2 / 2 as one product in single precision; the bound has room for its rounding
            fx, fy = ((m * m).sum(axis=1)[:, None] / -2 for m in (x, y))
            x = np.hstack([x, fx, np.ones_like(fx)]).astype(np.float32)
            y = np.hstack([y, np.ones_like(fy), fy]).astype(np.float32).T.copy()
            bound = np.float32(-budget[k] / 2 - 4e-6)
            for s in range(0, len(left), 1024):
                who, what = np.nonzero(x[s : s + 1024] @ y >= bound)
                p, q = left[s + who], right[what]
                once = (row[p] < row[q]) | (~home[q] & (row[p] != row[q]))
                a.append(np.minimum(row[p], row[q])[once])
                b.append(np.maximum(row[p], row[q])[once])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return owners.unionByName(others).groupBy("block", "strip", "i", "j").applyInArrow(tile, "a long, b long").distinct()


def _verified(pairs: DataFrame, units: DataFrame, dim: int, cosine: float, left: str = "a", right: str = "b") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dot = (matrix(b.column("x"), dim) * matrix(b.column("y"), dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(left), b.column(right)], names=[left, right]).filter(pa.array(dot >= cosine))

    with_x = pairs.join(units.select(F.col("row").alias(left), F.col("unit").alias("x")), left)
    both = with_x.join(units.select(F.col("row").alias(right), F.col("unit").alias("y")), right)
    return both.select(left, right, "x", "y").mapInArrow(run, f"{left} long, {right} long")


def linked_groups(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Links of each row of ``vectors`` (vec_id, embedding) with others: vec_id, n_links, component_id.

    Rows link when their cosine, in double precision, is at least ``cosine``.  One row for each input
    row; repeated rows link with each other.  Vectors that are null, zero, with null or
    non-finite components or of another dimension link with nothing and are their own component.

    A ball of half the link distance is a clique: dense balls, found on a sample, are counted as a
    whole, also against vectors that surely reach all or none of their members; only vectors
    between those bounds are compared with a ball's members one by one.  So a group that
    holds a third of all rows costs as many steps as it has rows.  All other vectors, and
    groups that the sample missed, go through the pigeonhole join of :func:`block_candidates`.
    """
    found, dim = unit_vectors(vectors)
    good = found.filter("unit is not null")
    squared = 2 - 2 * cosine
    link = math.sqrt(squared)
    centres = dense_centres(sample_units(found, dim, SAMPLE), link / 2 - SLACK)
    k = len(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("unit"), dim)
            ball, dist = np.full(len(m), -1, np.int32), np.zeros(len(m))
            for s in range(0, len(m), 2048) if k else ():
                d = square_distances(m[s : s + 2048], centres)
                at = d.argmin(axis=1)
                exact = np.sqrt(((m[s : s + 2048] - centres[at]) ** 2).sum(axis=1))
                inside = exact <= link / 2 - SLACK
                ball[s : s + 2048] = np.where(inside, at, -1)
                dist[s : s + 2048] = exact
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("unit"), pa.array(ball), pa.array(dist)], names=["row", "vec_id", "unit", "ball", "dist"])

    placed = keep(good.mapInArrow(place, "row long, vec_id long, unit binary, ball int, dist double"), "placed")
    # one row a ball: bounded by the sample
    stats = {r["ball"]: r for r in placed.filter("ball >= 0").groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.min("row").alias("head")).collect()}
    size = np.array([stats[i]["n"] if i in stats else 0 for i in range(k)], np.int64)
    radius = np.array([stats[i]["radius"] if i in stats else 0.0 for i in range(k)])
    head = np.array([stats[i]["head"] if i in stats else -1 for i in range(k)], np.int64)

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: links with whole balls; 1: a vector and a ball to compare; 2: an edge to a ball's first row; 3: vectors outside that reach all of a ball."""
        for b in batches:
            m, ball, row = matrix(b.column("unit"), dim), b.column("ball").to_numpy(), b.column("row").to_numpy()
            out: list[tuple] = []
            whole = np.zeros(len(m), np.int64)
            for s in range(0, len(m), 2048):
                d = np.sqrt(square_distances(m[s : s + 2048], centres))
                all_, none = d <= link - radius - 1e-6, (d > link + radius + 1e-6) | (size == 0)
                own = ball[s : s + 2048]
                inside = np.flatnonzero(own >= 0)
                all_[inside, own[inside]], none[inside, own[inside]] = True, False
                all_ &= size > 0
                whole[s : s + 2048] = (all_ * size).sum(axis=1) - (own >= 0)
                i, c = np.nonzero(all_)
                far = own[i] < 0
                out.append((np.full(int(far.sum()), 3), c[far], np.ones(int(far.sum()), np.int64)))
                out.append((np.full(len(i), 2), row[s + i], head[c]))
                i, c = np.nonzero(~all_ & ~none)
                out.append((np.full(len(i), 1), row[s + i], c))
            out.append((np.zeros(len(m), np.int64), row, whole))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(o[j]) for o in out]).astype(np.int64)) for j in range(3)], names=["kind", "x", "y"])

    nothing = found.select(F.lit(0).cast("bigint").alias("kind"), F.col("row").alias("x"), F.lit(0).cast("bigint").alias("y")).limit(0)
    relations = keep(placed.mapInArrow(relate, "kind long, x long, y long"), "relations") if k else nothing
    loose = placed.filter("ball < 0")
    pairs = keep(block_candidates(loose.select("row", "unit"), dim, squared), "candidates")
    links = keep(_verified(pairs, loose, dim, cosine), "links")
    counts = [links.select(F.explode(F.array("a", "b")).alias("row"), F.lit(1).cast("bigint").alias("n"))]
    edges = [links.select("a", "b")]
    if k:
        counts.append(relations.filter("kind = 0").select(F.col("x").alias("row"), F.col("y").alias("n")))
        edges.append(relations.filter("kind = 2").select(F.col("x").alias("a"), F.col("y").alias("b")))
        reach = relations.filter("kind = 3").groupBy(F.col("x").alias("ball")).agg(F.sum("y").alias("n"))
        members = placed.filter("ball >= 0").select(F.col("ball").cast("bigint").alias("ball"), F.col("row").alias("member"))
        counts.append(members.join(F.broadcast(reach), "ball").select(F.col("member").alias("row"), "n"))
        near = relations.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("ball"))
        compared = keep(_verified(near.join(members, "ball").select("a", F.col("member").alias("b")), placed, dim, cosine), "compared")
        counts.append(compared.select(F.col("a").alias("row"), F.lit(1).cast("bigint").alias("n")))
        outside = compared.join(loose.select(F.col("row").alias("a")), "a", "left_semi")
        counts.append(outside.select(F.col("b").alias("row"), F.lit(1).cast("bigint").alias("n")))
        edges.append(compared.select("a", "b"))
    total, joins = counts[0], edges[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    for e in edges[1:]:
        joins = joins.unionByName(e)
    group = components(joins)
    named = found.select("row", "vec_id").join(group, F.col("row") == F.col("node")).select("row", "component", "vec_id")
    least = keep(named.groupBy("component").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("rows")), "least")
    label = keep(named.join(least, "component").select(F.col("row").alias("_row"), "least"), "label")
    degree = total.groupBy("row").agg(F.sum("n").alias("n"))
    out = found.select("row", "vec_id").join(degree, "row", "left").join(label, F.col("row") == F.col("_row"), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))


@query(
    "op2_subspace_pigeonhole",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    ), good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
    ), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.9
    ), reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
    ), label AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x
    ), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
    SELECT m.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, m.vec_id = l.component_id AS kept
    FROM embeddings m JOIN label l ON l.x = m.vec_id LEFT JOIN degree d ON d.x = m.vec_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked_groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
