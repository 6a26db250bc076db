"""Sharding by a k-d tree over document metadata; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import keep, query, table, text_key
from tabweave.operators.joins import lookup
from tabweave.operators.ordering import row_index

#: Bins of one histogram pass.  A pass returns one row for each node and bin at most.
BINS = 1024
#: A cut may miss the wanted weight by this part of a leaf; finer cuts take another pass.
TOLERANCE = 1 / 512


@dataclass
class _Node:
    """A box of the tree; ``leaves`` says how many shards it will become."""

    leaves: int
    weight: float = 0.0
    column: str | None = None
    cut: float = 0.0
    tie_cut: float | None = None
    children: list[_Node] = field(default_factory=list)
    # search for the cut: rows with ``column`` equal to ``at`` (if set) and ``on`` in [lo, hi], ``below`` them lies this weight
    on: str = ""
    at: float | None = None
    lo: float = 0.0
    hi: float = 0.0
    below: float = 0.0


def _goes_left(node: _Node, tie: str) -> Column:
    less = F.col(node.column) < F.lit(node.cut)
    if node.tie_cut is None:
        return less
    return less | ((F.col(node.column) == F.lit(node.cut)) & (F.col(tie) < F.lit(node.tie_cut)))


def _place(node: _Node, tie: str, number: dict[int, int]) -> Column:
    if not node.children:
        return F.lit(number[id(node)])
    left, right = node.children
    return F.when(_goes_left(node, tie), _place(left, tie, number)).otherwise(_place(right, tie, number))


def _leaves(node: _Node) -> list[_Node]:
    return [node] if not node.children else [x for c in node.children for x in _leaves(c)]


def _choose(node: _Node, bins: list, wanted: float, tolerance: float, tie: str) -> bool:
    """Narrow the search to the bin that holds the wanted weight; True when the cut is settled."""
    bins.sort(key=lambda b: b["bin"])
    run = node.below
    for b in bins:
        if run + b["w"] >= wanted:
            break
        run += b["w"]
    after = run + b["w"]
    if b["w"] <= tolerance or (node.on == tie and b["lo"] == b["hi"]):
        # the edge of this bin that is nearer; a cut above it falls just over its largest value
        low = wanted - run <= after - wanted
        edge = b["lo"] if low else float(_next(b["hi"]))
        if node.on == tie:
            node.cut, node.tie_cut = node.at, edge
        else:
            node.cut, node.tie_cut = edge, None
        return True
    node.below = run
    if node.on != tie and b["lo"] == b["hi"]:  # one value: go on by the tie-breaker among its rows
        node.on, node.at, node.lo, node.hi = tie, b["lo"], 0.0, 1.0
    else:
        node.lo, node.hi = b["lo"], b["hi"]
    return False


def _next(x: float) -> float:
    import math

    return math.nextafter(x, math.inf)


def fit_kd_tree(items: DataFrame, dims: Sequence[str], weight: str, tie: str, n_leaves: int | None = None, target: float | None = None) -> _Node:
    """Split rows at weighted medians along the widest dimension until ``n_leaves`` boxes (or boxes of ``target``) remain.

    ``items`` is a written narrow table: doubles ``dims`` without nulls, ``weight`` and a
    double ``tie`` in [0, 1).  The extents of all boxes of a level come from one
    aggregation, and all their medians are searched together by histograms that narrow
    down on the wanted weight, so no row is sorted or shuffled and the driver sees at most
    ``BINS`` rows a box.  A box of k shards is cut at floor(k/2)/k of its weight, which is
    the median when k is even.  Rows equal in the dimension are cut by ``tie``; rows equal in both stay together.
    """
    whole = items.agg(F.sum(weight).alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    total = float(whole["w"] or 0)
    if n_leaves is None:
        n_leaves = max(1, -(-int(total) // max(1, int(target or total or 1))))
    root = _Node(n_leaves, total)
    extent = {d: (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0) for d in dims}
    tolerance = TOLERANCE * total / n_leaves
    while True:
        boxes = _leaves(root)
        number = {id(b): i for i, b in enumerate(boxes)}
        todo = [b for b in boxes if b.leaves > 1]
        if not todo:
            return root
        placed = items.withColumn("_box", _place(root, tie, number)).filter(F.col("_box").isin([number[id(b)] for b in todo]))
        stats = {r["_box"]: r for r in placed.groupBy("_box").agg(F.sum(weight).alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()}
        searching = []
        for b in todo:
            s = stats.get(number[id(b)])
            if s is None:  # an empty box: its shards stay empty
                b.column, b.cut = dims[0], 0.0
                continue
            b.weight = float(s["w"])
            b.column = max(dims, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / extent[d] if extent[d] else -1.0)
            b.on, b.at, b.below = b.column, None, 0.0
            b.lo, b.hi = s[f"lo_{b.column}"], s[f"hi_{b.column}"]
            if b.lo == b.hi:
                b.on, b.at, b.lo, b.hi = tie, b.lo, 0.0, 1.0
            searching.append(b)
        while searching:
            case = None
            for b in searching:
                v = F.col(b.on)
                here = (F.col("_box") == number[id(b)]) & (v >= F.lit(b.lo)) & (v <= F.lit(b.hi))
                if b.at is not None:
                    here = here & (F.col(b.column) == F.lit(b.at))
                scale = BINS / (b.hi - b.lo) if b.hi > b.lo else 0.0
                bin_ = F.struct(F.least(F.floor((v - F.lit(b.lo)) * F.lit(scale)), F.lit(BINS - 1)).alias("bin"), v.alias("v"))
                case = F.when(here, bin_) if case is None else case.when(here, bin_)
            found = (
                placed.withColumn("_at", case).filter(F.col("_at").isNotNull())
                .groupBy("_box", F.col("_at.bin").alias("bin"))
                .agg(F.sum(weight).alias("w"), F.min("_at.v").alias("lo"), F.max("_at.v").alias("hi")).collect()
            )
            by_box: dict[int, list] = {}
            for r in found:
                by_box.setdefault(r["_box"], []).append({"bin": r["bin"], "w": float(r["w"]), "lo": r["lo"], "hi": r["hi"]})
            searching = [b for b in searching if not _choose(b, by_box[number[id(b)]], b.weight * (b.leaves // 2) / b.leaves, tolerance, tie)]
        for b in todo:
            b.children = [_Node(b.leaves // 2), _Node(b.leaves - b.leaves // 2)]


def assign_shards(items: DataFrame, root: _Node, tie: str, name: str = "shard") -> DataFrame:
    """Add the number of each row's leaf; a projection, nothing is shuffled."""
    return items.withColumn(name, _place(root, tie, {id(b): i for i, b in enumerate(_leaves(root))}))


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Documents in k-d tree shards of nearly equal bytes: doc_id, size, text_crc32, shard, slot.

    Dimensions are source and language (places of their checksums), text length and
    doc_id; nulls lie at -1.  Size is the UTF-8 length (null text: 0) plus 8.  Equal texts
    share one place in the tree, that of their smallest doc_id, so they stay in one
    shard, unless they weigh over a quarter of a shard; such groups are cut like other rows, so
    that one hot text can't outgrow a shard.  Repeated rows stay together; empty tables give no
    rows; further columns are ignored.
    """
    raw = F.col("text").cast("binary")
    place = F.struct(
        F.coalesce(F.crc32(F.col("source").cast("binary")).cast("double"), F.lit(-1.0)).alias("d_source"),
        F.coalesce(F.crc32(F.col("lang").cast("binary")).cast("double"), F.lit(-1.0)).alias("d_lang"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).cast("double").alias("d_length"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("d_id"),
    )
    dims = ["d_source", "d_lang", "d_length", "d_id"]
    rows = keep(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
            F.crc32(raw).alias("text_crc32"), text_key().alias("key"), place.alias("own"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaf = total / n_shards if n_shards else (target_bytes or total or 1)
    groups = keep(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min(F.struct("doc_id", "own")).alias("first"))
        .filter((F.col("n") > 1) & (F.col("bytes") <= F.lit(leaf / 4)))
        .select("key", "n", F.col("first.own").alias("shared")),
        "shard-groups",
    )
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    joined = lookup(rows, groups, {"key": F.col("key")}, ["shared"], weight="n")
    items = keep(
        joined.select(
            "doc_id", "size", "text_crc32",
            F.when(F.col("shared").isNotNull(), unit("key")).otherwise(unit("key", "doc_id")).alias("tie"),
            *[F.coalesce(F.col(f"shared.{d}"), F.col(f"own.{d}")).alias(d) for d in dims],
        ),
        "shard-items",
    )
    root = fit_kd_tree(items, dims, "size", "tie", n_shards, target_bytes)
    placed = assign_shards(items, root, "tie").select("doc_id", "size", "text_crc32", "shard")
    return row_index(placed, ["doc_id", "text_crc32"], ["shard"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


@query("op1_kd_tree_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), n_shards=24)
    return out.select(
        "doc_id", F.col("size").cast("bigint").alias("size"), F.col("text_crc32").cast("bigint").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
