"""Rank and probability blending of prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.rowwise import expit, logit
from tabweave.operators.joins import lookup, lookup_many, sizes_by
from tabweave.operators.metrics import auc, ranks_long
from tabweave.operators.ordering import cumulate, melt
from tabweave.session import materialize

#: Bins of the first pass of a weight search, parts that an open bin is split into (powers of two), and passes after the first.
FIRST_BINS, SPLIT, DEPTH = 4_096, 64, 4
#: Cells that one pass may count.
CELLS = 4_000_000


def rank_columns(df: DataFrame, cols: Sequence[str], prefix: str = "r_", pct: bool = False, key: str = "id") -> DataFrame:
    """Add the average-tie rank of each column over all rows (``pct``: divided by the non-NULL count)."""
    table = ranks_long(melt(df, cols), "value", ["feature"])
    rank = F.col("avg_rank") / F.col("n") if pct else F.col("avg_rank")
    cells = {c: {"value": F.col(c).cast("double")} for c in cols}
    ranked = table.select("feature", "value", "cnt", rank.alias("rank"))
    return lookup_many(df, ranked, cells, {c: {"rank": f"{prefix}{c}"} for c in cols}, "cnt", sizes_by(table), key)


def rank_average(df: DataFrame, cols: Sequence[str], name: str = "score") -> DataFrame:
    """Mean of the columns' ranks divided by the row count."""
    ranked = rank_columns(df, cols, "_r_", pct=True)
    mean = reduce(lambda a, b: a + b, [F.col(f"_r_{c}") for c in cols]) / len(cols)
    return ranked.withColumn(name, mean).drop(*[f"_r_{c}" for c in cols])


def rank_average_long(pred: DataFrame, key: str = "id", member: str = "member", score: str = "score") -> DataFrame:
    """Rank average of a long prediction table: (key, score)."""
    table = ranks_long(pred.select(member, score), score, [member]).withColumnRenamed(score, "_s").withColumnRenamed(member, "_m")
    ranked = lookup(pred.select(key, member, score), table, {"_m": F.col(member), "_s": F.col(score)}, ["avg_rank", "n"], weight="cnt")
    return ranked.groupBy(key).agg(F.avg(F.col("avg_rank") / F.col("n")).alias(score))


def two_way(a: str | Column, b: str | Column, w: Column | float) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    w = w if isinstance(w, Column) else F.lit(float(w))
    return w * a + (1 - w) * b


def over_max(df: DataFrame, score: str) -> DataFrame:
    """Score divided by its global maximum (an uncorrelated scalar subquery)."""
    return df.withColumn(score, F.col(score) / df.agg(F.max(score)).scalar())


def apply_weight(df: DataFrame, a: str, b: str, w: float, name: str = "score") -> DataFrame:
    """w rank(a) + (1-w) rank(b), divided by its maximum."""
    ranked = materialize(rank_columns(df, [a, b], "_r_"), "blend")
    blended = ranked.withColumn(name, two_way("_r_" + a, "_r_" + b, w)).drop("_r_" + a, "_r_" + b)
    return over_max(blended, name)


def fixed_blend(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    return df.withColumn(name, reduce(lambda x, y: x + y, [F.lit(float(w)) * F.col(c) for c, w in weights.items()]))


def logit_average(cols: Sequence[str]) -> Column:
    return expit(reduce(lambda a, b: a + b, [logit(c) for c in cols]) / len(cols))


def auc_per_weight(df: DataFrame, a: str, b: str, label: str, weights: Sequence[float]) -> DataFrame:
    """Exact AUC of the two-way blend for every weight: (w, n_pos, n_neg, auc), in one job."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w")
    return auc(df.select(label, a, b, grid).select(label, "w", two_way(a, b, F.col("w")).alias("_s")), "_s", label, ["w"])


@dataclass
class _Bounds:
    """What is known of a weight: twice its ordered pairs so far, twice those still open, the bins they are in, and how fine these are."""

    sure: int = 0
    open: int = 0
    bins: int = 0
    depth: int = -1

    @property
    def most(self) -> int:
        return self.sure + self.open


def _weighted(df: DataFrame, a: str, b: str, label: str, weights: Sequence[float], scale: Column) -> DataFrame:
    """(w, share, pos, neg) for every row and weight; share is the blended score on the scale of 1, and never leaves the task."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w")
    y = F.col(label).cast("bigint")
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"), y.alias("pos"), (1 - y).alias("neg"), grid)
    return rows.select("w", (two_way("_a", "_b", F.col("w")) / scale).alias("share"), "pos", "neg")


def _refined(rows: DataFrame, depth: int, open_bins: DataFrame | None) -> DataFrame:
    """Written cells of bins of the next depth inside the open bins: w, bin, pos, neg, whether the cell is open, pairs.

    Multiplying by powers of two is exact, so a fine bin lies in one coarse bin.  A cell is closed if it
    holds one class, or one score only (its pairs are ties).  Only counts are shuffled.
    """
    fine = rows.withColumn("bin", F.floor(F.col("share") * float(FIRST_BINS * SPLIT**depth)).cast("bigint"))
    parent = F.floor(F.col("bin") / SPLIT).cast("bigint") if depth else F.lit(0).cast("bigint")
    fine = fine.withColumn("parent", parent)
    if open_bins is not None:
        fine = fine.join(F.broadcast(open_bins.select(F.col("w").alias("_w"), F.col("bin").alias("_p"))), (F.col("w") == F.col("_w")) & (F.col("parent") == F.col("_p")), "left_semi")
    cells = fine.groupBy("w", "parent", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("share").alias("low"), F.max("share").alias("high"))
    before = Window.partitionBy("w", "parent").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # FIRST_BINS or SPLIT rows
    wide = "decimal(38,0)"
    times = lambda x, y: (x.cast("decimal(18,0)") * y.cast("decimal(19,0)")).cast(wide)
    mixed = (F.col("pos") > 0) & (F.col("neg") > 0)
    tied = mixed & (F.col("low") == F.col("high"))
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    sure = times(F.col("pos"), below * 2) + F.when(tied, times(F.col("pos"), F.col("neg"))).otherwise(F.lit(0).cast(wide))
    is_open = mixed & ~tied
    return materialize(
        cells.select("w", "bin", "pos", "neg", sure.cast(wide).alias("sure"), is_open.alias("is_open"), F.when(is_open, times(F.col("pos"), F.col("neg") * 2)).otherwise(F.lit(0).cast(wide)).alias("open")),
        "cells",
    )


def _ordered_pairs(rows: DataFrame, weights: Sequence[float]) -> dict[float, int]:
    """Twice the ordered pairs of each weight, by ordering every row for it."""
    cum = cumulate(rows.filter(F.col("w").isin(list(weights))), "share", ["w"], {"pos": F.col("pos"), "neg": F.col("neg")})
    twice = F.col("pos").cast("decimal(18,0)") * (F.col("neg_before") * 2 + F.col("neg")).cast("decimal(19,0)")
    return {r["w"]: int(r["u"]) for r in cum.groupBy("w").agg(F.sum(twice.cast("decimal(38,0)")).alias("u")).collect()}


def best_weight(df: DataFrame, a: str, b: str, label: str, weights: Sequence[float], scale: Column) -> tuple[float, float | None]:
    """Best weight and its exact AUC, by branch and bound; the smallest weight wins ties.

    Scores fall into equal-width bins.  Pairs of different bins are ordered for certain; those inside a bin
    count for nothing in a weight's lower and in full in its upper bound.  Weights whose upper bound is under
    the best lower bound go, and only bins of the remaining weights that still hold undecided pairs are split, the most
    promising weights first and so many at a time that ``CELLS`` cells suffice.  The shuffles carry counts of
    cells, so a flat maximum, or equal members, costs no shuffle of rows x weights.  Only a weight
    that has more open bins than a pass may split, or is still open after ``DEPTH`` passes, has its rows ordered, one weight at a time.
    """
    base = df.filter(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    n_pos, n = base.agg(F.sum(F.col(label).cast("bigint")), F.count(F.lit(1))).first()
    if not n or not n_pos or n_pos == n:
        return min(weights), None
    known = {float(w): _Bounds(0, 2 * n_pos * (n - n_pos), FIRST_BINS // SPLIT) for w in weights}
    cells: dict[float, DataFrame] = {}
    while True:
        best = max(x.sure for x in known.values())
        alive = sorted((w for w, x in known.items() if x.open and x.most >= best), key=lambda w: (-known[w].most, w))
        if not alive:
            break
        first, batch, room = alive[0], [], CELLS
        depth = known[first].depth + 1
        for w in alive:
            room -= known[w].bins * SPLIT
            if known[w].depth + 1 == depth and cells.get(w) is cells.get(first) and (room >= 0 or not batch):
                batch.append(w)
        if depth > DEPTH or known[first].bins * SPLIT > CELLS:
            for w, pairs in _ordered_pairs(_weighted(base, a, b, label, [first], scale), [first]).items():
                known[w] = _Bounds(pairs, 0, 0, depth)
            continue
        above = cells.get(first)
        table = _refined(_weighted(base, a, b, label, batch, scale), depth, None if above is None else above.filter(F.col("is_open") & F.col("w").isin(batch)))
        found = table.groupBy("w").agg(F.sum("sure").alias("sure"), F.sum("open").alias("open"), F.count_if("is_open").alias("bins"))
        for r in found.collect():  # one row a weight
            known[r["w"]] = _Bounds(int(r["sure"]) + known[r["w"]].sure, int(r["open"]), r["bins"], depth)
            cells[r["w"]] = table
    pairs = max(x.sure for x in known.values())
    w = min(w for w, x in known.items() if x.sure == pairs and not x.open)
    return w, pairs / (2.0 * float(n_pos) * float(n - n_pos))


def coarse_grid(step: float = 0.01) -> list[float]:
    return [i * step for i in range(int(round(1 / step)) + 1)]


def fine_grid(centre: float, radius: float = 0.02, step: float = 0.002) -> list[float]:
    low, high = max(0.0, centre - radius), min(1.0, centre + radius)
    out, i = [], 0
    while low + i * step < high + 1e-9:
        out.append(low + i * step)
        i += 1
    return out


def search_blend_weight(df: DataFrame, a: str, b: str, label: str) -> tuple[float, float]:
    """Coarse then fine search of the rank-blend weight with the highest AUC.

    A fine weight only replaces the coarse one when its AUC is strictly higher.
    """
    ranked = materialize(
        rank_columns(df.select(label, a, b), [a, b], "_r_").select(label, F.col("_r_" + a).alias("ra"), F.col("_r_" + b).alias("rb")),
        "search",
    )
    n = F.lit(float(ranked.count()))
    w1, auc1 = best_weight(ranked, "ra", "rb", label, coarse_grid(), n)
    w2, auc2 = best_weight(ranked, "ra", "rb", label, fine_grid(w1), n)
    return (w2, auc2) if auc2 > auc1 else (w1, auc1)
