"""Distributed order statistics.

Ranks, empirical CDFs, exact quantiles and ROC-AUC all need running totals in value
order.  A window without partition keys would pull the table into one task, so:

1. rows are pre-aggregated to one row per (group, value) with map-side combine, which
   also takes the weight out of hot values;
2. the distinct values are range-partitioned, and the partition number is stored as
   a bucket column in a written table (buckets are balanced by Spark's own sampling);
3. totals per bucket give each bucket's starting offset (one row per bucket);
4. a window inside each bucket adds the local running total to the offset.

No step puts a whole group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.session import materialize

_BUCKET = "_bucket"


def _running_totals(bucketed: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` for each column of ``sums`` to a bucketed table."""
    keys = [*by, _BUCKET]
    per_bucket = bucketed.groupBy(*keys).agg(*[F.sum(s).alias(f"_{s}_in") for s in sums])
    # One row per bucket (and group) from here: bounded by the number of range partitions.
    ahead = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_{s}_in").over(ahead), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(f"_{s}_in").over(whole).alias(f"{s}_total") for s in sums],
    )
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = bucketed.select(
        "*", *[F.coalesce(F.sum(s).over(local), F.lit(0)).alias(f"_{s}_local") for s in sums]
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return inside.join(offsets, match, "inner").select(
        *[c for c in bucketed.columns if c != _BUCKET],
        *[(F.col(f"_{s}_offset") + F.col(f"_{s}_local")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def _bucketed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, *order]])
    return materialize(ranged.withColumn(_BUCKET, F.spark_partition_id()), "ordered")


def cumulate(df: DataFrame, value: str, by: Sequence[str] = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (by, value): each sum, its running total before the value, and its group total.

    Also carries ``idx_before`` / ``idx_total``, the number of smaller / all distinct
    values.  NULL and NaN values are left out.
    """
    sums = {"cnt": F.lit(1)} if sums is None else sums
    known = df.filter(F.col(value).isNotNull())
    if dict(df.dtypes)[value] in ("double", "float"):
        known = known.filter(~F.isnan(value))
    distinct = (
        known.groupBy(*by, value)
        .agg(*[F.sum(c).cast("bigint").alias(n) for n, c in sums.items()])
        .withColumn("idx", F.lit(1).cast("bigint"))
    )
    return _running_totals(_bucketed(distinct, by, [value]), by, [value], [*sums, "idx"])


def row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """0-based position of each row in a total order (``order`` must be unique in a group)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = _running_totals(_bucketed(one, by, order), by, order, ["_one"])
    return out.withColumnRenamed("_one_before", name).drop("_one", "_one_total")


def average_rank(cnt: str = "cnt") -> Column:
    """Average-tie rank (1-based) of a row of :func:`cumulate`."""
    return F.col(f"{cnt}_before") + (F.col(cnt) + 1) / 2


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), feature: str = "feature", value: str = "value") -> DataFrame:
    """Long form of numeric columns: one row per (row, column); a scan-side expand, no shuffle."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), feature, value
    )


def _picked_quantiles(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles out of running counts: (keys.., prob, value).

    ``counts`` has value, cnt, cnt_before and cnt_total; the two order statistics of each
    probability are the rows whose count interval holds their positions.
    """
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    first, last = F.col("cnt_before"), F.col("cnt_before") + F.col("cnt") - 1
    spot = lambda p: (F.col("cnt_total") - 1) * p
    inside = lambda k: (k >= first) & (k <= last)
    hits = F.filter(wanted, lambda p: inside(F.floor(spot(p))) | inside(F.ceil(spot(p))))
    picked = counts.select(*keys, "value", "cnt_before", "cnt", "cnt_total", F.explode(hits).alias("prob"))
    h = spot(F.col("prob"))
    ends = picked.groupBy(*keys, "prob").agg(
        F.max(F.when(inside(F.floor(h)), F.col("value"))).alias("_lo"),
        F.max(F.when(inside(F.ceil(h)), F.col("value"))).alias("_hi"),
        F.max(h - F.floor(h)).alias("_w"),
    )
    return ends.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("value"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles: (by.., feature, prob, value).

    The built-in exact percentile would hold every distinct value in a single buffer.
    """
    return long_quantiles(melt(df, cols, [*by]), [*by, "feature"], probs)


def long_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of the ``value`` column of a long table per key: (keys.., prob, value)."""
    return _picked_quantiles(cumulate(long, "value", keys), keys, probs)


def class_quantiles(df: DataFrame, cols: Sequence[str], label: str, probs: Sequence[float]) -> dict[tuple[str, str], dict[float, float]]:
    """Quantiles over all rows and within each class from one ordering of the values.

    Returns ``{(which, column): {prob: value}}`` with ``which`` in all, y0, y1; the collect
    is bounded by columns x probabilities.
    """
    y = F.col(label).cast("int")
    cum = cumulate(melt(df, cols, [label]), "value", ["feature"], {"all": F.lit(1), "y0": 1 - y, "y1": y})
    each = F.array(
        *[
            F.struct(F.lit(w).alias("which"), F.col(w).alias("cnt"), F.col(f"{w}_before").alias("cnt_before"), F.col(f"{w}_total").alias("cnt_total"))
            for w in ("all", "y0", "y1")
        ]
    )
    counts = cum.select("feature", "value", F.inline(each)).filter(F.col("cnt") > 0)
    out: dict[tuple[str, str], dict[float, float]] = {}
    for r in _picked_quantiles(counts, ["which", "feature"], probs).collect():
        out.setdefault((r["which"], r["feature"]), {})[r["prob"]] = r["value"]
    return out


def fit_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> dict:
    """Quantiles as driver values: ``{(*by, feature): [value per prob]}``.

    The collect is bounded by groups x columns x probabilities, never by rows.
    """
    out: dict = {}
    for r in quantiles(df, cols, probs, by).collect():
        out.setdefault(tuple(r[k] for k in [*by, "feature"]), {})[r["prob"]] = r["value"]
    return {k: [v[float(p)] for p in probs] for k, v in out.items()}


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return {k[0]: v[0] for k, v in fit_quantiles(df, cols, [0.5]).items()}


def fit_bin_edges(df: DataFrame, cols: Sequence[str], n_bins: int, unique: bool = True) -> dict[str, list[float]]:
    """Inner edges of ``n_bins`` quantile bins per column (the outer edges are unbounded)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    fitted = fit_quantiles(df, cols, probs)
    return {c: inner_edges(fitted.get((c,), []), unique) for c in cols}


def inner_edges(edges: Sequence[float], unique: bool = True) -> list[float]:
    """Edges without the two outer ones, repeated edges merged when ``unique``."""
    return (sorted(set(edges)) if unique else list(edges))[1:-1]
