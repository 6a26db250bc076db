"""Column profiles and drift measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.rowwise import bin_index, complete_case
from tabweave.operators.ordering import fit_bin_edges, long_quantiles, melt, quantiles
from tabweave.session import materialize


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_null, pct_null) for columns with any NULL; one aggregation for all columns."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot(["_n"], list(cols), "feature", "n_null")
    return long.filter(F.col("n_null") > 0).select(
        "feature", "n_null", (F.col("n_null") * 100.0 / F.col("_n")).cast("double").alias("pct_null")
    )


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., feature, count, mean, std, min, max) from one pass over the wide table."""
    stats = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    row = df.groupBy(*by).agg(
        *[fn(F.col(c).cast("double")).cast("double" if s != "count" else "bigint").alias(f"{s}|{c}") for c in cols for s, fn in stats.items()]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{s}|{c}`").alias(s) for s in stats]) for c in cols]
    )
    return row.select(*by, F.inline(cells))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments with exact quartiles."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return moments(df, cols).join(q, "feature", "left")


def class_means(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, mean_0, mean_1, diff)."""
    m = moments(df, cols, [label])
    wide = m.groupBy("feature").agg(
        F.max(F.when(F.col(label) == 0, F.col("mean"))).alias("mean_0"),
        F.max(F.when(F.col(label) == 1, F.col("mean"))).alias("mean_1"),
    )
    return wide.withColumn("diff", F.col("mean_1") - F.col("mean_0"))


def crosstab(df: DataFrame, category: str, label: str) -> DataFrame:
    """Counts per category and label with both margins (``(all)`` rows), by grouping sets."""
    cube = df.groupBy(category, label).agg(F.count(F.lit(1)).alias("_n"))
    out = cube.cube(category, label).agg(
        F.sum("_n").cast("bigint").alias("n"), F.grouping(category).alias("_ga"), F.grouping(label).alias("_gb")
    )
    name = lambda c, g: F.when(F.col(g) == 1, F.lit("(all)")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("missing")))
    return out.select(name(category, "_ga").alias("category"), name(label, "_gb").alias("class"), "n")


def tercile_pivot(df: DataFrame, row: str, col: str, label: str, n_bins: int = 3) -> DataFrame:
    """Mean label in right-closed quantile bins of two columns, columns spread wide."""
    edges = fit_bin_edges(df, [row, col], n_bins)
    binned = df.select(
        bin_index(row, edges[row], "right").alias("row_bin"), bin_index(col, edges[col], "right").alias("col_bin"), label
    ).filter(F.col("row_bin").isNotNull() & F.col("col_bin").isNotNull())
    cells = binned.groupBy("row_bin", "col_bin").agg(F.avg(F.col(label).cast("double")).alias("rate"))
    wide = cells.groupBy("row_bin").pivot("col_bin", list(range(len(edges[col]) + 1))).agg(F.max("rate"))
    return wide.select("row_bin", *[F.col(str(i)).alias(f"col_{i}") for i in range(len(edges[col]) + 1)])


def category_shares(df: DataFrame, cols: Sequence[str], side: Column) -> DataFrame:
    """(feature, value, share_a, share_b, diff) in percent; ``side`` is true for the second table."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (
        df.select(side.alias("_b"), F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if(~F.col("_b")).alias("a"), F.count_if(F.col("_b")).alias("b"))
    )
    # Totals per feature: a second, tiny aggregation instead of a window over all values.
    totals = counts.groupBy(F.col("feature").alias("_f")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    pct = lambda x, t: F.coalesce(F.try_divide(F.col(x).cast("double") * 100, F.col(t).cast("double")), F.lit(0.0))
    return counts.join(totals, F.col("feature") == F.col("_f")).select(
        "feature", "value", pct("a", "ta").alias("share_a"), pct("b", "tb").alias("share_b"),
        (pct("b", "tb") - pct("a", "ta")).alias("diff"),
    )


def psi(df: DataFrame, cols: Sequence[str], side: Column, n_bins: int = 20) -> DataFrame:
    """Population stability index per column; bins are quantiles of the first side."""
    marked = df.select(*cols, side.alias("_b"))
    edges = fit_bin_edges(marked.filter(~F.col("_b")), cols, n_bins, unique=False)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_index(c, edges[c]).alias("bin")) for c in cols])
    counts = (
        marked.select("_b", F.inline(cells))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count_if(~F.col("_b")).alias("a"), F.count_if(F.col("_b")).alias("b"))
    )
    feature = Window.partitionBy("feature")  # at most n_bins rows
    floor = lambda x: F.greatest(F.col(x).cast("double") / F.sum(x).over(feature).cast("double"), F.lit(1e-6))
    shares = counts.select("feature", floor("a").alias("pa"), floor("b").alias("pb"))
    return shares.groupBy("feature").agg(F.sum((F.col("pa") - F.col("pb")) * F.ln(F.col("pa") / F.col("pb"))).alias("psi"))


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each equal group (NULLs equal)."""
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum(F.col("n") - 1).cast("bigint").alias("duplicates"), F.count_if(F.col("n") > 1).alias("groups"))


def _steps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values with the previous distinct value of their column: (feature, value, prev, cnt).

    Neighbours are found inside range buckets; each bucket's first value takes the previous
    bucket's last one, so no column is sorted in a single task.
    """
    long = melt(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    distinct = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranged = materialize(distinct.repartitionByRange("feature", "value").withColumn("_b", F.spark_partition_id()), "steps")
    last = ranged.groupBy("feature", "_b").agg(F.max("value").alias("last"))
    carried = last.select(  # one row per bucket
        F.col("feature").alias("_f"), F.col("_b").alias("_pb"),
        F.lag("last").over(Window.partitionBy("feature").orderBy("_b")).alias("_carry"),
    )
    local = F.lag("value").over(Window.partitionBy("feature", "_b").orderBy("value"))
    return (
        ranged.withColumn("_prev", local)
        .join(carried, (F.col("feature") == F.col("_f")) & (F.col("_b") == F.col("_pb")))
        .select("feature", "value", F.coalesce("_prev", "_carry").alias("prev"), "cnt")
    )


def steps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Step between consecutive distinct values: (feature, value, step); the first value has none."""
    return _steps(df, cols).filter(F.col("prev").isNotNull()).select(
        "feature", "value", (F.col("value") - F.col("prev")).alias("step")
    )


def granularity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_distinct, integer_share, min_step, median_step, max_step)."""
    s = materialize(_steps(df, cols).withColumn("step", F.col("value") - F.col("prev")), "granularity")
    base = s.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        (F.sum(F.when(F.abs(F.col("value") - F.rint("value")) < 1e-9, F.col("cnt")).otherwise(0)).cast("double")
         / F.sum("cnt").cast("double")).alias("integer_share"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
    )
    steps_only = s.filter(F.col("step").isNotNull()).select("feature", F.col("step").alias("value"))
    mid = long_quantiles(steps_only, ["feature"], [0.5]).select("feature", F.col("value").alias("median_step"))
    return base.join(mid, "feature", "left")


def rate_curve(df: DataFrame, cols: Sequence[str], label: str, n_bins: int = 10) -> DataFrame:
    """(feature, bin, n, rate) over right-closed quantile bins."""
    edges = fit_bin_edges(df, cols, n_bins)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_index(c, edges[c], "right").alias("bin")) for c in cols])
    return (
        df.select(F.col(label).cast("double").alias("_y"), F.inline(cells))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"))
    )


def monotonic_verdict(curve: DataFrame, share: float = 0.8) -> DataFrame:
    """(feature, rising_share, falling_share, verdict) from consecutive bins of a rate curve."""
    step = F.col("rate") - F.lag("rate").over(Window.partitionBy("feature").orderBy("bin"))  # n_bins rows
    signs = curve.withColumn("_s", step).filter(F.col("_s").isNotNull())
    out = signs.groupBy("feature").agg(
        F.avg((F.col("_s") >= 0).cast("double")).alias("rising_share"),
        F.avg((F.col("_s") <= 0).cast("double")).alias("falling_share"),
    )
    verdict = F.when(F.col("rising_share") >= share, "rising").when(F.col("falling_share") >= share, "falling").otherwise("mixed")
    return out.withColumn("verdict", verdict)


def value_rates(df: DataFrame, col: str, label: str, low: int, high: int) -> DataFrame:
    """Count and mean label per value, for values seen more than ``low`` and less than ``high`` times."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
        .filter((F.col("n") > low) & (F.col("n") < high))
    )


def residual_identity(df: DataFrame, whole: str, parts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, std, min, max of whole - sum(parts) over complete rows."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    resid = complete_case(F.col(whole) - total, [whole, *parts])
    return df.select(*by, resid.alias("_r")).filter(F.col("_r").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"),
        F.min("_r").alias("min"), F.max("_r").alias("max"),
    )
