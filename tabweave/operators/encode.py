"""Target, frequency and pair encodings.

A *feature* is a tuple of one or two columns.  All features of a call are counted in one
aggregation over a long form (feature, k1, k2, fold): rows are reduced map-side to their
distinct keys, so only keys are shuffled and a hot key is one row per task.  Out-of-fold
sums are the key's total minus its own fold, which equals refitting without that fold; nested
encodings leave a second fold out in the same way.  NULL is a category of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.joins import lookup_many, sizes_by
from tabweave.session import materialize

Feature = tuple[str, ...]


def as_feature(f: str | Sequence[str]) -> Feature:
    return (f,) if isinstance(f, str) else tuple(f)


def feature_name(f: Feature) -> str:
    return "__".join(f)


def _key(df: DataFrame, col: str) -> Column:
    """A column as a text key; negative zero is zero."""
    value = F.col(col)
    return (value + F.lit(0.0) if dict(df.dtypes)[col] in ("double", "float") else value).cast("string")


def _keys(df: DataFrame, f: Feature) -> dict[str, Column]:
    return {f"k{i}": _key(df, c) for i, c in enumerate(f, 1)}


def _long_keys(df: DataFrame, features: Sequence[Feature], keep: Sequence[str]) -> DataFrame:
    none = {"k2": F.lit(None).cast("string")}
    cells = [F.struct(F.lit(feature_name(f)).alias("feature"), *[e.alias(k) for k, e in (none | _keys(df, f)).items()]) for f in features]
    return df.select(*keep, F.inline(F.array(*cells)))


def m_estimate(n: Column, s: Column, prior: Column | float, m: Column | float) -> Column:
    """(sum + m prior) / (n + m); the prior itself when nothing was seen."""
    prior = F.lit(prior) if isinstance(prior, float) else prior
    m = F.lit(float(m)) if isinstance(m, (int, float)) else m
    return F.when(n == 0, prior).otherwise((s + m * prior) / (n + m))


@dataclass(frozen=True)
class FittedEncoding:
    """Counts per (feature, key, fold) and per (feature, key), and the global label mean."""

    features: tuple[Feature, ...]
    by_fold: DataFrame
    totals: DataFrame
    prior: float
    sizes: dict[str, tuple[int, int]]  # per feature: rows of by_fold, rows of totals


def fit_encoding(train: DataFrame, features: Sequence[str | Sequence[str]], label: str, fold: str) -> FittedEncoding:
    feats = tuple(as_feature(f) for f in features)
    train = train.filter(F.col(label).isNotNull())  # a row without a label counts in no rate
    counted = (
        _long_keys(train, feats, [F.col(fold).alias("fold"), F.col(label).alias("_y")])
        .groupBy("feature", "k1", "k2", "fold")
        .agg(F.count(F.lit(1)).alias("n_in"), F.sum("_y").cast("bigint").alias("s_in"))
    )
    key = Window.partitionBy("feature", "k1", "k2")  # at most one row per fold in a group
    by_fold = materialize(
        counted.select("*", F.sum("n_in").over(key).alias("n"), F.sum("s_in").over(key).alias("s")), "enc"
    )
    totals = materialize(by_fold.groupBy("feature", "k1", "k2").agg(F.max("n").alias("n"), F.max("s").alias("s")), "enc")
    head = by_fold.groupBy("feature").agg(F.sum("n_in").alias("n"), F.sum("s_in").alias("s"), F.count(F.lit(1)).alias("rows"))
    by = {r["feature"]: r for r in head.collect()}  # one row per feature
    full = sizes_by(totals)
    any_row = by[feature_name(feats[0])]
    return FittedEncoding(
        feats, by_fold, totals, float(any_row["s"]) / float(any_row["n"]), {f: (by[f]["rows"], full[f]) for f in by}
    )


def _encoded(rows: DataFrame, enc: FittedEncoding, table: DataFrame, weight: str, side: int, prefix: str, key: str, more: dict[str, Column]) -> DataFrame:
    """``rows`` with the table's ``enc`` per feature; unseen keys get the prior."""
    names = {feature_name(f): f"{prefix}{feature_name(f)}" for f in enc.features}
    cells = {feature_name(f): {**_keys(rows, f), **more} for f in enc.features}
    sizes = {f: n[side] for f, n in enc.sizes.items()}
    out = lookup_many(rows, table, cells, {f: {"enc": n} for f, n in names.items()}, weight, sizes, key)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(enc.prior)) for n in names.values()})


def encode_oof(train: DataFrame, enc: FittedEncoding, fold: str, m: float = 3.0, prefix: str = "te_", key: str = "id") -> DataFrame:
    """Training rows with ``te_<feature>`` computed from all folds but their own; ``key`` tells rows apart."""
    rest = m_estimate(F.col("n") - F.col("n_in"), F.col("s") - F.col("s_in"), enc.prior, m)
    table = enc.by_fold.select("feature", "k1", "k2", "fold", "n_in", rest.alias("enc"))
    return _encoded(train, enc, table, "n_in", 0, prefix, key, {"fold": F.col(fold)})


def encode_full(rows: DataFrame, enc: FittedEncoding, m: float = 3.0, prefix: str = "te_", key: str = "id") -> DataFrame:
    """Other rows (test side) encoded from every training row; unseen keys get the prior."""
    table = enc.totals.select("feature", "k1", "k2", "n", m_estimate(F.col("n"), F.col("s"), enc.prior, m).alias("enc"))
    return _encoded(rows, enc, table, "n", 1, prefix, key, {})


@dataclass(frozen=True)
class NestedEncoding:
    """Encodings for every outer fold left out, as arrays over the outer folds.

    ``by_inner``: per (feature, key, inner fold) ``apart``, from rows of neither that inner fold nor the outer one, and ``rest``, from
    all rows outside the outer fold; ``totals``: ``rest`` per (feature, key); ``priors``: label mean outside each outer fold.
    """

    features: tuple[Feature, ...]
    by_inner: DataFrame
    totals: DataFrame
    priors: tuple[float, ...]
    sizes: dict[str, tuple[int, int]]


def fit_nested(train: DataFrame, features: Sequence[str | Sequence[str]], label: str, inner: str, outer: str, k: int, m: float = 3.0) -> NestedEncoding:
    """Encodings for models that are validated on the ``k`` outer folds, from one aggregation over (key, inner fold, outer fold).

    A model that leaves outer fold v out must not meet v's labels through its features either: its
    training rows are encoded without v and without their own inner fold, its validation and test rows
    without v.  Both are sums of the cells' counts by inclusion and exclusion, as if refitted for each pair of folds.
    """
    feats = tuple(as_feature(f) for f in features)
    train = train.filter(F.col(label).isNotNull())
    of = lambda c, v: F.sum(F.when(F.col("outer") == v, F.col(c)).otherwise(0))
    cells = _long_keys(train, feats, [F.col(inner).alias("inner"), F.col(outer).alias("outer"), F.lit(1).alias("_n"), F.col(label).cast("bigint").alias("_s")])
    counted = cells.groupBy("feature", "k1", "k2", "inner").agg(
        F.sum("_n").alias("n_in"), F.sum("_s").alias("s_in"), *[of(f"_{c}", v).alias(f"{c}_in{v}") for v in range(k) for c in ("n", "s")]
    )
    key = Window.partitionBy("feature", "k1", "k2")  # one row an inner fold
    names = [f"{c}_in{x}" for x in ["", *range(k)] for c in ("n", "s")]
    known = materialize(counted.select("*", *[F.sum(c).over(key).alias(c.replace("_in", "_all")) for c in names]), "nested")
    one = known.filter(F.col("feature") == feature_name(feats[0])).agg(*[F.sum(c).alias(c) for c in names]).first()
    outside = [(one["n_in"] - one[f"n_in{v}"], one["s_in"] - one[f"s_in{v}"]) for v in range(k)]
    priors = tuple(float(s) / float(n) if n else 0.0 for n, s in outside)
    rest = F.array(*[m_estimate(F.col("n_all") - F.col(f"n_all{v}"), F.col("s_all") - F.col(f"s_all{v}"), priors[v], m) for v in range(k)])
    without = lambda c, v: F.col(f"{c}_all") - F.col(f"{c}_in") - F.col(f"{c}_all{v}") + F.col(f"{c}_in{v}")
    apart = F.array(*[m_estimate(without("n", v), without("s", v), priors[v], m) for v in range(k)])
    by_inner = materialize(known.select("feature", "k1", "k2", "inner", "n_in", "n_all", apart.alias("apart"), rest.alias("rest")), "nested")
    totals = materialize(by_inner.groupBy("feature", "k1", "k2").agg(F.max("n_all").alias("n"), F.max("rest").alias("rest")), "nested")
    sizes = (sizes_by(by_inner), sizes_by(totals))
    return NestedEncoding(feats, by_inner, totals, priors, {feature_name(f): tuple(x.get(feature_name(f), 0) for x in sizes) for f in feats})


def encode_nested(train: DataFrame, enc: NestedEncoding, inner: str, outer: str, prefix: str = "te_", key: str = "id") -> DataFrame:
    """Training rows with ``te_<feature>``: an array with the encoding for the model of each outer fold."""
    names = {feature_name(f): f"{prefix}{feature_name(f)}" for f in enc.features}
    cells = {feature_name(f): {**_keys(train, f), "inner": F.col(inner)} for f in enc.features}
    take = {f: {"apart": f"_a_{f}", "rest": f"_r_{f}"} for f in names}
    out = lookup_many(train, enc.by_inner, cells, take, "n_in", {f: n[0] for f, n in enc.sizes.items()}, key)
    none = [F.lit(p) for p in enc.priors]
    pick = lambda f: F.array(*[F.coalesce(F.when(F.col(outer) == v, F.col(f"_r_{f}")[v]).otherwise(F.col(f"_a_{f}")[v]), none[v]) for v in range(len(none))])
    return out.withColumns({n: pick(f) for f, n in names.items()}).drop(*[c for f in names for c in (f"_a_{f}", f"_r_{f}")])


def encode_nested_full(rows: DataFrame, enc: NestedEncoding, prefix: str = "te_", key: str = "id") -> DataFrame:
    """Other rows with the same arrays: what each outer fold's model knows."""
    names = {feature_name(f): f"{prefix}{feature_name(f)}" for f in enc.features}
    cells = {feature_name(f): _keys(rows, f) for f in enc.features}
    out = lookup_many(rows, enc.totals, cells, {f: {"rest": n} for f, n in names.items()}, "n", {f: n[1] for f, n in enc.sizes.items()}, key)
    return out.withColumns({n: F.coalesce(F.col(n), F.array(*[F.lit(p) for p in enc.priors])) for n in names.values()})


def encoding_table(train: DataFrame, features: Sequence[str | Sequence[str]], label: str, m: float) -> DataFrame:
    """Full-data m-estimate per key: (feature, k1, k2, n, s, enc)."""
    feats = [as_feature(f) for f in features]
    train = train.filter(F.col(label).isNotNull())
    prior = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    counted = (
        _long_keys(train, feats, [F.col(label).alias("_y")])
        .groupBy("feature", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("bigint").alias("s"))
    )
    return counted.withColumn("enc", m_estimate(F.col("n"), F.col("s"), prior, m))


def smoothing_grid(enc: FittedEncoding, grid: Sequence[float]) -> DataFrame:
    """Out-of-fold encodings for several m from one set of counts: (feature, m, enc, pos, neg).

    Every (key, fold) cell carries its own positive and negative counts, so the AUC of each
    smoothing value follows from the cells without going back to the rows.
    """
    cells = enc.by_fold.select(
        "feature", "n_in", "s_in",
        (F.col("n") - F.col("n_in")).alias("n_out"),
        (F.col("s") - F.col("s_in")).alias("s_out"),
        F.explode(F.array(*[F.lit(float(m)) for m in grid])).alias("m"),
    )
    return cells.select(
        "feature", "m",
        m_estimate(F.col("n_out"), F.col("s_out"), enc.prior, F.col("m")).alias("enc"),
        F.col("s_in").alias("pos"), (F.col("n_in") - F.col("s_in")).alias("neg"),
    )


def frequency_encode(
    rows: DataFrame, features: Sequence[str | Sequence[str]], prefix: str = "freq_", count_on: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """Count of each row's key over all the rows given, train and test together.

    ``count_on`` is the table to count, when ``rows`` is a widened view of it.
    """
    feats = [as_feature(f) for f in features]
    counts = materialize(
        _long_keys(rows if count_on is None else count_on, feats, [])
        .groupBy("feature", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("n")),
        "freq",
    )
    cells = {feature_name(f): _keys(rows, f) for f in feats}
    return lookup_many(rows, counts, cells, {f: {"n": f"{prefix}{f}"} for f in cells}, "n", sizes_by(counts), key, count_on)


def pair_density(rows: DataFrame, pairs: Sequence[Feature], min_density: float = 0.0) -> DataFrame:
    """Rows per distinct key of each pair: (pair, n_rows, n_cells, density), kept at ``min_density``."""
    cells = _long_keys(rows, pairs, []).groupBy("feature", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    return (
        cells.groupBy(F.col("feature").alias("pair"))
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"))
        .withColumn("density", F.col("n_rows").cast("double") / F.col("n_cells").cast("double"))
        .filter(F.col("density") >= min_density)
    )


def value_index(rows: DataFrame, cols: Sequence[str], prefix: str = "idx_", key: str = "id") -> DataFrame:
    """Dense 1-based rank of each value among the distinct values of its column; 0 when missing."""
    from tabweave.operators.ordering import cumulate, melt

    ranked = materialize(
        cumulate(melt(rows, cols), "value", ["feature"]).select(
            "feature", "value", "cnt", (F.col("idx_before") + 1).alias("position")
        ),
        "vocab",
    )
    cells = {c: {"value": F.col(c).cast("double")} for c in cols}
    out = lookup_many(rows, ranked, cells, {c: {"position": f"{prefix}{c}"} for c in cols}, "cnt", sizes_by(ranked), key)
    return out.withColumns({f"{prefix}{c}": F.coalesce(F.col(f"{prefix}{c}"), F.lit(0).cast("bigint")) for c in cols})
