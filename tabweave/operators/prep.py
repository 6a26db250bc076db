"""Model-input preparation with train-fitted statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rowwise import missing_label
from tabweave.operators.joins import lookup_many, sizes_by
from tabweave.operators.ordering import cumulate, fit_medians
from tabweave.operators.sets import vocabulary
from tabweave.session import materialize

ONE_HOT_LIMIT = 1_000


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"columns not in table: {', '.join(missing)}")


def drop_validated(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns, failing when any of them is absent (checked on the schema, no job)."""
    require_columns(df, cols)
    return df.drop(*cols)


def fit_fill_scale(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Per column (median, mean, population std) of the median-filled training column."""
    medians = fit_medians(train, cols)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))) for c in cols}
    row = train.agg(
        *[F.avg(e).alias(f"m|{c}") for c, e in filled.items()], *[F.stddev_pop(e).alias(f"s|{c}") for c, e in filled.items()]
    ).first()
    return {c: (medians.get(c, 0.0), row[f"m|{c}"], row[f"s|{c}"] or 1.0) for c in cols}


def fill_scale(fitted: dict[str, tuple[float, float, float]], prefix: str = "z_") -> dict[str, Column]:
    return {
        f"{prefix}{c}": (F.coalesce(F.col(c).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(std)
        for c, (med, mean, std) in fitted.items()
    }


def mask_block(cols: Sequence[str], prefix: str = "miss_") -> dict[str, Column]:
    return {f"{prefix}{c}": F.col(c).isNull().cast("double") for c in cols}


def category_index(rows: DataFrame, cols: Sequence[str], prefix: str = "cat_", key: str = "id") -> DataFrame:
    """0-based position of each label in its column's sorted vocabulary, missing as a label."""
    labels = {c: missing_label(c) for c in cols}
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), e.alias("value")) for c, e in labels.items()])
    table = materialize(
        cumulate(rows.select(F.inline(cells)), "value", ["feature"]).select("feature", "value", "cnt", "idx_before"), "vocab"
    )
    cells = {c: {"value": e} for c, e in labels.items()}
    return lookup_many(rows, table, cells, {c: {"idx_before": f"{prefix}{c}"} for c in cols}, "cnt", sizes_by(table), key)


def fit_one_hot(train: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted vocabulary per column; refuses vocabularies too large to spread into columns."""
    table = materialize(vocabulary(train, cols), "vocab")
    if table.count() > ONE_HOT_LIMIT:
        raise ValueError("vocabulary too large for one-hot columns; use an encoding or an index instead")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in table.collect():
        out[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(vocab: dict[str, list[str]], drop_first: bool = True) -> dict[str, Column]:
    return {
        f"{c}={v}": (missing_label(c) == v).cast("double")
        for c, values in vocab.items()
        for v in (values[1:] if drop_first else values)
    }


def assemble(df: DataFrame, cols: Sequence[str], keep: Sequence[str], sentinel: float = -999.0, out: str = "features") -> DataFrame:
    """Vector column of ``cols`` (missing as the sentinel) next to ``keep``, in one projection."""
    filled = df.select(*keep, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(sentinel)).alias(f"_f{i}") for i, c in enumerate(cols)])
    names = [f"_f{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol=out).transform(filled).select(*keep, out)
