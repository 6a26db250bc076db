"""The full feature matrix: raw, derived, encoded, counted, imputed and reference blocks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions import rowwise as rw
from tabweave.operators import encode, joins, refdist, sets
from tabweave.operators.model import model_impute
from tabweave.operators.prep import category_index
from tabweave.plans.frames import CATS, CONT, DECIMALS, FEATURES, PARTS, RATIOS, WHOLE, archive, current
from tabweave.session import materialize

DOMINANT = {"returned": "qty_r", "accepted": "qty_a", "none": "qty_n"}


def derived() -> dict[str, Column]:
    """Every derived row column, as one projection's worth of expressions."""
    parts = rw.null_skipping_sum(PARTS)
    out = {
        "sum_parts": parts,
        **{n: rw.ratio(a, b) for n, (a, b) in RATIOS.items()},
        "diff_bal_total": F.col("acctbal") - F.col("total_k"),
        "diff_total_sum_clean": rw.complete_case(F.col(WHOLE) - parts, [WHOLE, *PARTS]),
        "row_max": rw.row_max(PARTS),
        "row_range": rw.row_range(PARTS),
        **{f"gap_{c[-1]}": rw.gap_to_max(c, PARTS) for c in PARTS},
    }
    for c in DECIMALS:
        out |= {f"frac_{c}": rw.fraction(c), f"d1_{c}": rw.first_decimal(c)}
    return out


@dataclass(frozen=True)
class MatrixSpec:
    encoded: tuple[str, ...] = (*CONT, *CATS, "dominant")
    cdf: tuple[str, ...] = ("total_k", "qty", "disc")
    medians: tuple[str, ...] = ("total_k", "qty", "disc")
    rates: tuple[str, ...] = ("total_k", "disc")
    kernels: tuple[str, ...] = ("qty", "lines")
    imputed: tuple[str, ...] = ()
    smoothing: float = 3.0
    families: tuple[str, ...] = field(default=("raw", "derived", "te", "freq", "ref"))


def clean_reference(frame: DataFrame) -> DataFrame:
    """The archive without rows that a current row repeats on all features, one row for each set of feature values."""
    alone = joins.null_safe_anti_join(archive(frame), current(frame), CONT, CATS)
    return materialize(sets.keep_first(alone, FEATURES, "id"), "reference")


def build_matrix(frame: DataFrame, spec: MatrixSpec = MatrixSpec()) -> DataFrame:
    """Feature columns next to id, label, fold and split for every current row of ``frame``.

    The reference blocks are fitted on the cleaned archive, which shares no row with the
    matrix, so no row meets its own label there.  The frame is written once with its
    derived columns; each block then adds columns by projection or by a join with a
    table of measured size.
    """
    whole = materialize(
        frame.withColumns({**derived(), "dominant": rw.row_argmax(DOMINANT)}), "base"
    )
    base = current(whole)
    train, test = base.filter(F.col("split") == "train"), base.filter(F.col("split") == "test")
    out, cols = base, []
    if "te" in spec.families:
        enc = encode.fit_encoding(train, spec.encoded, "label", "fold")
        out = encode.encode_oof(train, enc, "fold", spec.smoothing).unionByName(encode.encode_full(test, enc, spec.smoothing))
        cols += [f"te_{c}" for c in spec.encoded]
    if "freq" in spec.families:
        out = encode.frequency_encode(out, spec.encoded, count_on=base)
        cols += [f"freq_{c}" for c in spec.encoded]
    if "ref" in spec.families:
        ref = clean_reference(whole)
        out = refdist.add_ecdf(out, refdist.fit_ecdf(ref, spec.cdf, "label"), spec.cdf, spec.cdf, base=base)
        q = refdist.reference_quantiles(ref, [*spec.medians, *spec.rates, *spec.kernels], "label")
        out = refdist.add_reference_scalars(out, refdist.fit_reference(ref, "label", spec.medians, spec.rates, quantiles=q))
        out = refdist.add_kernel_log_ratio(out, refdist.fit_kernels(ref, spec.kernels, "label", quantiles=q), values=base)
        cols += [c for c in out.columns if "__ref_" in c]
    if spec.imputed:
        filled = model_impute(category_index(base, CATS), spec.imputed, [*CONT, *[f"cat_{c}" for c in CATS]])
        out = out.join(filled, "id")
        cols += [f"imp_{c}" for c in spec.imputed]
    raw = {c: rw.numeric_or(c) for c in [*CONT, *CATS]} if "raw" in spec.families else {}
    new = {c: rw.numeric_or(c) for c in derived()} if "derived" in spec.families else {}
    return out.select("id", "label", "fold", "split", *[e.alias(c) for c, e in {**raw, **new}.items()], *cols)


def matrix_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("id", "label", "fold", "split")]
