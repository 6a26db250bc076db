"""Row features over nullable numeric columns.

All of these are plain projections: Catalyst fuses any number of them into one
whole-stage-codegen project, and NULL is the only missing marker.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: str | Column, den: str | Column) -> Column:
    """NULL when either side is NULL or the divisor is zero."""
    return F.try_divide(_c(num), _c(den))


def null_skipping_sum(cols: Sequence[str | Column]) -> Column:
    """Sum of the non-NULL parts; NULL only when every part is NULL."""
    parts = [_c(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def all_present(cols: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in cols])


def complete_case(expr: Column, cols: Sequence[str | Column]) -> Column:
    """``expr`` where every one of ``cols`` is present, else NULL."""
    return F.when(all_present(cols), expr)


def row_max(cols: Sequence[str]) -> Column:
    return complete_case(F.greatest(*cols), cols)


def row_min(cols: Sequence[str]) -> Column:
    return complete_case(F.least(*cols), cols)


def row_range(cols: Sequence[str]) -> Column:
    return complete_case(F.greatest(*cols) - F.least(*cols), cols)


def gap_to_max(col: str, cols: Sequence[str]) -> Column:
    return complete_case(F.greatest(*cols) - F.col(col), cols)


def row_argmax(named: dict[str, str]) -> Column:
    """Label of the largest column (``label -> column``); the first wins ties."""
    cols = list(named.values())
    top = F.greatest(*cols)
    out = None
    for label, col in named.items():
        hit = F.col(col) == top
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return complete_case(out, cols)


def fraction(col: str | Column) -> Column:
    """Fractional part, in [0, 1) for negative values too."""
    return _c(col) - F.floor(_c(col))


def first_decimal(col: str | Column) -> Column:
    """First decimal digit of floor(10 v), in 0..9."""
    return F.pmod(F.floor(_c(col) * 10), F.lit(10)).cast("double")


def numeric_or(col: str | Column, sentinel: float = -999.0) -> Column:
    """Numeric reading of a column; unreadable and missing become the sentinel."""
    return F.coalesce(_c(col).try_cast("double"), F.lit(sentinel))


def missing_flag(col: str | Column) -> Column:
    return _c(col).isNull().cast("int")


def missing_count(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [missing_flag(c) for c in cols])


def regime(n_missing: Column, top: int = 3) -> Column:
    """0, 1, .. ``top`` where the last regime holds ``top`` or more missing cells."""
    return F.least(n_missing, F.lit(top))


def rule_flag(condition: Column) -> Column:
    """1 / 0 / NULL under three-valued logic: NULL where the rule is undecided."""
    return condition.cast("int")


def pairwise(cols: Sequence[str]) -> dict[str, Column]:
    """Products and differences of every column pair (count fixed by the column list)."""
    out: dict[str, Column] = {}
    for a, b in combinations(cols, 2):
        out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        out[f"{a}_minus_{b}"] = F.col(a) - F.col(b)
    return out


def clip(col: str | Column, low: float, high: float) -> Column:
    """Bounded value; NULL stays NULL (greatest and least would skip it)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def logit(col: str | Column, eps: float = 1e-6) -> Column:
    p = clip(col, eps, 1 - eps)
    return F.ln(p / (1 - p))


def expit(col: str | Column) -> Column:
    return 1 / (1 + F.exp(-_c(col)))


def nan_to_null(col: str | Column) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


def missing_label(col: str | Column, label: str = "missing") -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(label))


def confident_label(score: str | Column, high: float, low: float) -> Column:
    """1 at or above ``high``, 0 at or below ``low``, NULL between."""
    s = _c(score)
    return F.when(s >= high, 1).when(s <= low, 0)


def bin_index(col: str | Column, inner_edges: Sequence[float], closed: str = "left") -> Column:
    """0-based bin of a value between fitted inner edges; NULL stays NULL.

    ``closed='left'`` puts a value equal to an edge above it, ``'right'`` below it.  The
    edges are a fitted, fixed-length list, so this stays a codegen'd sum of comparisons.
    """
    c = _c(col)
    if not inner_edges:
        return F.when(c.isNotNull(), F.lit(0))
    above = [(c >= F.lit(float(e)) if closed == "left" else c > F.lit(float(e))).cast("int") for e in inner_edges]
    return reduce(lambda a, b: a + b, above)


def extended_residual(whole: str, parts: Sequence[str], predicted: dict[str, str]) -> Column:
    """whole - sum(parts); with exactly one of them missing its prediction stands in."""
    cols = [whole, *parts]
    filled = {c: F.coalesce(F.col(c), F.col(predicted[c])) for c in cols}
    value = filled[whole] - reduce(lambda a, b: a + b, [filled[p] for p in parts])
    return F.when(missing_count(cols) <= 1, value)


def weighted_sum(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def within_row_rank_z(cols: Sequence[str], n_rows: Column | int) -> Column:
    """Array of (member, rank, z) over the row's own columns: average-tie rank / ``n_rows`` and its z-score.

    A NULL member has no rank and counts in none of the others'.

    Array functions inside the row: no shuffle, and only as much work as there are columns.
    """
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    values = F.array(*[F.col(c) for c in cols])
    rank = lambda x: (F.size(F.filter(values, lambda o: o < x)) + (F.size(F.filter(values, lambda o: o == x)) + 1) / 2) / n
    ranks = F.transform(values, lambda x: F.when(x.isNotNull(), rank(x)))
    known = F.filter(ranks, lambda v: v.isNotNull())
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))
    names = F.array(*[F.lit(c) for c in cols])
    # One-element arrays: bind ranks, mean and spread once for the expressions that use them.
    first = F.array(F.struct(ranks.alias("r"), known.alias("k"), F.try_divide(total(known, lambda v: v), F.size(known).cast("double")).alias("m")))
    bound = F.transform(first, lambda b: F.struct(b["r"].alias("r"), b["m"].alias("m"), (F.sqrt(F.try_divide(total(b["k"], lambda v: (v - b["m"]) * (v - b["m"])), F.size(b["k"]).cast("double"))) + 1e-12).alias("s")))
    return F.flatten(F.transform(bound, lambda b: F.transform(b["r"], lambda v, i: F.struct(F.get(names, i).alias("member"), v.alias("rank"), ((v - b["m"]) / b["s"]).alias("z")))))
