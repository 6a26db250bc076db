"""Second-level models over member predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rowwise import logit
from tabweave.operators.blend import rank_average
from tabweave.operators.metrics import auc
from tabweave.operators.model import Frame, OofResult, grams, kfold_oof, logistic, model_frame, nonnegative_weights, ridge
from tabweave.session import materialize


def logit_block(df: DataFrame, cols: Sequence[str], prefix: str = "l_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": logit(c) for c in cols})


def meta_frame(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> Frame:
    """Model frame on the members' logits; ``df`` has id, label, fold, split."""
    return model_frame(logit_block(df, cols), [f"l_{c}" for c in cols], keep)


def variant_table(results: dict[str, OofResult | DataFrame]) -> DataFrame:
    """AUC of several out-of-fold results in one pass: (variant, n_pos, n_neg, auc)."""
    out = None
    for name, res in results.items():
        oof = res.oof if isinstance(res, OofResult) else res
        one = oof.select(F.lit(name).alias("variant"), "label", "score")
        out = one if out is None else out.unionByName(one)
    return auc(out, "score", "label", ["variant"])


def top_coefficients(frame: Frame, k: int, alpha: float = 5.0) -> list[str]:
    """The ``k`` columns with the largest absolute ridge coefficient."""
    n = frame.train.count()
    coef = ridge(n, alpha).fit(frame.train).coefficients.toArray()
    ranked = sorted(zip(frame.columns, coef, strict=True), key=lambda t: (-abs(t[1]), t[0]))
    return [c for c, _ in ranked[:k]]


def nonnegative_blend(df: DataFrame, cols: Sequence[str], k: int) -> tuple[DataFrame, dict[str, float]]:
    """Out-of-fold non-negative linear blend and the full-data weights.

    The Gram matrices of all folds come from one scan; leaving a fold out is a subtraction, and
    scoring is a projection over literal weights.
    """
    train = df.filter(F.col("split") == "train")
    found = grams(train, cols, "label", "fold")
    total = {key: sum(g[key] for g in found.values()) for key in next(iter(found.values()))}
    parts = {i: found.get(i, dict.fromkeys(total, 0.0)) for i in range(k)}
    solve = lambda g: nonnegative_weights([(a, b, v) for (a, b), v in g.items()], cols, "label")

    def scored(w: dict[str, float]) -> Column:
        value = F.lit(w["1"])
        for c in cols:
            value = value + F.lit(w[c]) * F.col(c)
        return F.least(F.greatest(value, F.lit(1e-8)), F.lit(1 - 1e-8))

    expr = F.lit(None).cast("double")
    for i in range(k):
        w = solve({key: total[key] - parts[i][key] for key in total})
        expr = F.when(F.col("fold") == i, scored(w)).otherwise(expr)
    full = solve(total)
    out = df.withColumn("score", F.when(F.col("split") == "train", expr).otherwise(scored(full)))
    return out, full


def regime_stack(df: DataFrame, members: Sequence[str], regime: str, k: int, min_rows: int, fallback: Sequence[str]) -> DataFrame:
    """One logistic meta per regime; regimes with under ``min_rows`` training rows get the fallback members' rank mean.

    Every row is scored: regimes come from all rows, and one that only test rows have (or a
    NULL regime) falls back.  Ranks are divided by the regime's size on each side, so both kinds of score are on (0, 1].
    """
    data = materialize(df, "regimes")
    sizes = {r[regime]: r["n"] for r in data.groupBy(regime).agg(F.count_if(F.col("split") == "train").alias("n")).collect()}
    out = None
    for g, n in sorted(sizes.items(), key=lambda x: (x[0] is None, x[0])):
        part = data.filter(F.col(regime).eqNullSafe(F.lit(g)))
        if n < min_rows:
            sides = [rank_average(part.filter(F.col("split") == s), list(fallback)).select("id", "label", "split", "score") for s in ("train", "test")]
            one = sides[0].unionByName(sides[1])
        else:
            res = kfold_oof(meta_frame(part, members), lambda m: logistic(m), k, "refit", keep=["split"])
            test = res.test.join(part.select("id", "label"), "id").select("id", "label", "split", "score")
            one = res.oof.select("id", "label", "split", "score").unionByName(test)
        one = one.withColumn("regime", F.lit(g).cast(dict(df.dtypes)[regime]))
        out = one if out is None else out.unionByName(one)
    return out


def band_correct(df: DataFrame, global_score: str, band_score: str, in_band: Column, usable: Column, k: int) -> tuple[DataFrame, float, float, bool]:
    """Refine scores inside a band with a small logistic model, kept only if the in-band AUC rises.

    Returns the table with ``score``, the in-band AUC before and after, and whether it was
    applied.  Rows in the band that are not ``usable`` keep the global score.
    """
    band = materialize(df.filter(in_band).withColumn("_use", usable), "band")
    stats = band.filter(F.col("split") == "train").agg(F.avg(band_score).alias("m"), F.stddev_pop(band_score).alias("s")).first()
    z = (F.col(band_score) - F.lit(stats["m"])) / (F.lit(stats["s"]) + F.lit(1e-12))
    fed = band.filter("_use").withColumns({"l_global": logit(global_score), "z_band": z})
    res = kfold_oof(model_frame(fed, ["l_global", "z_band"]), lambda n: logistic(n), k, "refit")
    new = materialize(
        res.oof.select("id", "score").unionByName(res.test.select("id", "score")).withColumnRenamed("score", "_new"), "band"
    )
    mixed = band.join(new, "id", "left").withColumn("_mix", F.coalesce("_new", global_score))
    train = mixed.filter(F.col("split") == "train")
    both = train.select("label", F.lit("before").alias("which"), F.col(global_score).alias("score")).unionByName(
        train.select("label", F.lit("after").alias("which"), F.col("_mix").alias("score"))
    )
    aucs = {r["which"]: r["auc"] for r in auc(both, "score", "label", ["which"]).collect()}
    better = (aucs["after"] or 0.0) > (aucs["before"] or 0.0)
    if not better:
        return df.withColumn("score", F.col(global_score)), aucs["before"], aucs["after"], False
    out = df.join(new, "id", "left").withColumn("score", F.coalesce("_new", global_score)).drop("_new")
    return out, aucs["before"], aucs["after"], True
