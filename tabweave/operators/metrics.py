"""Exact evaluation metrics over scored tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.comoments import comoments, nothing
from tabweave.operators.ordering import average_rank, cumulate, melt
from tabweave.session import materialize

_WIDE = "decimal(38,0)"


def auc_from_counts(df: DataFrame, score: str, pos: Column, neg: Column, by: Sequence[str] = ()) -> DataFrame:
    """AUC where each row stands for ``pos`` positives and ``neg`` negatives.

    Counts positives over negatives on distinct scores.  The pair counts are exact
    decimals, so equal AUCs compare equal whatever the partitioning; AUC is NULL when a
    class is absent.
    """
    cum = cumulate(df, score, by, {"pos": pos, "neg": neg})
    twice = F.col("pos").cast("decimal(18,0)") * (F.col("neg_before") * 2 + F.col("neg")).cast("decimal(19,0)")
    out = cum.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(twice.cast(_WIDE)).alias("_u2")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * 2
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_u2").cast("double"), pairs).alias("auc"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware ROC-AUC per group: (by.., n_pos, n_neg, auc).  NULL scores or labels are left out."""
    y = F.col(label).cast("int")
    return auc_from_counts(df.filter(F.col(label).isNotNull()), score, y, 1 - y, by)


def auc_of_columns(df: DataFrame, cols: Sequence[str], label: str, by: Sequence[str] = (), name: str = "feature") -> DataFrame:
    """AUC of several columns in one pass over the long form."""
    return auc(melt(df, cols, [label, *by], name, "_score"), "_score", label, [name, *by])


def auc_value(df: DataFrame, score: str, label: str) -> float | None:
    row = auc(df, score, label).first()
    return None if row is None else row["auc"]


def ranks_long(long: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Average-tie rank per (by, value), written once: (by.., value, cnt, avg_rank, n)."""
    cum = cumulate(long, value, by)
    return materialize(
        cum.select(*by, value, "cnt", average_rank().alias("avg_rank"), F.col("cnt_total").alias("n")), "ranks"
    )


def pearson_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair: (a, b, r); NULL where it is not defined.

    One scan, whatever the number of columns: tasks sum up matrix products (see :mod:`tabweave.operators.comoments`).
    """
    cols = list(cols)
    found = comoments(df, cols).get(None, nothing(len(cols))).correlations()
    rows = [(cols[i], cols[j], None if np.isnan(found[i, j]) else float(found[i, j])) for i, j in combinations(range(len(cols)), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def mean_label_by(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("positives"))


def regression_quality(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """R^2 (population variance) and Pearson r of predictions."""
    err = F.col(truth) - F.col(pred)
    return df.groupBy(*by).agg(
        (1 - F.try_divide(F.avg(err * err), F.var_pop(truth))).alias("r2"), F.corr(truth, pred).alias("pearson_r")
    )


def banded(df: DataFrame, value: str, bands: Sequence[tuple[float, str]], name: str) -> DataFrame:
    """The label of the first band whose lower bound the value exceeds (the last band's without one)."""
    out = F.lit(bands[-1][1])
    for least, label in reversed(list(bands[:-1])):
        out = F.when(F.col(value) > least, label).otherwise(out)
    return df.withColumn(name, out)


def focal_loss(df: DataFrame, prob: str, label: str, gamma: float, alpha: float = 0.5) -> DataFrame:
    """Mean of -weight (1 - p)^gamma ln p over the probability p of the row's own class, kept off 0 and 1."""
    own = F.abs(F.col(label) - 1 + F.col(prob)).cast("double")
    own = F.greatest(F.least(own, F.lit(1 - 1e-9)), F.lit(1e-9))
    weight = F.lit(1 - alpha) + F.col(label) * F.lit(2 * alpha - 1)
    return df.select((weight * F.pow(1 - own, F.lit(float(gamma))) * -F.ln(own)).alias("loss")).agg(F.avg("loss").alias("focal_loss"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        F.try_divide(neg.cast("double"), pos.cast("double")).alias("neg_pos_ratio"),
        F.try_divide((pos + neg).cast("double"), (pos * 2).cast("double")).alias("balanced_weight_pos"),
        F.try_divide((pos + neg).cast("double"), (neg * 2).cast("double")).alias("balanced_weight_neg"),
    )


def fold_mean(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias(score))
