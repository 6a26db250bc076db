"""Proofs that fitted models are what they should be, each from one aggregation over the rows they were fitted on."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.base import Model
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.comoments import comoments, nothing
from tabweave.operators.metrics import auc
from tabweave.operators.model import OofResult, fit_all, score_of

#: Iterative solvers stop near the optimum: gradients up to this much a row and standard unit count as none.
GRADIENT, EXACT = 2e-3, 1e-6


def linear_residual(model: Model, rows: DataFrame) -> float:
    """How far a penalised logistic or least-squares fit is from its optimum: the largest subgradient that is not zero.

    At the optimum the mean of (prediction - label) x feature cancels the penalty's slope, and for coefficients that an
    absolute penalty holds at zero stays within it.  All means come from one scan.
    """
    weights = model.coefficients.toArray()
    p = len(weights)
    predicted = vector_to_array(F.col("probability"))[1] if model.hasParam("probabilityCol") else F.col("prediction")
    x = vector_to_array(F.col("features"))
    table = model.transform(rows).select((predicted - F.col("label")).alias("r"), *[x[i].alias(f"x{i}") for i in range(p)])
    found = comoments(table, ["r", *[f"x{i}" for i in range(p)]]).get(None, nothing(p + 1))
    n = max(float(found.n[0, 0]), 1.0)
    slope = found.sums()[0, 1:] / n
    reg, l1 = model.getOrDefault("regParam"), model.getOrDefault("elasticNetParam")
    smooth = slope + reg * (1 - l1) * weights
    off = np.where(weights != 0, np.abs(smooth + reg * l1 * np.sign(weights)), np.maximum(np.abs(smooth) - reg * l1, 0.0))
    unit = np.sqrt(np.diag(found.squares)[1:] / n)
    return float(max(np.where(unit > 0, off / np.maximum(unit, 1.0), 0.0).max(initial=0.0), abs(found.mean[0, 0])))


def booster_residual(model: Model, rows: DataFrame) -> float:
    """How far the leaves of a booster (grown on all rows) are from the means they stand for.

    Each tree is fitted to what the trees before it leave over, so a leaf's value is the mean of that over its rows;
    leaves of all trees are compared in one aggregation.
    """
    y = F.col("label") * 2 - 1
    table, margin, cells = rows.select("features", "label"), F.lit(0.0), []
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        tree = tree.copy()
        tree.setFeaturesCol("features").setPredictionCol(f"p{t}").setLeafCol(f"l{t}")
        table = tree.transform(table)
        target = y.cast("double") if t == 0 else 4 * y / (1 + F.exp(2 * y * margin))
        cells.append(F.struct(F.lit(t).alias("tree"), F.col(f"l{t}").alias("leaf"), F.col(f"p{t}").alias("value"), target.alias("target")))
        margin = margin + F.lit(float(weight)) * F.col(f"p{t}")
    leaves = table.select(F.inline(F.array(*cells))).groupBy("tree", "leaf").agg(F.abs(F.avg("target") - F.avg("value")).alias("gap"))
    return float(leaves.agg(F.max("gap")).first()[0] or 0.0)


def ensemble_residual(model: Model, rows: DataFrame) -> float:
    """Largest difference between an ensemble's score and the score put together from its trees."""
    table = model.transform(rows.select("features")).select("features", score_of(model).alias("_score"))
    total = F.lit(0.0)
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        tree = tree.copy()
        tree.setFeaturesCol("features").setPredictionCol(f"p{t}")
        part = F.col(f"p{t}")
        if tree.hasParam("probabilityCol"):
            tree.setProbabilityCol(f"q{t}").setRawPredictionCol(f"r{t}")
            part = vector_to_array(F.col(f"q{t}"))[1]
        table = tree.transform(table)
        total = total + F.lit(float(weight)) * part
    forest = model.trees[0].hasParam("probabilityCol")
    score = total / F.lit(float(sum(model.treeWeights))) if forest else 1 / (1 + F.exp(-2 * total))
    return float(table.select(F.abs(F.col("_score") - score).alias("gap")).agg(F.max("gap")).first()[0] or 0.0)


def network_residual(model: Model, rows: DataFrame) -> float:
    """Largest difference between a perceptron's probability and a forward pass with its weights."""
    layers, flat, at, blocks = list(model.getOrDefault("layers")), model.weights.toArray(), 0, []
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        blocks.append((flat[at : at + a * b].reshape(a, b).T, flat[at + a * b : at + a * b + b]))
        at += a * b + b

    @F.pandas_udf("double")
    def forward(x):
        import pandas as pd

        z = np.stack(x.to_numpy()) if len(x) else np.zeros((0, layers[0]))
        for i, (w, bias) in enumerate(blocks):
            z = z @ w.T + bias
            z = 1 / (1 + np.exp(-z)) if i + 1 < len(blocks) else np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(z[:, 1] / z.sum(axis=1))

    table = model.transform(rows.select("features")).select(F.abs(score_of(model) - forward(vector_to_array(F.col("features")))).alias("gap"))
    return float(table.agg(F.max("gap")).first()[0] or 0.0)


def residual(model: Model, rows: DataFrame) -> tuple[float, float]:
    """The proof that fits the kind of model, and what counts as none."""
    if hasattr(model, "coefficients"):
        return linear_residual(model, rows), GRADIENT
    if hasattr(model, "weights"):
        return network_residual(model, rows), EXACT
    plain = model.getOrDefault("subsamplingRate") == 1.0 and not (model.hasParam("weightCol") and model.isSet("weightCol"))
    whole = plain and not model.trees[0].hasParam("probabilityCol")
    return (booster_residual(model, rows) if whole else ensemble_residual(model, rows)), EXACT


def auc_gap(scored: DataFrame) -> float:
    """Difference of the exact AUC to that of MLlib's curve through every score."""
    mine = auc(scored, "score", "label").first()
    if mine is None or mine["auc"] is None:
        return 0.0
    curve = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    return abs(mine["auc"] - curve.evaluate(scored.select("score", F.col("label").cast("double").alias("label"))))


def certificate(results: dict[str, OofResult]) -> DataFrame:
    """One row a variant and fold (null: the test side) of k-fold results.

    ``n_rows``, ``id_sum`` and ``positives`` say which rows got an out-of-fold score, ``n_bad`` how many scores are no
    probability, ``is_optimal`` whether the fold's model passes the proof of its kind on the rows it was fitted on, and
    ``auc_agrees`` whether the variant's exact AUC is that of an independent curve.
    """
    spark = next(iter(results.values())).oof.sparkSession
    jobs, names = [], []
    for name, r in results.items():
        for i, m in enumerate(r.models):
            names.append((name, i))
            jobs.append(lambda m=m, r=r, i=i: residual(m, r.frame.train.filter(F.col("fold") != i)))
        names.append((name, None))
        jobs.append(lambda r=r: (auc_gap(r.oof), EXACT))
    good = {n: int(math.isfinite(x) and x <= tol) for n, (x, tol) in zip(names, fit_all(spark, jobs), strict=True)}
    out = None
    bad = F.count_if(F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1))
    for name, r in results.items():
        optimal = F.lit(None).cast("int")
        for i in range(len(r.models)):
            optimal = F.when(F.col("fold") == i, F.lit(good[name, i])).otherwise(optimal)
        sides = r.oof.select("id", F.col("fold").cast("bigint").alias("fold"), "score", F.col("label").cast("bigint").alias("label"))
        sides = sides.unionByName(r.test.select("id", F.lit(None).cast("bigint").alias("fold"), "score", F.lit(None).cast("bigint").alias("label")))
        one = sides.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"), F.sum("label").alias("positives"), bad.alias("n_bad"))
        one = one.select(F.lit(name).alias("variant"), "*", optimal.alias("is_optimal"), F.lit(good[name, None]).alias("auc_agrees"))
        out = one if out is None else out.unionByName(one)
    return out
