"""Fold-aware training on MLlib.

Frames carry ``id``, ``label``, ``fold`` (NULL on the test side), ``split`` and a
``features`` vector, and are written once before the fits, so every fit scans a compact
table instead of repeating the feature joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rowwise import clip
from tabweave.operators.comoments import comoments
from tabweave.operators.metrics import auc_value
from tabweave.operators.prep import assemble
from tabweave.operators.trees import Boost, Boosters, grows, validated
from tabweave.session import materialize

PROB_EPS = 1e-8


@dataclass(frozen=True)
class Frame:
    """A written model table and the names of its vector slots."""

    data: DataFrame
    columns: tuple[str, ...] = field(default_factory=tuple)
    #: The table that a view is a slice of, and the places of its columns in that table's vector.
    source: tuple[DataFrame, tuple[int, ...]] | None = None

    @property
    def train(self) -> DataFrame:
        return self.data.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.filter(F.col("split") == "test")

    def sliced(self, cols: Sequence[str]) -> Frame:
        """The same written rows seen through some of the columns: a projection, not a second table."""
        if tuple(cols) == self.columns:
            return self
        at = [self.columns.index(c) for c in cols]
        view = vector_slice(self.data, "features", "_slice", at)
        rest = [c for c in self.data.columns if c != "features"]
        table, places = self.whole()
        return Frame(view.select(*rest, F.col("_slice").alias("features")), tuple(cols), (table, tuple(places[i] for i in at)))

    def whole(self) -> tuple[DataFrame, tuple[int, ...]]:
        """The table under the view, and the places of the view's columns in its vector."""
        return self.source or (self.data, tuple(range(len(self.columns))))


def vector_slice(df: DataFrame, vector: str, out: str, at: Sequence[int]) -> DataFrame:
    return VectorSlicer(inputCol=vector, outputCol=out, indices=list(at)).transform(df)


def model_frame(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> Frame:
    """Assemble and write ``id, label, fold, split, features`` (and ``keep``)."""
    base = ["id", "label", "fold", "split", *keep]
    return Frame(materialize(assemble(df, cols, base), "frame"), tuple(cols))


# --- estimators ---------------------------------------------------------------------

def gbt(**params: Any) -> Estimator:
    return GBTClassifier(labelCol="label", featuresCol="features", **{"seed": 42, **params})


def booster_family(rounds: int = 5) -> dict[str, Estimator]:
    """Three differently parameterised boosters."""
    return {
        "gbt_deep": gbt(maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=20),
        "gbt_wide": gbt(maxIter=rounds, maxDepth=4, stepSize=0.2, featureSubsetStrategy="0.7", maxBins=64),
        "gbt_plain": gbt(maxIter=rounds, maxDepth=3, stepSize=0.3),
    }


def forest(trees: int = 10, depth: int = 5, **params: Any) -> Estimator:
    return RandomForestClassifier(labelCol="label", featuresCol="features", **{"numTrees": trees, "maxDepth": depth, "seed": 42, **params})


def logistic(n_rows: int, c: float = 1.0, l1_ratio: float = 0.0, max_iter: int = 50, tol: float = 1e-5, weight: str | None = None) -> Estimator:
    """Logistic regression whose strength matches an inverse-regularisation C on ``n_rows`` rows."""
    extra = {"weightCol": weight} if weight else {}
    return LogisticRegression(
        labelCol="label", featuresCol="features", regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=l1_ratio,
        maxIter=max_iter, tol=tol, standardization=False, **extra,
    )


def ridge(n_rows: int, alpha: float = 3.0) -> Estimator:
    return LinearRegression(
        labelCol="label", featuresCol="features", regParam=alpha / max(n_rows, 1), elasticNetParam=0.0,
        solver="normal", standardization=False,
    )


def perceptron(n_inputs: int, hidden: Sequence[int] = (48, 24), max_iter: int = 30) -> Estimator:
    return MultilayerPerceptronClassifier(
        labelCol="label", featuresCol="features", layers=[n_inputs, *hidden, 2], maxIter=max_iter, seed=42
    )


# --- scoring and folds ---------------------------------------------------------------

def score_of(model: Model) -> Column:
    """Positive-class probability, or the bounded prediction of a regressor."""
    if model.hasParam("probabilityCol"):
        return vector_to_array(F.col("probability"))[1]
    return clip("prediction", PROB_EPS, 1 - PROB_EPS)


def score(model: Model, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    return model.transform(df).select(*keep, score_of(model).alias(name))


@dataclass(frozen=True)
class OofResult:
    """Out-of-fold scores, test scores, the fold models, and the frame they were fitted on."""

    oof: DataFrame
    test: DataFrame
    models: tuple[Model, ...]
    frame: Frame | None = None

    def long(self, member: str) -> DataFrame:
        oof = self.oof.select("id", F.lit("train").alias("split"), F.lit(member).alias("member"), "fold", "score")
        test = self.test.select("id", F.lit("test").alias("split"), F.lit(member).alias("member"), F.lit(None).cast("bigint").alias("fold"), "score")
        return oof.unionByName(test)


#: Fits that run side by side; each is a sequence of small jobs that leaves cores idle in between.
SIDE_BY_SIDE = 6


def fit_all(spark: SparkSession, fits: Sequence[Callable[[], Any]], parallelism: int | None = None) -> list:
    """Run independent fits side by side, as MLlib's own cross-validator does."""
    with ThreadPool(max(1, min(parallelism or SIDE_BY_SIDE, len(fits)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(f) for f in fits])


def fit_boosters(table: DataFrame, jobs: Sequence[Boost], vector: str = "features") -> list[Model]:
    """Models of boosters over one table, grown together (see :mod:`tabweave.operators.trees`)."""
    if not jobs:
        return []
    found = Boosters(table, jobs, vector, fit_all)
    found.grow({j: b.estimator.getMaxIter() for j, b in enumerate(jobs)})
    return found.models()


_WATCHED = "_watched"


def _watched(estimator: Estimator) -> Estimator:
    """A booster that stops, and is cut, where rows marked by ``_WATCHED`` stop improving."""
    return estimator.copy().setValidationIndicatorCol(_WATCHED)


Fit = Callable[[int], Estimator] | Estimator


def kfold_many(
    variants: dict[str, tuple[Frame, Fit]], k: int, test_mode: str = "mean", keep: Sequence[str] = (), early_stop: Sequence[str] = (), patience: int = 0
) -> dict[str, OofResult]:
    """K-fold results of several variants, (frame, estimator or a function of the row count), from one bounded pool of fits.

    A fold's model is fitted on the other folds and scores its own; test rows get the mean of the fold models or
    the score of one refit.  Boosters named in ``early_stop`` watch their own fold while they grow and are cut to the rounds
    it liked best: by MLlib's rule, or with ``patience`` by :func:`fit_with_patience`; a refit grows the mean of those rounds.
    Frames may be slices of one written table.

    Rows in fold -1 (pseudo rows) train in every fold and are never scored.  Fold models
    are applied to the test side inside one projection, so averaging needs no shuffle.
    """
    spark = next(iter(variants.values()))[0].data.sparkSession
    make = {n: est if callable(est) else (lambda _n, est=est: est) for n, (_, est) in variants.items()}
    distinct = {id(f): f for f, _ in variants.values()}
    counts = dict(zip(distinct, fit_all(spark, [f.train.count for f in distinct.values()]), strict=True))
    size = {n: counts[id(f)] for n, (f, _) in variants.items()}

    def one(name: str, i: int) -> Model:
        train, est = variants[name][0].train, make[name](size[name] * (k - 1) // k)
        if name not in early_stop:
            return est.fit(train.filter(F.col("fold") != i))
        if patience:
            return fit_with_patience(est, train.filter(F.col("fold") != i), train.filter(F.col("fold") == i), patience)
        return _watched(est).fit(train.withColumn(_WATCHED, F.col("fold") == i))

    def boost(name: str, i: int, est: Estimator) -> Boost:
        rows, places = F.col("fold") != i, variants[name][0].whole()[1]
        if name not in early_stop:
            return Boost(est, rows, places)
        stop = (lambda losses: best_prefix(losses, patience)) if patience else validated(est.getValidationTol())
        return Boost(est, rows, places, watch=F.col("fold") == i, stop=stop)

    # Boosters over one table grow together; other learners are fitted one by one beside them.
    jobs, together, alone = [(n, i) for n in variants for i in range(k)], {}, []
    for n, i in jobs:
        (frame, _), est = variants[n], make[n](size[n] * (k - 1) // k)
        table = frame.whole()[0]
        if grows(est, table):
            together.setdefault(id(table), (table, []))[1].append(((n, i), boost(n, i, est)))
        else:
            alone.append((n, i))

    def grown(table: DataFrame, some: list) -> list[tuple]:
        train = table.filter(F.col("split") == "train")
        return [*zip([at for at, _ in some], fit_boosters(train, [b for _, b in some]), strict=True)]

    tasks = [lambda t=t, some=some: grown(t, some) for t, some in together.values()] + [lambda n=n, i=i: [((n, i), one(n, i))] for n, i in alone]
    fitted = dict(pair for pairs in fit_all(spark, tasks) for pair in pairs)
    models = {n: tuple(fitted[n, i] for i in range(k)) for n in variants}

    def refit(name: str) -> Model:
        est = make[name](size[name])
        if name in early_stop:
            est = est.copy().setMaxIter(max(1, round(sum(m.getNumTrees for m in models[name]) / k)))
        return est.fit(variants[name][0].train)

    whole = dict(zip(variants, fit_all(spark, [lambda n=n: refit(n) for n in variants]), strict=True)) if test_mode == "refit" else {}

    def scored(name: str) -> OofResult:
        frame, oof = variants[name][0], None
        for i, m in enumerate(models[name]):
            part = score(m, frame.train.filter(F.col("fold") == i), ["id", "label", "fold", *keep])
            oof = part if oof is None else oof.unionByName(part)
        if name in whole:
            test = score(whole[name], frame.test, ["id", *keep])
        else:
            test = frame.test
            for i, m in enumerate(models[name]):
                test = score(m, test, [*test.columns], f"_s{i}")
            mean = sum((F.col(f"_s{i}") for i in range(1, k)), F.col("_s0")) / k
            test = test.select("id", *keep, mean.alias("score"))
        return OofResult(materialize(oof, "oof"), test, models[name], frame)

    return dict(zip(variants, fit_all(spark, [lambda n=n: scored(n) for n in variants]), strict=True))


def kfold_oof(frame: Frame, estimator: Fit, k: int, test_mode: str = "mean", keep: Sequence[str] = (), early_stop: bool = False, patience: int = 0) -> OofResult:
    """:func:`kfold_many` of one variant."""
    return kfold_many({"one": (frame, estimator)}, k, test_mode, keep, ["one"] if early_stop else [], patience)["one"]


def kfold_sliced(df: DataFrame, cols: Sequence[str], sliced: Sequence[str], estimator: Callable[[int], Estimator] | Estimator, k: int) -> OofResult:
    """K-fold fits in which the columns ``sliced`` are arrays with one value for the model of each fold (nested encodings).

    ``df`` has id, label, fold, split; each fold's model sees its own slice, of one written table.
    """
    data = materialize(df.select("id", "label", "fold", "split", *cols, *sliced), "sliced")
    names = [*cols, *sliced]
    view = [Frame(assemble(data.withColumns({c: F.col(c)[v] for c in sliced}), names, ["id", "label", "fold", "split"]), tuple(names)) for v in range(k)]
    make = estimator if callable(estimator) else (lambda _n: estimator)
    n = view[0].train.count()

    def one(v: int) -> Model:
        est, train = make(n * (k - 1) // k), view[v].train
        if grows(est, train):
            return fit_boosters(train, [Boost(est, F.col("fold") != v, tuple(range(len(names))))])[0]
        return est.fit(train.filter(F.col("fold") != v))

    models = fit_all(data.sparkSession, [lambda v=v: one(v) for v in range(k)])
    oof = test = None
    for v, m in enumerate(models):
        part = score(m, view[v].train.filter(F.col("fold") == v), ["id", "label", "fold"])
        other = score(m, view[v].test, ["id"])
        oof, test = (part, other) if oof is None else (oof.unionByName(part), test.unionByName(other))
    return OofResult(materialize(oof, "oof"), test.groupBy("id").agg(F.avg("score").alias("score")), tuple(models))


def oof_auc(result: OofResult) -> float | None:
    return auc_value(result.oof, "score", "label")


def train_members(
    frame: Frame, members: dict[str, Estimator | Callable[[int], Estimator]], k: int, test_mode: str = "mean", early_stop: Sequence[str] = (), patience: int = 0
) -> DataFrame:
    """Long prediction table of several members, written once; boosters named in ``early_stop`` watch their own fold."""
    out = None
    for name, res in kfold_many({n: (frame, est) for n, est in members.items()}, k, test_mode, (), early_stop, patience).items():
        one = res.long(name)
        out = one if out is None else out.unionByName(one)
    return materialize(out, "pred")


def best_prefix(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the lowest loss, and whether ``patience`` rounds without a lower one came before the end."""
    best, at = math.inf, 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            return at + 1, True
    return at + 1, False


def prefix_model(booster: Model, rounds: int) -> Model:
    """The booster of the first ``rounds`` trees: later trees only correct it, so any prefix is a model of its own."""
    if rounds >= booster.getNumTrees:
        return booster
    whole, gateway = booster._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = whole.trees()[i], whole.treeWeights()[i]
    kind = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel
    out = type(booster)(kind(whole.uid(), trees, weights, whole.numFeatures(), whole.numClasses()))
    for p in booster.params:
        if booster.isSet(p) and out.hasParam(p.name):
            out.set(out.getParam(p.name), booster.getOrDefault(p))
    out._transfer_params_to_java()
    return out


def fit_with_patience(booster: Estimator, train: DataFrame, watch: DataFrame, patience: int = 100) -> Model:
    """A booster that grows until ``patience`` rounds in a row have not lowered the loss on ``watch``, cut to its best round.

    ``maxIter`` is the most it may grow.  It is grown to twice the patience and then to twice as much each time until
    that happens (a longer run begins with the same trees), so the cost follows the rounds that are of use, not the limit.
    """
    limit = booster.getMaxIter()
    rounds = min(limit, 2 * patience)
    while True:
        fitted = booster.copy().setMaxIter(rounds).fit(train)
        best, stopped = best_prefix(fitted.evaluateEachIteration(watch), patience)
        if stopped or rounds >= limit:
            return prefix_model(fitted, best)
        rounds = min(limit, 2 * rounds)


def importances(models: Sequence[Model], columns: Sequence[str]) -> list[tuple[str, float]]:
    """Mean feature importance over fold models, one pair per model column."""
    mean = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    return sorted(zip(columns, (float(v) for v in mean), strict=True), key=lambda t: (-t[1], t[0]))


# --- linear blends from a Gram matrix --------------------------------------------------

def grams(df: DataFrame, cols: Sequence[str], target: str, by: str | None = None) -> dict[Any, dict[tuple[str, str], float]]:
    """Upper triangle of X'X and X'y with an intercept column, for each value of ``by``, from one scan.

    Rows with a missing value are left out of every sum, so a matrix is that of one set of rows.
    """
    names = [*cols, target]
    out = {}
    for g, m in comoments(df.dropna(subset=names), names, by).items():
        products, sums = m.sums(), np.diag(m.n * m.mean)
        cells = {("1", "1"): float(m.n[0, 0]), **{("1", c): float(sums[i]) for i, c in enumerate(names)}}
        out[g] = cells | {(a, names[j]): float(products[i, j]) for i, a in enumerate(cols) for j in range(i, len(names))}
    return out


def gram(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """:func:`grams` of all rows as a table: (a, b, value)."""
    found = grams(df, cols, target).get(None, {})
    return df.sparkSession.createDataFrame([(a, b, v) for (a, b), v in found.items()], "a string, b string, value double")


def nonnegative_weights(gram_rows: list, cols: Sequence[str], target: str) -> dict[str, float]:
    """Least-squares weights >= 0 (intercept included) from the small Gram matrix, by an active set.

    The column whose weight would lower the error most joins the set, the set is solved, and
    columns that a solution pushes below zero leave it; it ends when no column outside helps.
    Not settled after many rounds: an error, never weights half way.
    """
    names = ["1", *cols]
    at = {n: i for i, n in enumerate(names)}
    g, t = np.zeros((len(names), len(names))), np.zeros(len(names))
    for a, b, v in gram_rows:
        if b == target:
            t[at[a]] = v
        else:
            g[at[a], at[b]] = g[at[b], at[a]] = v
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    g, t = g / scale[:, None] / scale[None, :], t / scale
    w, inside = np.zeros(len(names)), np.zeros(len(names), bool)
    small = 1e-11 * max(1.0, float(np.abs(t).max(initial=0.0)))
    for _ in range(30 * len(names)):
        gain = np.where(inside | (np.diag(g) <= 0), -np.inf, t - g @ w)
        j = int(gain.argmax())
        if gain[j] <= small:
            return dict(zip(names, (float(x) for x in w / scale), strict=True))
        inside[j] = True
        while inside.any():
            on = np.flatnonzero(inside)
            best = np.zeros(len(names))
            best[on] = np.linalg.lstsq(g[np.ix_(on, on)], t[on], rcond=1e-13)[0]
            low = on[best[on] <= 0]
            if not len(low):
                w = best
                break
            step = min(1.0, float((w[low] / np.maximum(w[low] - best[low], 1e-300)).min()))
            w = np.maximum(w + step * (best - w), 0.0)
            drop = low[w[low] <= 1e-14]
            inside[drop if len(drop) else low[:1]] = False
            w[~inside] = 0.0
    raise ArithmeticError("the non-negative weights did not settle")


# --- imputation --------------------------------------------------------------------------

def regressor(kind: str, label: str, features: str = "features", **params: Any) -> Estimator:
    if kind == "gbt":
        return GBTRegressor(labelCol=label, featuresCol=features, **{"maxIter": 5, "maxDepth": 4, "seed": 42, **params})
    if kind == "forest":
        return RandomForestRegressor(labelCol=label, featuresCol=features, **{"numTrees": 10, "maxDepth": 5, "seed": 42, **params})
    return LinearRegression(labelCol=label, featuresCol=features, **{"regParam": 1e-3, **params})


def target_models(base: DataFrame, targets: Sequence[str], predictors: Sequence[str], kind: str, train: Column | None = None, **params: Any) -> dict[str, Model]:
    """A regressor per target from the other predictors, on rows where the target is observed (and ``train`` holds).

    ``base`` is a written table with the targets and the vector ``_all`` of all predictors, of which each model sees
    a slice; boosters grow together, and other fits share one pool.
    """
    made = {t: regressor(kind, t, f"_v_{t}", **params) for t in targets}
    rows = {t: F.col(t).isNotNull() if train is None else F.col(t).isNotNull() & train for t in targets}
    if targets and all(grows(est, base, "_all") for est in made.values()):
        columns = {t: tuple(i for i, c in enumerate(predictors) if c != t) for t in targets}
        return dict(zip(targets, fit_boosters(base, [Boost(made[t], rows[t], columns[t], t) for t in targets], "_all"), strict=True))

    def one(t: str) -> Model:
        return made[t].fit(_without(base.filter(rows[t]), t, predictors).select(t, f"_v_{t}"))

    return dict(zip(targets, fit_all(base.sparkSession, [lambda t=t: one(t) for t in targets]), strict=True))


def _without(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    return vector_slice(df, "_all", f"_v_{target}", [i for i, c in enumerate(predictors) if c != target])


def predictor_table(df: DataFrame, targets: Sequence[str], predictors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Written table of ``keep``, the targets and the vector of all predictors."""
    return materialize(assemble(df, predictors, [*dict.fromkeys([*keep, *targets])], out="_all"), "predictors")


def model_impute(
    df: DataFrame, targets: Sequence[str], predictors: Sequence[str], key: str = "id", kind: str = "gbt", prefix: str = "imp_", **params: Any
) -> DataFrame:
    """``imp_<target>``: the observed value, or a prediction from the other columns.

    Fitted on the rows where the target is observed (train and test together; the label is
    not used).  All targets' predictions are added in one pass over a written table.
    """
    return imputed_views(df, targets, predictors, {kind: prefix}, key, **params)


def imputed_views(df: DataFrame, targets: Sequence[str], predictors: Sequence[str], kinds: dict[str, str], key: str = "id", **params: Any) -> DataFrame:
    """:func:`model_impute` by several kinds of learners side by side (kind: prefix), in one pass and without a join."""
    base = predictor_table(df, targets, predictors, [key])
    out, new = base, []
    for kind, prefix in kinds.items():
        for t, m in target_models(base, targets, predictors, kind, **params).items():
            m.setPredictionCol(f"_p_{prefix}{t}")
            out = m.transform(_without(out, t, predictors)).drop(f"_v_{t}")
            new.append(F.coalesce(F.col(t), F.col(f"_p_{prefix}{t}")).alias(f"{prefix}{t}"))
    return out.select(key, *new)
