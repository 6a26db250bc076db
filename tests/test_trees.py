"""Boosters that grow together are those that MLlib grows one by one, for the price of one scan a level."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabweave.functions import jvm_random
from tabweave.operators import model, trees, tuning
from tabweave.operators.trees import Boost, Boosters


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1_500):
        x = [float(rng.normal()), float(rng.integers(0, 6)), 0.0 if rng.random() < 0.5 else float(rng.random()), float(rng.integers(-40, 40))]
        score = x[0] + 0.4 * x[1] + 2 * x[2] + 0.02 * x[3]
        rows.append((i, int(score + rng.normal() > 1.5), None if i % 7 == 0 else float(score), i % 3, "train" if i % 10 else "test", x))
    df = spark.createDataFrame(rows, "id long, label int, target double, fold int, split string, x array<double>")
    df = df.withColumn("features", array_to_vector("x")).drop("x")
    return model.Frame(model.materialize(df.repartition(3, "id"), "boosted"), ("a", "b", "c", "d"))


def assert_same(mine, other):
    assert mine.getNumTrees == other.getNumTrees and list(mine.treeWeights) == list(other.treeWeights)
    np.testing.assert_allclose(mine.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-9)
    for a, b in zip(mine.trees, other.trees, strict=True):
        assert a.numNodes == b.numNodes and a.depth == b.depth


def test_random_numbers_are_those_of_the_jvm(spark):
    jvm = spark._jvm
    for seed in (0, 42, -7, 2024):
        one = jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        want = [one.nextDouble() for _ in range(900)]
        assert jvm_random.doubles(seed, 0, 900).tolist() == want and jvm_random.doubles(seed, 640, 60).tolist() == want[640:700]
        assert jvm_random.first_int(seed) == jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        plain, mine = jvm.scala.util.Random(seed), jvm_random.JavaRandom(seed)
        assert [mine.long() for _ in range(5)] == [plain.nextLong() for _ in range(5)]


@pytest.mark.parametrize("fraction", [0.02, 0.3, 0.7, 1.0])
def test_samples_are_those_of_the_rdd(spark, fraction):
    rdd = spark.sparkContext.parallelize(range(9_000), 3)
    got = []
    for part in range(3):
        sample = jvm_random.BernoulliSample(fraction, 99, part)
        for at in range(0, 3_000, 1_000):
            got += [part * 3_000 + at + int(i) for i in sample.take(1_000)]
    jvm = spark._jvm  # Python's own RDD.sample draws otherwise
    plain = jvm.org.apache.spark.api.java.JavaSparkContext.fromSparkContext(spark.sparkContext._jsc.sc())
    numbers = jvm.java.util.ArrayList()
    for i in range(9_000):
        numbers.add(i)
    assert got == list(plain.parallelize(numbers, 3).sample(False, fraction, 99).collect()) and rdd.count() == 9_000


@pytest.mark.parametrize("params", [
    {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}, {"maxIter": 3, "maxDepth": 4, "subsamplingRate": 0.6, "minInstancesPerNode": 15},
    {"maxIter": 3, "maxDepth": 3, "featureSubsetStrategy": "0.5", "maxBins": 12}, {"maxIter": 11, "maxDepth": 2, "stepSize": 0.5},
])
def test_boosters_are_those_of_mllib(frame, monkeypatch, params):
    monkeypatch.setattr(trees, "SMALL", 0)  # by tasks, as large tables
    monkeypatch.setattr(trees, "BLOCK", 200)
    est = model.gbt(**params)
    jobs = [Boost(est, F.col("fold") != i, (0, 1, 2, 3)) for i in (0, 1)]
    for job, mine in zip(jobs, model.fit_boosters(frame.train, jobs), strict=True):
        other = est.fit(frame.train.filter(job.rows))
        assert_same(mine, other)
        both = model.score(mine, frame.test, ["id"]).join(model.score(other, frame.test, ["id"], "other"), "id")
        assert both.filter(F.abs(F.col("score") - F.col("other")) > 1e-9).count() == 0 and both.count() == frame.test.count()


def test_regressors_and_watched_boosters_are_those_of_mllib(frame):
    est = model.regressor("gbt", "target")
    mine = model.fit_boosters(frame.data, [Boost(est, F.col("target").isNotNull(), (0, 1, 2, 3), "target")])[0]
    assert_same(mine, est.fit(frame.data.filter("target IS NOT NULL")))
    watched = model.gbt(maxIter=12, maxDepth=4, stepSize=0.9)
    got = model.kfold_oof(frame, watched, 3, early_stop=True)
    for i, m in enumerate(got.models):
        assert_same(m, model._watched(watched).fit(frame.train.withColumn("_watched", F.col("fold") == i)))


def test_variants_and_folds_share_the_scans(frame, monkeypatch):
    scans = []
    plain = Boosters._histograms
    monkeypatch.setattr(Boosters, "_histograms", lambda self, specs: scans.append(len(specs)) or plain(self, specs))
    est = model.gbt(maxIter=2, maxDepth=3)
    model.kfold_many({"whole": (frame, est), "part": (frame.sliced(["d", "a"]), est), "other": (frame, est.copy().setStepSize(0.7))}, 3)
    assert len(scans) == 2 * 3 and scans[0] == 9


def test_patience_grows_every_tree_once(frame, monkeypatch):
    grown = []
    plain = Boosters._tree
    monkeypatch.setattr(Boosters, "_tree", lambda self, jobs, last: grown.append(len(jobs)) or plain(self, jobs, last))
    est = model.gbt(maxIter=60, maxDepth=3, stepSize=0.9)
    got = model.kfold_oof(frame, est, 3, early_stop=True, patience=4)
    assert len(grown) <= max(m.getNumTrees for m in got.models) + 4 + 1
    for i, m in enumerate(got.models):
        watch = frame.train.filter(F.col("fold") == i)
        assert m.getNumTrees == model.fit_with_patience(est, frame.train.filter(F.col("fold") != i), watch, 4).getNumTrees


def test_a_search_grows_on_from_the_trees_it_has(frame, monkeypatch):
    made = []
    plain = Boosters.__init__
    monkeypatch.setattr(Boosters, "__init__", lambda self, *a, **k: made.append(1) or plain(self, *a, **k))
    family = tuning.Family(lambda rng: {"maxDepth": rng.choice([1, 2, 3])}, lambda p, n: model.gbt(maxIter=n, **p))
    found = tuning.halving_search(frame, F.col("fold") == 0, {"gbt": family}, 6, (1, 3), seed=5).collect()
    assert len(made) == 1
    fit, held = frame.train.filter("fold <> 0"), frame.train.filter("fold = 0")
    best = found[0]
    again = family.make(json.loads(best["params"]), 3).fit(fit)
    assert best["rung"] == 1 and abs(best["auc"] - model.auc_value(model.score(again, held, ["label"]), "score", "label")) < 1e-9


def test_sliced_folds_and_imputers_grow_here(frame, monkeypatch):
    sizes = []
    plain = Boosters.__init__
    monkeypatch.setattr(Boosters, "__init__", lambda self, table, jobs, *a, **k: sizes.append(len(jobs)) or plain(self, table, jobs, *a, **k))
    df = frame.data.select("id", "label", "fold", "split", "target", F.col("id").cast("double").alias("x"), F.array(*[F.lit(float(v)) * F.col("id") for v in range(3)]).alias("n"))
    model.kfold_sliced(df, ["x"], ["n"], model.gbt(maxIter=1, maxDepth=2), 3)
    assert sizes == [1, 1, 1]
    filled = model.model_impute(df, ["target", "x"], ["target", "x", "label"])
    assert sizes[3:] == [2] and filled.filter("imp_target IS NULL").count() == 0


def test_labels_that_cannot_be_learnt_are_an_error(frame):
    for job in (Boost(model.gbt(maxIter=1), F.lit(True), (0,), "target"), Boost(model.gbt(maxIter=1), F.col("fold") == 9, (0,))):
        with pytest.raises(ValueError):
            model.fit_boosters(frame.train, [job])


def test_the_matrix_of_the_main_path_is_written_once(spark, sf_dir, monkeypatch):
    from tabweave.plans import modelling

    names = []
    plain = modelling.materialize
    monkeypatch.setattr(modelling, "materialize", lambda df, name="t": names.append((name, len(df.columns))) or plain(df, name))
    modelling.main_pipeline(spark, sf_dir)
    assert max(n for _, n in names) < 20
