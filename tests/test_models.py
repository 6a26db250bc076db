"""Invariants of the trained parts: every row scored once, by models that did not see it."""

import pytest
from pyspark.sql import functions as F

from tabweave.operators import certificates, encode, model
from tabweave.operators.metrics import auc_value
from tabweave.plans import registry
from tabweave.plans.modelling import K, RAW, TREE, feature_table
from tabweave.session import new_path
from tabweave.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def frame(spark, sf_dir):
    return model.model_frame(feature_table(spark, sf_dir), RAW)


def test_every_row_is_scored_once(frame):
    res = model.kfold_oof(frame, model.gbt(**TREE), K)
    assert res.oof.count() == res.oof.select("id").distinct().count() == frame.train.count()
    assert res.test.count() == frame.test.count()
    assert res.oof.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    assert auc_value(res.oof, "score", "label") > 0.9  # the label is a rule over the features


def test_out_of_fold_scores_come_from_the_other_folds(frame):
    res = model.kfold_oof(frame, lambda n: model.logistic(n), K)
    again = model.logistic(frame.train.count() * (K - 1) // K).fit(frame.train.filter(F.col("fold") != 1))
    want = model.score(again, frame.train.filter(F.col("fold") == 1), ["id"]).withColumnRenamed("score", "want")
    worst = res.oof.filter(F.col("fold") == 1).join(want, "id").agg(F.max(F.abs(F.col("score") - F.col("want")))).first()[0]
    assert worst < 1e-6


def test_nonnegative_weights_solve_the_constrained_fit():
    cols = ["a", "b", "c"]
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(500), rng.random((500, 3))])
    y = x @ [0.1, 0.5, 0.0, 0.7] - 0.3 * x[:, 2] + 0.01 * rng.normal(size=500)
    names = ["1", *cols]
    rows = [(names[i], names[j], float(x[:, i] @ x[:, j])) for i in range(4) for j in range(i, 4)]
    rows += [(n, "y", float(x[:, i] @ y)) for i, n in enumerate(names)]
    w = np.array(list(model.nonnegative_weights(rows, cols, "y").values()))
    grad = x.T @ (x @ w - y)
    assert (w >= 0).all() and w[2] == 0.0
    assert np.allclose(grad[w > 0], 0, atol=1e-5) and (grad[w == 0] >= -1e-5).all()


@pytest.mark.parametrize("name", ["m4_logistic_meta", "m6_nonnegative_blend", "m8_model_imputation", "m22_band_correction", "o2_feature_importance", "s8_params_scan"])
def test_rows_only_queries_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_fitted_encoding_scores_a_stream(spark, sf_dir):
    df = feature_table(spark, sf_dir).select("id", "prio", "lines", "label", "fold", "split")
    enc = encode.fit_encoding(df.filter("split = 'train'"), ["prio", "lines"], "label", "fold")
    source, sink = new_path(spark, "source"), new_path(spark, "sink")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = score_stream(stream, lambda s: encode.encode_full(s, enc), sink, new_path(spark, "offsets"))
    q.awaitTermination()
    got = spark.read.parquet(sink)
    want = encode.encode_full(df, enc)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()


def test_nonnegative_weights_solve_collinear_columns():
    import numpy as np

    from tabweave.operators.model import nonnegative_weights

    rng = np.random.default_rng(1)
    base = rng.random(500)
    x = np.column_stack([np.ones(500), *[base + rng.normal(0, 1e-3, 500) for _ in range(6)], rng.random(500)])
    y = 0.2 + 0.5 * x[:, 2] + 0.3 * x[:, 7] + rng.normal(0, 0.05, 500)
    names = ["1", *[f"c{i}" for i in range(7)]]
    g = x.T @ x
    rows = [(names[i], names[j], g[i, j]) for i in range(8) for j in range(i, 8)] + [(names[i], "y", float(x[:, i] @ y)) for i in range(8)]
    w = nonnegative_weights(rows, names[1:], "y")
    v = np.array([w[n] for n in names])
    slope = x.T @ (x @ v - y)
    assert (v >= 0).all() and (slope > -1e-6).all() and (np.abs(slope[v > 0]) < 1e-6).all()


def test_gram_leaves_incomplete_rows_out(spark):
    from tabweave.operators.model import gram

    df = spark.createDataFrame([(1.0, 2.0, 1.0), (None, 3.0, 1.0), (2.0, None, 0.0), (3.0, 1.0, 0.0)], "a double, b double, y double")
    got = {(r["a"], r["b"]): r["value"] for r in gram(df, ["a", "b"], "y").collect()}
    assert got["1", "1"] == 2 and got["a", "b"] == 5 and got["b", "b"] == 5 and got["a", "y"] == 1


def test_main_pipeline_scores_every_current_row_once(spark, sf_dir):
    import numpy as np

    from tabweave.plans.frames import current, order_frame
    from tabweave.plans.registry import QUERIES

    got = QUERIES["l1_pipeline"](spark, sf_dir).toPandas()
    want = current(order_frame(spark, sf_dir)).select("id", "split", "label").toPandas()
    assert sorted(got.id) == sorted(want.id)
    assert got[["gbt_deep", "gbt_wide", "gbt_plain", "second", "boost", "score"]].notna().all().all() and got.weight.nunique() == 1
    train = got[got.split == "train"]
    assert train.fold.notna().all() and train.groupby("fold").size().pipe(lambda n: n.max() - n.min()) <= len(train)
    for _, part in got.groupby("split"):  # blends recomputed from the written member scores
        boost = sum(part[m].rank() for m in ("gbt_deep", "gbt_wide", "gbt_plain")) / 3 / len(part)
        np.testing.assert_allclose(part.boost, boost, atol=1e-9)
        w = part.weight.iloc[0]
        mix = w * part.boost.rank() + (1 - w) * part.second.rank()
        np.testing.assert_allclose(part.score, mix / mix.max(), atol=1e-9)
    m = train.merge(want[["id", "label"]], on="id")
    rank, n1 = m.score.rank(), int(m.label.sum())
    assert (rank[m.label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(m) - n1)) > 0.8


def test_every_continuous_column_is_imputed(spark, sf_dir):
    from tabweave.plans.frames import CONT
    from tabweave.plans.registry import QUERIES

    got = QUERIES["m8_model_imputation"](spark, sf_dir)
    assert set(got.columns) == {"id", *[f"imp_{c}" for c in CONT]}
    assert got.dropna().count() == got.count() > 0
    assert {r["feature"] for r in QUERIES["m10_imputability"](spark, sf_dir).collect()} == set(CONT)


def test_a_slice_of_a_frame_gives_the_models_of_its_columns(spark, frame):
    cols = RAW[2:7]
    own = model.Frame(frame.data.select("id", "label", "fold", "split", F.col("features")), frame.columns).sliced(cols)
    both = model.kfold_many({"sliced": (own, model.gbt(**TREE)), "linear": (own, lambda n: model.logistic(n)), "whole": (frame, model.gbt(**TREE))}, K)
    assert both["sliced"].models[0].numFeatures == len(cols) and both["whole"].models[0].numFeatures == len(RAW)
    again = model.kfold_oof(frame.sliced(cols), model.gbt(**TREE), K)
    gap = both["sliced"].oof.join(again.oof.withColumnRenamed("score", "again"), "id").agg(F.count(F.lit(1)), F.max(F.abs(F.col("score") - F.col("again")))).first()
    assert gap[0] == frame.train.count() and gap[1] == 0


def test_a_prefix_of_a_booster_is_the_booster_of_fewer_rounds(frame):
    assert model.best_prefix([5, 4, 3, 3, 4, 2], 2) == (3, True) and model.best_prefix([5, 4, 3, 3, 4, 2], 3) == (6, False) and model.best_prefix([1.0], 1) == (1, False)
    train, watch = frame.train.filter("fold <> 0"), frame.train.filter("fold = 0")
    est = model.gbt(maxIter=12, maxDepth=3, stepSize=0.3)
    cut, few = model.prefix_model(est.fit(train), 5), est.copy().setMaxIter(5).fit(train)
    assert cut.getNumTrees == 5 and cut.getMaxDepth() == 3
    both = model.score(cut, watch, ["id"]).join(model.score(few, watch, ["id"], "few"), "id")
    assert both.filter(F.abs(F.col("score") - F.col("few")) > 1e-12).count() == 0 and both.count() == watch.count()


def test_patience_cuts_hundreds_of_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, float(x := rng.normal()), float(rng.normal()), int(x + rng.normal() > 0), i % 2, "train") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int, fold int, split string")
    frame = model.model_frame(df, ["a", "b"])
    est = model.gbt(maxIter=400, maxDepth=3, stepSize=0.5)
    train, watch = frame.train.filter("fold = 0"), frame.train.filter("fold = 1")
    fitted = model.fit_with_patience(est, train, watch, patience=5)
    losses = est.copy().setMaxIter(fitted.getNumTrees + 5).fit(train).evaluateEachIteration(watch)
    assert fitted.getNumTrees < 60 and int(np.argmin(losses)) + 1 == fitted.getNumTrees


def test_nested_encodings_of_a_random_label_tell_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    n = 4_000
    rows = [(i, int(rng.integers(0, 1_300)), int(rng.integers(0, 2)), int(rng.integers(0, 2)), int(rng.integers(0, 3)), "train") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k int, label int, inner int, fold int, split string").cache()
    enc = encode.fit_nested(df, ["k"], "label", "inner", "fold", 3, m=0.5)
    nested = model.kfold_sliced(encode.encode_nested(df, enc, "inner", "fold"), [], ["te_k"], lambda m: model.logistic(m), 3)
    assert abs(auc_value(nested.oof, "score", "label") - 0.5) < 0.04
    assert nested.oof.count() == n and nested.oof.select("id").distinct().count() == n


def test_proofs_tell_a_fitted_model_from_another(frame):
    fit, other = frame.train.filter("fold <> 0"), frame.train.filter("fold = 0")
    n = fit.count()
    good, poor = model.logistic(n, max_iter=100, tol=1e-8).fit(fit), model.logistic(n, max_iter=1).fit(fit)
    assert certificates.linear_residual(good, fit) <= certificates.GRADIENT < certificates.linear_residual(poor, fit)
    assert certificates.linear_residual(model.logistic(n, 2.0, 1.0, 200, 1e-9).fit(fit), fit) <= certificates.GRADIENT
    booster = model.gbt(**TREE).fit(fit)
    assert certificates.booster_residual(booster, fit) <= certificates.EXACT < certificates.booster_residual(booster, other)
    for m in (booster, model.gbt(**TREE, subsamplingRate=0.5).fit(fit), model.forest(5, 3).fit(fit)):
        assert certificates.ensemble_residual(m, other) <= certificates.EXACT
    assert certificates.network_residual(model.perceptron(len(RAW), (5, 3), 3).fit(fit), other) <= certificates.EXACT


def test_search_drops_bad_draws_early(frame):
    from tabweave.operators.tuning import Family, halving_search

    made = []

    def make(p, rounds):
        made.append((p["maxDepth"], rounds))
        return model.gbt(maxIter=rounds, **p)

    found = halving_search(frame, F.col("fold") == 0, {"gbt": Family(lambda rng: {"maxDepth": rng.choice([1, 2, 3])}, make)}, 5, (1, 2), seed=3).collect()
    assert [sum(r["rung"] == i for r in found) for i in (0, 1)] == [5, 2] and len(made) == 7
    first = sorted((r["auc"] for r in found if r["rung"] == 0), reverse=True)
    assert sorted((r["auc"] for r in found if r["rung"] == 0 and r["kept"]), reverse=True) == first[:2]
    assert {r["n_held"] for r in found} == {frame.train.filter("fold = 0").count()} and found[0]["kept"]
