"""Operators against brute force in numpy and pandas, and under forced hot keys."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.functions import rowwise as rw
from tabweave.operators import encode, joins, metrics, ordering, profile, refdist, stacking
from tabweave.operators.blend import coarse_grid, fine_grid, search_blend_weight
from tabweave.operators.folds import stratified_folds


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3_000
    v = np.round(rng.gamma(2.0, 3.0, n), 1)
    v[: n // 3] = 4.0  # one value holds a third of the rows
    pdf = pd.DataFrame({"id": np.arange(n), "v": v, "x": rng.normal(size=n)})
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-(pdf.v - 5) / 3))).astype(int)
    pdf["fold"] = rng.integers(0, 5, n)
    pdf["k"] = np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 500).astype(str))
    pdf.loc[::11, "v"] = np.nan
    pdf.loc[::7, "k"] = None
    rows = [tuple(None if isinstance(c, float) and math.isnan(c) else c for c in r) for r in pdf.astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, "id long, v double, x double, y int, fold int, k string").repartition(6).cache()
    return df, pdf


def brute_auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_average_rank_matches_pandas(frame):
    df, pdf = frame
    got = ordering.cumulate(df, "v").select("v", ordering.average_rank().alias("r")).toPandas().set_index("v")["r"]
    want = pdf.v.dropna().rank().groupby(pdf.v).first()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_quantiles_match_numpy(frame):
    df, pdf = frame
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ordering.fit_quantiles(df, ["v", "x"], probs)
    for c in ("v", "x"):
        np.testing.assert_allclose(got[(c,)], np.quantile(pdf[c].dropna(), probs), rtol=0, atol=1e-12)


def test_auc_matches_rank_sum_and_mllib(frame):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df, pdf = frame
    ok = pdf.v.notna()
    want = brute_auc(pdf.y[ok].to_numpy(), pdf.v[ok].to_numpy())
    assert metrics.auc_value(df, "v", "y") == pytest.approx(want, abs=1e-12)
    exact = BinaryClassificationEvaluator(rawPredictionCol="v", labelCol="y", numBins=0)
    assert exact.evaluate(df.filter("v is not null")) == pytest.approx(want, abs=1e-9)


def test_oof_encoding_matches_refitting_each_fold(frame):
    df, pdf = frame
    enc = encode.fit_encoding(df, ["k", ("k", "fold")], "y", "fold")
    got = encode.encode_oof(df, enc, "fold", 3.0).toPandas().set_index("id").sort_index()
    prior, key, want = pdf.y.mean(), pdf.k.fillna("<null>"), np.zeros(len(pdf))
    for f in range(5):
        tr, va = pdf.fold != f, pdf.fold == f
        g = pdf[tr].groupby(key[tr]).y.agg(["count", "sum"])
        e = (g["sum"] + 3 * prior) / (g["count"] + 3)
        want[va] = key[va].map(e).fillna(prior)
    np.testing.assert_allclose(got.te_k, want, atol=1e-12)
    # The pair (k, fold) is never seen outside its own fold: prior everywhere.
    np.testing.assert_allclose(got.te_k__fold, prior, atol=1e-12)


def test_own_label_does_not_reach_own_encoding(frame):
    df, _ = frame
    flipped = df.withColumn("y", F.when(F.col("id") == 5, 1 - F.col("y")).otherwise(F.col("y")))
    values = []
    for d in (df, flipped):
        enc = encode.fit_encoding(d, ["k"], "y", "fold")
        same_prior = encode.FittedEncoding(enc.features, enc.by_fold, enc.totals, 0.5, enc.sizes)
        values.append(encode.encode_oof(d, same_prior, "fold").filter("id = 5").first()["te_k"])
    assert values[0] == values[1]


@pytest.mark.parametrize("limit,hot_parts", [(10**6, 2_000), (0, 4), (0, 2_000), (0, 1)])
def test_lookup_is_the_same_on_every_path(frame, monkeypatch, limit, hot_parts):
    df, pdf = frame
    monkeypatch.setattr(joins, "HOT_PARTS", hot_parts)
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).filter("k is null or k <> '7'").cache()
    got = joins.lookup(df, table, {"k": F.col("k")}, ["n", "s"], weight="n", broadcast_rows=limit).toPandas()
    key = pdf.k.fillna("<null>")
    want = key.map(key.value_counts()).where(key != "7")
    got = got.set_index("id").sort_index()
    assert len(got) == len(pdf)
    np.testing.assert_array_equal(got.n.fillna(-1), want.fillna(-1))


def test_ecdf_matches_searchsorted(frame):
    df, pdf = frame
    ref, rows = df.filter("id % 2 = 0"), df
    got = refdist.add_ecdf(rows, refdist.fit_ecdf(ref, ["v"], "y"), ["v"], ["v"]).toPandas().set_index("id").sort_index()
    r = pdf[pdf.id % 2 == 0].dropna(subset=["v"])
    cdf = lambda a: np.searchsorted(np.sort(a), pdf.v, side="right") / len(a)
    want, gap = cdf(r.v), cdf(r.v[r.y == 0]) - cdf(r.v[r.y == 1])
    ok = pdf.v.notna().to_numpy()
    np.testing.assert_allclose(got["v__ref_cdf"][ok], want[ok], atol=1e-12)
    np.testing.assert_allclose(got["v__ref_cdf_gap"][ok], gap[ok], atol=1e-12)
    assert got["v__ref_cdf"][~ok].isna().all()


def test_kernel_log_ratio_is_defined_far_from_the_reference(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, 6_000)
    ref = spark.createDataFrame([(float(v), int(v + rng.normal() > 0)) for v in values], "x double, y int")
    fit = refdist.fit_kernels(ref, ["x"], "y")["x"]
    far = [-1e6, -300.0, -60.0, -20.0, 20.0, 30.0, 45.0, 60.0, 100.0, 260.0, 1e6]
    got = spark.createDataFrame([(v,) for v in far], "x double").select("x", refdist.kernel_log_ratio(F.col("x"), fit).alias("r")).toPandas().set_index("x")["r"]
    assert got.notna().all() and np.isfinite(got.to_numpy(float)).all() and (got.abs() <= 20).all()


def test_kernel_sum_keeps_a_bulk_just_outside_the_radius(spark):
    rng = np.random.default_rng(4)
    bulk, other = rng.uniform(0.0, 0.2, 4_000), rng.normal(0, 1, 4_000)
    ref = [(float(v), 1) for v in bulk] + [(10.4, 1)] + [(float(v) * 8, 0) for v in other]
    fit = refdist.fit_kernels(spark.createDataFrame(ref, "x double, y int"), ["x"], "y")["x"]
    h = fit.bandwidth[1]
    z = (np.concatenate([bulk, [10.4]]) - fit.mean) / fit.std
    points = np.linspace(z[0] - 12 * h, z[-1] + 12 * h, 400)  # some see the outlier nearer, and the bulk just outside the radius
    e = -0.5 * ((points[:, None] - z[None, :]) / h) ** 2
    want = np.log(np.exp(e - e.max(axis=1)[:, None]).sum(axis=1)) + e.max(axis=1) - np.log(len(z) * h)
    np.testing.assert_allclose(refdist._log_density(points, fit, 1), want, atol=1e-8)


def test_within_row_rank_leaves_null_members_out(spark):
    df = spark.createDataFrame([(0.5, None, 0.2), (None, None, None)], "a double, b double, c double")
    got = [r["z"] for r in df.select(rw.within_row_rank_z(["a", "b", "c"], 10).alias("z")).collect()]
    assert [x["rank"] for x in got[0]] == [0.2, None, 0.1] and got[0][1]["z"] is None
    assert all(x["rank"] is None and x["z"] is None for x in got[1])


def test_regime_stack_scores_regimes_that_only_test_rows_have(spark):
    rows = [(i, float(i % 2), "train" if i % 3 else "test", i % 3, "r0", ((i * 37) % 101) / 102, ((i * 53) % 101) / 102) for i in range(90)]
    rows += [(100 + i, 0.0, "test", 0, None if i % 2 else "new", i / 12 + 0.01, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label double, split string, fold int, regime string, m_a double, m_b double")
    out = stacking.regime_stack(df, ["m_a", "m_b"], "regime", 3, 10, ["m_a"]).toPandas()
    assert len(out) == 100 and out["id"].nunique() == 100 and out["score"].between(0, 1).all()


def test_encoding_leaves_rows_without_label_out(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("a", None, 0), ("b", None, 1)], "k string, y int, fold int")
    enc = encode.fit_encoding(df, ["k"], "y", "fold")
    assert enc.prior == 0.5 and [(r["k1"], r["n"]) for r in enc.totals.collect()] == [("a", 2)]


def test_kernel_log_ratio_matches_brute_force(frame):
    df, pdf = frame
    fit = refdist.fit_kernels(df, ["x"], "y")["x"]
    got = refdist.add_kernel_log_ratio(df, {"x": fit}).toPandas().set_index("id").sort_index()["x__ref_kde_llr"]
    z = ((pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0)).to_numpy()
    logs = []
    for y in (0, 1):
        r = z[pdf.y == y]
        q75, q25 = np.percentile(r, [75, 25])
        h = min(max(0.9 * min(r.std(ddof=1), (q75 - q25) / 1.34) * len(r) ** -0.2, 0.1), 1.0)
        e = -0.5 * ((z[:, None] - r[None, :]) / h) ** 2
        m = e.max(axis=1)
        logs.append(np.log(np.exp(e - m[:, None]).sum(axis=1)) + m - np.log(len(r) * h))
    np.testing.assert_allclose(got, np.clip(logs[1] - logs[0], -20, 20), atol=1e-9)


def test_blend_search_matches_full_scan(frame):
    df, pdf = frame
    scored = df.withColumn("a", F.coalesce("v", F.lit(0.0)) + 2 * F.col("x")).withColumn("b", F.col("x") - F.coalesce("v", F.lit(0.0)) * 0.3)
    a, b = (pdf.v.fillna(0) + 2 * pdf.x).rank().to_numpy(), (pdf.x - pdf.v.fillna(0) * 0.3).rank().to_numpy()
    y = pdf.y.to_numpy()
    best = max(((brute_auc(y, w * a + (1 - w) * b), -w) for w in coarse_grid()))
    w1 = -best[1]
    fine = max(((brute_auc(y, w * a + (1 - w) * b), -w) for w in fine_grid(w1)))
    want = (-fine[1], fine[0]) if fine[0] > best[0] else (w1, best[0])
    got = search_blend_weight(scored, "a", "b", "y")
    assert got == pytest.approx(want, abs=1e-12)


def test_stratified_folds_are_balanced(frame):
    df, _ = frame
    sizes = stratified_folds(df.drop("fold"), "id", "y", 7).groupBy("y", "fold").count().toPandas()
    for _, g in sizes.groupby("y"):
        assert len(g) == 7 and g["count"].max() - g["count"].min() <= 1


def test_anti_join_drops_only_equal_rows(frame):
    df, pdf = frame
    left = df.filter("id < 600").select("id", "v", "k")
    right = df.filter("id >= 600").select("v", "k")
    got = {r["id"] for r in joins.null_safe_anti_join(left, right, ["v"], ["k"]).collect()}
    key = list(zip(pdf.v.fillna(-1), pdf.k.fillna("<null>")))
    seen = set(key[600:])
    assert got == {i for i in range(600) if key[i] not in seen}


def test_steps_cover_bucket_borders(frame):
    df, pdf = frame
    got = profile.steps(df, ["x"]).orderBy("value").toPandas()
    want = np.diff(np.sort(pdf.x.unique()))
    np.testing.assert_allclose(got.step, want, atol=1e-12)


def test_nested_encodings_equal_refitting_without_both_folds(spark):
    rng = np.random.default_rng(8)
    n, k, inner = 900, 3, 4
    pdf = pd.DataFrame({"id": np.arange(n), "k": rng.integers(0, 40, n).astype(str), "v": rng.integers(0, 5, n).astype(float), "y": rng.integers(0, 2, n), "e": rng.integers(0, inner, n), "o": rng.integers(0, k, n)})
    pdf.loc[::13, "k"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "id long, k string, v double, y int, e int, o int").repartition(4).cache()
    features = ["k", ("k", "v")]
    enc = encode.fit_nested(df, features, "y", "e", "o", k)
    got = encode.encode_nested(df, enc, "e", "o").toPandas().set_index("id").sort_index()
    test = encode.encode_nested_full(df.drop("y", "e", "o"), enc).toPandas().set_index("id").sort_index()
    for name, cols in (("te_k", ["k"]), ("te_k__v", ["k", "v"])):
        key = pdf[cols].astype(str).apply(tuple, axis=1)
        for v in range(k):
            prior = pdf.y[pdf.o != v].mean()

            def fit(rows):
                g = pdf[rows].y.groupby(key[rows]).agg(["count", "sum"])
                return key.map((g["sum"] + 3 * prior) / (g["count"] + 3)).fillna(prior).to_numpy(float)

            whole = fit(pdf.o != v)
            want = whole.copy()
            for e in range(inner):
                mine = ((pdf.e == e) & (pdf.o != v)).to_numpy()
                want[mine] = fit((pdf.o != v) & (pdf.e != e))[mine]
            np.testing.assert_allclose(np.stack(got[name])[:, v], want, atol=1e-12)
            np.testing.assert_allclose(np.stack(test[name])[:, v], whole, atol=1e-12)


def test_labels_of_a_left_out_fold_do_not_reach_its_model(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 300)), int(rng.integers(0, 2)), int(rng.integers(0, 10)), int(rng.integers(0, 3))) for i in range(2_400)]
    df = spark.createDataFrame(rows, "id long, k int, y int, e int, o int").cache()
    flipped = df.withColumn("y", F.when(F.col("o") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    value = [
        {r["id"]: r["x"] for r in encode.encode_nested(d, encode.fit_nested(d, ["k"], "y", "e", "o", 3), "e", "o").select("id", F.col("te_k")[1].alias("x")).collect()}
        for d in (df, flipped)
    ]
    assert value[0] == value[1]  # the model that leaves fold 1 out sees the same features whatever fold 1's labels are


def test_heavy_tails_leave_few_kernel_cells(spark):
    """By Chebyshev at most n / K^2 values lie beyond K deviations, so cells number about 80 K + n / K^2: 120 (n / 40)^(1/3)."""
    n = 1_000_000
    ref = spark.range(n).select((F.pow(1 - (F.col("id") + 0.5) / n, F.lit(-1 / 1.2)) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    fit = refdist.fit_kernels(ref, ["x"], "y")["x"]
    assert ref.select("x").distinct().count() > 900_000
    assert sum(len(c[0]) for c in fit.cells) < 10_000
    got = [r[0] for r in spark.createDataFrame([(1.5,), (-40.0,), (9e4,), (1e7,)], "x double").select(refdist.kernel_log_ratio(F.col("x"), fit)).collect()]
    assert all(np.isfinite(v) for v in got) and abs(got[0] - got[1]) < 20
