"""Reference search, one join for many features, and co-moments: against numpy, on every path, and by their plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.operators import comoments, encode, joins, metrics, model, refdist, search
from tabweave.operators.blend import rank_columns
from tabweave.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 2_500
    pdf = pd.DataFrame({f"c{i}": np.round(rng.gamma(2.0, 2.0 + i, n), 1) for i in range(6)})
    pdf["c0"] = np.where(np.arange(n) % 3 == 0, 4.0, pdf.c0)  # one value holds a third of the rows
    pdf["y"] = (rng.random(n) < 0.4).astype(int)
    pdf["fold"] = rng.integers(0, 4, n)
    pdf["s"] = np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 300).astype(str))
    for i in range(6):
        pdf.loc[i :: 9 + i, f"c{i}"] = np.nan
    rows = [(i, *[None if isinstance(v, float) and np.isnan(v) else v for v in r], "x") for i, r in enumerate(pdf.astype(object).itertuples(index=False))]
    cols = ", ".join(f"c{i} double" for i in range(6))
    df = spark.createDataFrame(rows, f"id long, {cols}, y int, fold int, s string, _spot string").repartition(5).cache()
    return df, pdf


@pytest.mark.parametrize("limit", [10**6, 0])
def test_running_sums_equal_searchsorted_on_both_paths(frame, monkeypatch, limit):
    df, pdf = frame
    monkeypatch.setattr(search, "SEARCH_ROWS", limit)
    cols = ["c0", "c3", "c5"]
    fitted = search.reference_sums(df.filter("id % 4 = 0"), cols, {"n": F.lit(1), "pos": F.col("y")})
    got = search.add_running_sums(df, fitted, {c: {"n": f"n_{c}", "pos": f"pos_{c}"} for c in cols})
    assert got.columns[: len(df.columns)] == df.columns
    got = got.toPandas().set_index("id").sort_index()
    ref = pdf[np.arange(len(pdf)) % 4 == 0]
    for c in cols:
        ok = pdf[c].notna().to_numpy()
        for name, mine in (("n", ref), ("pos", ref[ref.y == 1])):
            want = np.searchsorted(np.sort(mine[c].dropna()), pdf[c][ok], side="right")
            np.testing.assert_array_equal(got[f"{name}_{c}"][ok], want)
            assert got[f"{name}_{c}"][~ok].isna().all()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_odd_references_and_values(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "SEARCH_ROWS", limit)
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, -0.0), (5, float("inf")), (6, -1e300)], "id long, v double")
    ref = spark.createDataFrame([(0.0, 1), (-0.0, 0), (2.0, 1), (2.0, None), (None, 1), (float("nan"), 1)], "v double, y int")
    fitted = refdist.fit_ecdf(ref, ["v"], "y")
    got = {r["id"]: (r["v__ref_cdf"], r["v__ref_cdf_gap"]) for r in refdist.add_ecdf(rows, fitted, ["v"], ["v"]).collect()}
    assert got[1] == (1.0, 0.0) and got[2] == got[3] == (None, None) and got[4] == (2 / 3, 0.5) and got[5] == (1.0, 0.0) and got[6] == (0.0, 0.0)
    none = refdist.fit_ecdf(ref.limit(0), ["v"], "y")
    assert {r["v__ref_cdf"] for r in refdist.add_ecdf(rows, none, ["v"]).collect()} == {None}


@pytest.mark.parametrize("name", ["a17_reference_cdf", "a18_class_cdf_gap", "j3_reference_position"])
def test_a_small_reference_is_searched_without_moving_the_rows(spark, sf_dir, name):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["a17_reference_cdf", "a2_oof_target_encoding", "a5_pair_encoding", "p25_value_index", "b1_rank_average"])
def test_queries_give_the_same_rows_when_no_table_may_be_broadcast(spark, sf_dir, monkeypatch, name):
    def run():
        df = registry.QUERIES[name](spark, sf_dir)
        return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)

    small = run()
    monkeypatch.setattr(search, "SEARCH_ROWS", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert run() == small


def test_exchanges_do_not_grow_with_the_features(frame, monkeypatch):
    df, pdf = frame
    cols = [f"c{i}" for i in range(6)]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)

    def exchanges(make, few, many):
        return [plan_of(make(x)).count("Exchange hashpartitioning") for x in (few, many)]

    enc = {n: encode.fit_encoding(df, cols[:n], "y", "fold") for n in (2, 6)}
    for make in (lambda n: encode.encode_oof(df, enc[n], "fold"), lambda n: encode.encode_full(df, enc[n]), lambda n: encode.frequency_encode(df, cols[:n]), lambda n: rank_columns(df, cols[:n]), lambda n: encode.value_index(df, cols[:n])):
        few, many = exchanges(make, 2, 6)
        assert 0 < few == many <= 6


@pytest.mark.parametrize("limit", [10**6, 400, 0])
def test_many_features_come_from_broadcasts_or_one_join(frame, monkeypatch, limit):
    df, pdf = frame
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)  # 400: some features fit, others do not
    features = ["c0", "c1", "s", ("c2", "s")]
    got = encode.frequency_encode(df, features).toPandas().set_index("id").sort_index()
    for f in features:
        key = pdf[list(f) if isinstance(f, tuple) else [f]].astype(str).apply(tuple, axis=1)
        np.testing.assert_array_equal(got[f"freq_{encode.feature_name(encode.as_feature(f))}"], key.map(key.value_counts()))
    with_id = encode.frequency_encode(df, ["c0", "s"]).select("id", "freq_c0", "freq_s")
    without = encode.frequency_encode(df.withColumnRenamed("id", "other"), ["c0", "s"]).select("other", "freq_c0", "freq_s")
    assert sorted(map(tuple, with_id.collect())) == sorted(map(tuple, without.collect()))


def test_co_moments_of_eighty_members(spark):
    rng = np.random.default_rng(2)
    n, p = 4_000, 80
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) * 0.1 + 1e6  # a large offset
    x[rng.random((n, p)) < 0.1] = np.nan
    fold = rng.integers(0, 5, n)
    names = [f"m{i}" for i in range(p)]
    pdf = pd.DataFrame(x, columns=names).assign(fold=fold)
    df = spark.createDataFrame(pdf).repartition(7).cache()  # NaN stays NaN: unknown
    got = comoments.comoments(df, names, "fold")
    assert set(got) == set(range(5))
    for f in range(5):
        want = pdf[pdf.fold == f][names]
        np.testing.assert_array_equal(got[f].n, want.notna().astype(float).T @ want.notna().astype(float))
        np.testing.assert_allclose(got[f].correlations(), want.corr(min_periods=2), atol=1e-9)
    whole = got[0] + got[1] + got[2] + got[3] + got[4]
    np.testing.assert_allclose(whole.correlations(), pdf[names].corr(), atol=1e-9)
    corr, pairs = pdf[names].corr(), metrics.pearson_pairs(df, names).toPandas()
    assert len(pairs) == p * (p - 1) // 2
    np.testing.assert_allclose(pairs.r, [corr.loc[a, b] for a, b in zip(pairs.a, pairs.b)], atol=1e-9)


def test_gram_matrices_of_all_folds_come_from_complete_rows(frame):
    df, pdf = frame
    cols = ["c0", "c1", "c2"]
    got = model.grams(df, cols, "y", "fold")
    for f, g in got.items():
        x = pdf[pdf.fold == f][[*cols, "y"]].dropna().astype(float).assign(**{"1": 1.0})
        for (a, b), v in g.items():
            assert v == pytest.approx(float((x[a] * x[b]).sum()), rel=1e-10)


def test_undefined_correlations_are_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, 5.0), (3.0, 2.0, None)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in metrics.pearson_pairs(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): None, ("b", "c"): None}
    assert metrics.pearson_pairs(df.limit(0), ["a", "b"]).first()["r"] is None


def _scored(spark, rows):
    return spark.createDataFrame(rows, "y int, a double, b double").repartition(4).cache()


@pytest.mark.parametrize("kind", ["noise", "equal", "coarse", "one_sided"])
@pytest.mark.parametrize("limits", [(4_096, 64, 4, 4_000_000), (4, 4, 1, 100)])
def test_branch_and_bound_finds_the_exact_best_weight(spark, monkeypatch, kind, limits):
    from tabweave.operators import blend

    rng = np.random.default_rng(len(kind))
    y = (rng.random(900) < 0.3).astype(int)
    a = rng.random(900) * 0.7 + 0.3 * y
    b = {"noise": rng.random(900) * 0.8 + 0.2 * y, "equal": a, "coarse": np.floor(a * 6) / 6, "one_sided": rng.random(900)}[kind]
    df = _scored(spark, [(int(i), float(u), float(v)) for i, u, v in zip(y, a, b)] + [(None, 0.5, 0.5), (1, None, 0.1)])
    for name, value in zip(("FIRST_BINS", "SPLIT", "DEPTH", "CELLS"), limits):
        monkeypatch.setattr(blend, name, value)
    weights = [0.0, 0.2, 0.4, 0.5, 0.9]
    want = blend.auc_per_weight(df.dropna(), "a", "b", "y", weights).orderBy(F.desc("auc"), "w").first()
    got = blend.best_weight(df, "a", "b", "y", weights, F.lit(1.0))
    assert got == (want["w"], pytest.approx(want["auc"], abs=1e-12))


def test_a_flat_maximum_orders_no_rows(spark, monkeypatch):
    from tabweave.operators import blend

    rng = np.random.default_rng(1)
    a = rng.random(4_000)
    df = _scored(spark, [(int(v > rng.random()), float(v), float(v)) for v in a])
    monkeypatch.setattr(blend, "_ordered_pairs", None)  # would fail if called
    w, auc = blend.best_weight(df, "a", "b", "y", [0.0, 0.25, 0.5, 0.75, 1.0], F.lit(1.0))
    assert w == 0.0 and auc == pytest.approx(metrics.auc_value(df, "a", "y"), abs=1e-12)


def test_weight_search_without_both_classes(spark):
    from tabweave.operators import blend

    assert blend.best_weight(_scored(spark, [(1, 0.1, 0.2), (1, 0.3, 0.4)]), "a", "b", "y", [0.5, 0.2], F.lit(1.0)) == (0.2, None)
