"""Broken-off runs and parameter documents."""

import pytest
from pyspark.sql import functions as F

from tabweave.operators.model import gbt, logistic
from tabweave.operators.runner import finished, run_variants
from tabweave.session import new_path
from tabweave.sources.params import configured, documented, typed_params


def test_a_broken_run_is_taken_up_where_it_ended(spark):
    folder, calls = new_path(spark, "runs"), []
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("label"), (F.col("id") % 7).cast("double").alias("score"))

    def build(params):
        calls.append(params["shift"])
        if params["shift"] == 3 and calls.count(3) == 1:
            raise RuntimeError("lost")
        return rows.withColumn("score", F.col("score") + params["shift"])

    variants = {f"v{i}": ({"shift": i}, build) for i in range(1, 5)}
    with pytest.raises(RuntimeError):
        run_variants(spark, folder, variants)
    assert {r["variant"] for r in finished(spark, folder).collect()} == {"v1", "v2"}
    done = {r["variant"]: r for r in run_variants(spark, folder, variants).collect()}
    assert calls == [1, 2, 3, 3, 4] and set(done) == set(variants)
    assert len({r["auc"] for r in done.values()}) == 1 and {r["n_rows"] for r in done.values()} == {60}
    assert spark.read.parquet(done["v4"]["scores"]).agg(F.min("score")).first()[0] == 4.0
    run_variants(spark, folder, variants | {"v2": ({"shift": 9}, build)}, again=("v1",))  # other parameters, and asked for
    assert calls[5:] == [1, 9]
    assert finished(spark, folder).count() == 4


def test_an_empty_journal(spark):
    assert finished(spark, new_path(spark, "none")).count() == 0 and run_variants(spark, new_path(spark, "none"), {}).count() == 0


def test_parameters_are_typed(spark):
    est = configured(gbt(), {"maxIter": 7, "stepSize": 0.5, "featureSubsetStrategy": "0.5", "cacheNodeIds": True})
    assert est.getMaxIter() == 7 and est.getCacheNodeIds() is True and gbt().getMaxIter() != 7
    assert documented(est)["stepSize"] == "0.5" and documented(est)["labelCol"] == "label"
    assert configured(logistic(10), {"elasticNetParam": 1}).getElasticNetParam() == 1.0
    for bad in ({"maxIter": "7"}, {"maxIter": 7.5}, {"rounds": 7}, {"cacheNodeIds": 1}, {"stepSize": "fast", "depth": 1}):
        with pytest.raises(ValueError, match="refused") as e:
            typed_params(gbt(), bad)
        assert all(k in str(e.value) for k in bad)
    with pytest.raises(ValueError, match="refused"):
        configured(gbt(), {"maxDepth": 99})  # its type is right, its range is not
