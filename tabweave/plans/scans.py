"""Sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tabweave.operators.metrics import auc
from tabweave.operators.model import gbt, model_frame
from tabweave.operators.ordering import fit_medians
from tabweave.operators.runner import run_variants
from tabweave.plans.catalog import query, r, rounded
from tabweave.plans.frames import CATS, CONT, FRAME_SQL, MEMBERS, MEMBERS_SQL, member_frame, member_long, order_frame
from tabweave.session import new_path
from tabweave.sources import tables as io
from tabweave.sources.params import configured, documented

RAW_SCHEMA = StructType(
    [StructField("id", LongType())]
    + [StructField(c, DoubleType()) for c in CONT]
    + [StructField(c, StringType()) for c in CATS]
)


@query("s1_csv_scan", f"""WITH {FRAME_SQL}
SELECT id, {', '.join(r(c, c) for c in CONT)}, {', '.join(CATS)} FROM frame""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    order_frame(spark, sf_dir).select("id", *CONT, *CATS).write.option("header", True).csv(path)
    return rounded(io.read_csv(spark, path, RAW_SCHEMA))


@query("s2_split_scan", f"""WITH {FRAME_SQL} SELECT id, status FROM frame WHERE split = 'train'""")
def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "split")
    order_frame(spark, sf_dir).select("id", "status", "label", "split").write.parquet(path)
    return io.read_split(spark, path, True, ["id", "status"])


@query("s3_member_library", f"""WITH {MEMBERS_SQL}
SELECT id, {', '.join(r(m, m) for m in ('m_a', 'm_c', 'm_d'))} FROM members WHERE split = 'train'""")
def member_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "library")
    io.write_members(member_long(spark, sf_dir), path)
    return rounded(io.read_members(spark, path, "train", ["m_a", "m_c", "m_d"]))


@query("s4_member_csv_groups", f"""WITH {MEMBERS_SQL}
SELECT id, 'grp_first_m_a' AS member, {r('m_a', 'score')} FROM members
UNION ALL SELECT id, 'grp_first_m_b', {r('m_b', 'score')} FROM members
UNION ALL SELECT id, 'grp_second_m_a', {r('m_c', 'score')} FROM members
UNION ALL SELECT id, 'grp_second_m_b', {r('m_d', 'score')} FROM members""")
def member_csv_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "groups")
    wide = member_frame(spark, sf_dir)
    wide.select("id", "m_a", "m_b").write.option("header", True).csv(f"{base}/first")
    wide.select("id", F.col("m_c").alias("m_a"), F.col("m_d").alias("m_b")).write.option("header", True).csv(f"{base}/second")
    schema = StructType([StructField("id", LongType()), StructField("m_a", DoubleType()), StructField("m_b", DoubleType())])
    return rounded(io.read_member_csvs(spark, [f"{base}/first", f"{base}/second"], schema, "grp", ["m_a", "m_b"]))


@query("s5_scored_sink", f"""WITH {MEMBERS_SQL},
c AS (SELECT id, least(greatest(m_a, 1e-6), 1 - 1e-6) AS s FROM members WHERE split = 'test')
SELECT id, {r('s / (SELECT max(s) FROM c)', 'score')} FROM c""")
def scored_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scored")
    test = member_frame(spark, sf_dir).filter(F.col("split") == "test").select("id", F.col("m_a").alias("score"))
    io.write_scored(io.scored_table(test), path)
    schema = StructType([StructField("id", LongType()), StructField("score", DoubleType())])
    return rounded(io.read_csv(spark, path, schema))


_AUC = """SELECT '{m}' AS variant, {wave} + {bonus} AS run, (SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)
  / (sum(y) * sum(1 - y)) FROM (SELECT y, rank() OVER (ORDER BY {expr}) + (count(*) OVER (PARTITION BY {expr}) - 1) / 2.0 AS rk
  FROM members)) AS auc"""


@query("s6_metrics_sink", f"""WITH {MEMBERS_SQL},
runs AS ({_AUC.format(m='m_a', wave=1, bonus=0, expr='m_a')} UNION ALL {_AUC.format(m='m_b', wave=1, bonus=1, expr='m_b')}
  UNION ALL {_AUC.format(m='m_a', wave=10, bonus=0, expr='m_a + m_b')})
SELECT variant, run::BIGINT AS written_at, {r('auc', 'auc', 9)} FROM runs
QUALIFY row_number() OVER (PARTITION BY variant ORDER BY run DESC) = 1""")
def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "metrics")
    wide = member_frame(spark, sf_dir)
    runs = [("m_a", 1, F.col("m_a")), ("m_b", 2, F.col("m_b")), ("m_a", 10, F.col("m_a") + F.col("m_b"))]
    for variant, at, expr in runs:
        one = auc(wide.select(expr.alias("score"), "y"), "score", "y")
        io.append_metrics(one.select(F.lit(variant).alias("variant"), "auc", F.lit(at).cast("bigint").alias("written_at")), path)
    return rounded(io.latest_metrics(spark.read.parquet(path)), 9)


_VARIANTS = {"first": "m_a", "second": "m_b", "even": "(m_a + m_b) / 2", "third": "(m_a + m_b + m_c) / 3"}


@query("s6_resumed_run", f"""WITH {MEMBERS_SQL}, runs AS ({' UNION ALL '.join(_AUC.format(m=n, wave=0, bonus=0, expr=e) for n, e in _VARIANTS.items())})
SELECT variant, (SELECT count(*) FROM members)::BIGINT AS n_rows, 1::BIGINT AS n_built, {r('auc', 'auc', 9)} FROM runs""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four variants scored in a run that breaks off after two and is taken up again: each is built once."""
    folder, wide, built = new_path(spark, "runs"), member_frame(spark, sf_dir), []

    def build(params: dict) -> DataFrame:
        if len(built) == 2 and not broken:
            broken.append(True)
            raise KeyboardInterrupt
        built.append(params["expr"])
        return wide.select("id", F.col("y").alias("label"), F.expr(params["expr"]).alias("score"))

    broken: list[bool] = []
    variants = {n: ({"expr": e}, build) for n, e in _VARIANTS.items()}
    try:
        run_variants(spark, folder, variants)
    except KeyboardInterrupt:
        pass
    done = run_variants(spark, folder, variants)
    counts = spark.createDataFrame([(n, built.count(e)) for n, e in _VARIANTS.items()], "variant string, n_built bigint")
    return rounded(done.join(counts, "variant").select("variant", "n_rows", "n_built", "auc"), 9)


@query("s7_feature_cache", f"""WITH {FRAME_SQL}
SELECT id, {r('coalesce(total_k, (SELECT median(total_k) FROM frame))', 'total_filled')} FROM frame""")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "cache")

    def build() -> DataFrame:
        frame = order_frame(spark, sf_dir)
        median = fit_medians(frame, ["total_k"])["total_k"]
        return frame.select("id", F.coalesce("total_k", F.lit(median)).alias("total_filled"))

    io.cached_artefact(spark, path, build)
    return rounded(io.cached_artefact(spark, path, build))  # the second call only scans


@query("s8_params_scan", f"""WITH {MEMBERS_SQL}
SELECT 5::INT AS max_iter, count(*) FILTER (m_a >= (SELECT round(avg(m_a), 6) FROM members))::BIGINT AS n_over FROM members""")
def params_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuned parameters written as JSON, read back and applied: rows per member count kept by them."""
    path = new_path(spark, "params")
    member_frame(spark, sf_dir).agg(
        F.to_json(F.struct(F.lit(5).alias("maxIter"), F.round(F.avg("m_a"), 6).alias("threshold"))).alias("value")
    ).coalesce(1).write.text(path)
    params = io.read_params(spark, path)
    return member_frame(spark, sf_dir).agg(
        F.lit(params["maxIter"]).alias("max_iter"), F.count_if(F.col("m_a") >= params["threshold"]).alias("n_over")
    )


_BOOSTER = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.25, "seed": 7}


@query("s8_typed_params", f"""WITH {MEMBERS_SQL}, n AS (SELECT count(*) FILTER (split = 'train')::BIGINT AS n_fit, count(*) FILTER (split = 'test')::BIGINT AS n_scored FROM members)
SELECT param, value, 3::BIGINT AS n_trees, n_fit, n_scored, 2::BIGINT AS n_refused
FROM n, (VALUES ('maxIter', '3'), ('maxDepth', '2'), ('stepSize', '0.25'), ('seed', '7')) p(param, value)""")
def typed_params_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter document read, checked against the booster's parameters, fitted, and read off the fitted model; bad documents are refused."""
    path = new_path(spark, "params")
    spark.createDataFrame([(json.dumps(_BOOSTER),)], "value string").coalesce(1).write.text(path)
    booster = configured(gbt(), io.read_params(spark, path))
    refused = 0
    for bad in ({"maxDepth": "two"}, {"depth": 2}):
        try:
            configured(gbt(), bad)
        except ValueError:
            refused += 1
    frame = model_frame(member_frame(spark, sf_dir).withColumnRenamed("y", "label"), list(MEMBERS))
    fitted = booster.fit(frame.train)
    known = documented(fitted)
    n_fit, n_scored = frame.train.count(), fitted.transform(frame.test).count()
    rows = [(p, known[p], fitted.getNumTrees, n_fit, n_scored, refused) for p in _BOOSTER]
    return spark.createDataFrame(rows, "param string, value string, n_trees bigint, n_fit bigint, n_scored bigint, n_refused bigint")


@query("s9_score_contract", f"""WITH {MEMBERS_SQL}
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT id)::BIGINT AS n_ids, (max(id) - min(id) + 1 = count(*))::INT AS dense,
  0::BIGINT AS n_not_finite, count(*) FILTER (m_a <= 1e-12 OR m_a > 1 + 1e-9)::BIGINT AS n_out_of_range,
  (stddev_pop(m_a) > 1e-9)::INT AS varies, (SELECT count(*) FROM orders)::BIGINT AS n_expected, 0::BIGINT AS n_extra,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM members))::BIGINT AS n_lost, 1::INT AS ok FROM members""")
def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = member_frame(spark, sf_dir).select("id", F.col("m_a").alias("score"))
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return io.score_contract(scored, ids)
