"""Proofs over the fitted models: every result of :mod:`tabweave.plans.modelling` with what SQL can say of it.

SQL cannot train a model, but it knows which rows a k-fold result must score, and that a
fitted model must pass the proof of its kind: gradients that vanish, leaves that are means, scores that follow
from the model's parts, and AUCs that an independent curve confirms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import metrics, model, stacking
from tabweave.operators.certificates import EXACT, certificate
from tabweave.operators.trees import Boost
from tabweave.plans import modelling
from tabweave.plans.catalog import query
from tabweave.plans.frames import CONT, FEATURES, FRAME_SQL, MEMBERS_SQL
from tabweave.session import materialize

_ROWS = {
    "orders": f"WITH {FRAME_SQL}, f AS (SELECT id, label, CASE WHEN split = 'train' THEN fold % {modelling.K} END AS fold FROM frame)",
    "training orders": f"WITH {FRAME_SQL}, f AS (SELECT id, label, fold % {modelling.K} AS fold FROM frame WHERE split = 'train')",
    "members": f"WITH {MEMBERS_SQL}, f AS (SELECT id, y AS label, CASE WHEN split = 'train' THEN fold % {modelling.K} END AS fold FROM members)",
}


def _sql(rows: str, variants: list[str]) -> str:
    return f"""{_ROWS[rows]}, v(variant) AS (VALUES {', '.join(f"('{n}')" for n in variants)})
SELECT variant, fold::BIGINT AS fold, count(*)::BIGINT AS n_rows, sum(id)::BIGINT AS id_sum, CASE WHEN fold IS NOT NULL THEN sum(label) END::BIGINT AS positives,
  0::BIGINT AS n_bad, CASE WHEN fold IS NOT NULL THEN 1 END::INT AS is_optimal, 1::INT AS auc_agrees FROM f, v GROUP BY variant, fold"""


def _register(op: str, rows: str, variants: list[str], fn) -> None:
    @query(f"{op}_proof", _sql(rows, variants))
    def proof(spark: SparkSession, sf_dir: str) -> DataFrame:
        return certificate(fn(spark, sf_dir))


for _op, (_rows, _variants, _fn) in modelling.RESULTS.items():
    _register(_op, _rows, _variants, _fn)


@query("m2_patience_proof", f"""{_ROWS['orders']}
SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n_watched, 1::INT AS ends_at_its_best, 1::INT AS none_better_follows, 1::INT AS grows_the_same FROM f WHERE fold IS NOT NULL GROUP BY fold""")
def patience_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's booster ends at the lowest loss of its own fold, the rounds of patience after it bring no lower one, and it scores as one grown to that length."""
    frame, est, res = modelling._patient(spark, sf_dir)
    rounds = [m.getNumTrees for m in res.models]
    lengths = [(i, n) for i in range(modelling.K) for n in (min(modelling._LIMIT, rounds[i] + modelling._PATIENCE), rounds[i])]
    table, places = frame.whole()
    again = [Boost(est.copy().setMaxIter(n), F.col("fold") != i, places) for i, n in lengths]
    grown = model.fit_boosters(table.filter(F.col("split") == "train"), again)

    def check(i: int) -> tuple:
        m, watch, (longer, same) = res.models[i], frame.train.filter(F.col("fold") == i), grown[2 * i : 2 * i + 2]
        n = m.getNumTrees
        losses = longer.evaluateEachIteration(watch)
        both = model.score(m, watch, ["id"]).join(model.score(same, watch, ["id"], "again"), "id").agg(F.count(F.lit(1)), F.max(F.abs(F.col("score") - F.col("again")))).first()
        return i, both[0], int(m.evaluateEachIteration(watch)[-1] <= min(losses[:n]) + EXACT), int(min(losses) >= losses[n - 1] - EXACT), int(both[1] <= EXACT)

    rows = model.fit_all(spark, [lambda i=i: check(i) for i in range(modelling.K)])
    return spark.createDataFrame(rows, "fold bigint, n_watched bigint, ends_at_its_best int, none_better_follows int, grows_the_same int")


@query("m6_proof", f"""{_ROWS['members']}
SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n_rows, sum(id)::BIGINT AS id_sum, 0::BIGINT AS n_bad, 0::BIGINT AS n_negative, 1::INT AS is_optimal, 0::BIGINT AS n_other FROM f GROUP BY fold""")
def nonnegative_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of every fold and of all rows are non-negative and no move lowers the error; scores are what the weights give."""
    df = materialize(modelling.meta_table(spark, sf_dir), "meta")
    cols = modelling.ALL
    scored, full = stacking.nonnegative_blend(df, cols, modelling.K)
    found = model.grams(df.filter(F.col("split") == "train"), cols, "label", "fold")
    total = {key: sum(g[key] for g in found.values()) for key in found[0]}
    rows, want = [], F.lit(None).cast("double")
    for fold in [None, *range(modelling.K)]:
        g = total if fold is None else {key: total[key] - found[fold][key] for key in total}
        w = model.nonnegative_weights([(a, b, v) for (a, b), v in g.items()], cols, "label") if fold is not None else full
        slope = {a: sum(g[min(a, b, key=["1", *cols].index), max(a, b, key=["1", *cols].index)] * w[b] for b in w) - g[a, "label"] for a in w}
        n = g["1", "1"]
        fine = all(abs(slope[a]) / n <= EXACT if w[a] > 0 else slope[a] / n >= -EXACT for a in w)
        rows.append((fold, sum(v < 0 for v in w.values()), int(fine)))
        value = F.lit(w["1"])
        for c in cols:
            value = value + F.lit(w[c]) * F.col(c)
        mine = F.col("split") == "test" if fold is None else (F.col("split") == "train") & (F.col("fold") == fold)
        want = F.when(mine, F.least(F.greatest(value, F.lit(1e-8)), F.lit(1 - 1e-8))).otherwise(want)
    proofs = spark.createDataFrame(rows, "f bigint, n_negative bigint, is_optimal int")
    side = F.when(F.col("split") == "train", F.col("fold")).cast("bigint")
    bad = F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)
    sums = scored.withColumn("want", want).groupBy(side.alias("fold")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"), F.count_if(bad).alias("n_bad"), F.count_if(F.abs(F.col("score") - F.col("want")) > EXACT).alias("n_other")
    )
    return sums.join(proofs, F.col("fold").eqNullSafe(F.col("f"))).drop("f")


def _observed(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS view, count(*)::BIGINT AS n_rows, count({c})::BIGINT AS n_kept, 0::BIGINT AS n_missing FROM frame" for n, c in columns.items())


def _kept(df: DataFrame, filled: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per imputed view how many observed cells it keeps and how many cells it leaves missing."""
    both = df.select("id", *CONT).join(filled, "id")
    cells = F.array(*[F.struct(F.lit(n).alias("view"), (F.abs(F.col(c) - F.col(n)) < EXACT).alias("kept"), F.col(n).isNull().alias("missing")) for n, c in columns.items()])
    return both.select(F.inline(cells)).groupBy("view").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("kept").alias("n_kept"), F.count_if("missing").alias("n_missing"))


_FILLED = {f"imp_{c}": c for c in CONT}
_VIEWED = {f"{p}{c}": c for p in modelling._VIEWS.values() for c in CONT}


@query("m8_proof", f"WITH {FRAME_SQL} {_observed(_FILLED)}")
def imputation_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = modelling._imputable(spark, sf_dir)
    return _kept(df, model.model_impute(df, CONT, modelling.RAW), _FILLED)


@query("m9_proof", f"WITH {FRAME_SQL} {_observed(_VIEWED)}")
def views_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = modelling._imputable(spark, sf_dir)
    return _kept(df, model.imputed_views(df, CONT, modelling.RAW, modelling._VIEWS), _VIEWED)


@query("m10_proof", f"""WITH {FRAME_SQL}, p AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) - 1) % 5 AS part FROM frame)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, count({c})::BIGINT AS n_held, sum(id) FILTER ({c} IS NOT NULL)::BIGINT AS id_sum, 0::BIGINT AS n_missing, 1::INT AS r2_agrees FROM p WHERE part = 0" for c in CONT)}""")
def imputability_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out rows of each column are a stratified fifth of its observed ones, and R^2 is that of an independent evaluator."""
    from pyspark.ml.evaluation import RegressionEvaluator

    out = None
    for t, one in modelling._held_out(spark, sf_dir).items():
        mine = metrics.regression_quality(one, "truth", "prediction").first()["r2"]
        other = RegressionEvaluator(labelCol="truth", predictionCol="prediction", metricName="r2").evaluate(one)
        row = one.agg(F.count(F.lit(1)).alias("n_held"), F.sum("id").alias("id_sum"), F.count_if(F.col("prediction").isNull()).alias("n_missing"))
        row = row.select(F.lit(t).alias("feature"), "*", F.lit(int(abs(mine - other) <= EXACT)).alias("r2_agrees"))
        out = row if out is None else out.unionByName(row)
    return out


def _rungs() -> list[tuple[int, int, int]]:
    """(rung, rounds, draws of a family) of the search."""
    n, out = modelling.DRAWS, []
    for i, rounds in enumerate(modelling.RUNGS):
        out.append((i, rounds, n))
        n = -(-n // 3)
    return out


@query("m13_proof", f"""WITH {FRAME_SQL}, p AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) - 1) % 10 AS part FROM frame WHERE split = 'train'),
h AS (SELECT count(*)::BIGINT AS n_held, sum(label)::BIGINT AS n_positive FROM p WHERE part = 0)
SELECT family, rung::INT AS rung, rounds::INT AS rounds, n::BIGINT AS n_draws, n_held, n_positive, 1::INT AS best_kept
FROM h, (VALUES {', '.join(f"('{f}')" for f in modelling.SEARCHED)}) f(family), (VALUES {', '.join(map(str, _rungs()))}) r(rung, rounds, n)""")
def search_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family starts with all its draws, a third of a rung goes on, all are scored on the same held-out tenth, and none that is kept is worse than one that is not."""
    found = materialize(modelling.parameter_search(spark, sf_dir), "search")
    worst = F.min(F.when(F.col("kept"), F.col("auc")))
    best = F.coalesce(F.max(F.when(~F.col("kept"), F.col("auc"))), F.lit(0.0))
    return found.groupBy("family", "rung", "rounds").agg(
        F.count(F.lit(1)).alias("n_draws"), F.max("n_held").alias("n_held"), F.min("n_positive").alias("n_positive"), (worst >= best).cast("int").alias("best_kept")
    )


_MISSING = f"({' + '.join(f'({c} IS NULL)::INT' for c in FEATURES)})"


@query("m21_proof", f"""WITH {FRAME_SQL}, {MEMBERS_SQL}
SELECT members.split, least({_MISSING}, 3)::INT AS regime, count(*)::BIGINT AS n_rows, sum(members.id)::BIGINT AS id_sum, 0::BIGINT AS n_bad
FROM members JOIN frame USING (id) GROUP BY ALL""")
def regime_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every regime gets one score in (0, 1]."""
    bad = F.col("score").isNull() | (F.col("score") <= 0) | (F.col("score") > 1)
    out = modelling.regime_stack(spark, sf_dir).groupBy("split", F.col("regime").cast("int").alias("regime"))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"), F.count_if(bad).alias("n_bad"))


@query("m22_proof", f"""WITH {FRAME_SQL}, {MEMBERS_SQL}, c AS (SELECT members.id, coalesce(total_k BETWEEN 100 AND 300, FALSE) AND {_MISSING} < 4 AS corrected FROM members JOIN frame USING (id))
SELECT corrected::INT AS corrected, count(*)::BIGINT AS n_rows, sum(id)::BIGINT AS id_sum, 0::BIGINT AS n_wrong, 1::INT AS decided_by_auc FROM c GROUP BY corrected""")
def band_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the band, or not usable in it, keep their score; the correction is applied if and only if it raises the AUC inside."""
    out = modelling.band_correction(spark, sf_dir)
    seen = modelling._with_missing(spark, sf_dir).select("id", F.round("m_a", 6).alias("before"), (F.coalesce(F.col("total_k").between(100, 300), F.lit(False)) & (F.col("n_missing") < 4)).alias("corrected"))
    moved = F.abs(F.col("score") - F.col("before")) > EXACT
    wrong = F.when(F.col("corrected") & (F.col("applied") == 1), F.col("score").isNull()).otherwise(moved)
    decided = (F.col("applied") == 1) == (F.col("auc_after") > F.col("auc_before"))
    return out.join(seen, "id").groupBy(F.col("corrected").cast("int").alias("corrected")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"), F.count_if(wrong).alias("n_wrong"), F.min(decided.cast("int")).alias("decided_by_auc")
    )


@query("o2_proof", f"SELECT {len(modelling.RAW)}::BIGINT AS n_features, 0::BIGINT AS n_negative, 1::INT AS sums_to_one, 1::INT AS rule_found FROM (SELECT count(*) FROM orders)")
def importance_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances cover every column, add up to one, and put the two columns of the label's rule first."""
    res = modelling._kfold_results(spark, sf_dir)["gbt"]
    found = model.importances(res.models, res.frame.columns)
    row = (len(found), sum(v < 0 for _, v in found), int(abs(sum(v for _, v in found) - 1) <= EXACT), int({n for n, _ in found[:2]} == {"qty", "total_k"}))
    return spark.createDataFrame([row], "n_features bigint, n_negative bigint, sums_to_one int, rule_found int")


@query("l1_proof", f"""WITH {FRAME_SQL} SELECT split, count(*)::BIGINT AS n_rows, sum(id)::BIGINT AS id_sum, 0::BIGINT AS n_bad, 1::BIGINT AS n_weights FROM frame WHERE status <> 'P' GROUP BY split""")
def pipeline_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main path scores every current order once, with one weight."""
    bad = F.col("score").isNull() | (F.col("score") <= 0) | (F.col("score") > 1 + EXACT)
    return modelling.main_pipeline(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"), F.count_if(bad).alias("n_bad"), F.count_distinct("weight").alias("n_weights")
    )
