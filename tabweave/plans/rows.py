"""Row-level projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import rowwise as rw
from tabweave.functions.hashing import hidden
from tabweave.operators import sets
from tabweave.operators.blend import rank_columns
from tabweave.operators.encode import value_index
from tabweave.operators.folds import seeded_sample
from tabweave.operators.members import standardise
from tabweave.operators.ordering import fit_medians
from tabweave.operators.prep import drop_validated
from tabweave.plans.catalog import query, r, rounded
from tabweave.plans.frames import (
    CATS,
    CONT,
    DECIMALS,
    FEATURES,
    FRAME_SQL,
    MEMBERS,
    MEMBERS_SQL,
    PARTS,
    RATIOS,
    WHOLE,
    archive,
    member_frame,
    order_frame,
    sql_hash,
)
from tabweave.session import materialize

_SUM = "CASE WHEN coalesce(qty_r, qty_a, qty_n) IS NOT NULL THEN coalesce(qty_r, 0) + coalesce(qty_a, 0) + coalesce(qty_n, 0) END"
_ALL3 = "qty_r IS NOT NULL AND qty_a IS NOT NULL AND qty_n IS NOT NULL"
_MISSING = " + ".join(f"({c} IS NULL)::INT" for c in FEATURES)


def _f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_frame(spark, sf_dir)


@query("p1_ratios", f"""WITH {FRAME_SQL}
SELECT id, {', '.join(r(f'{a} / nullif({b}, 0)', n) for n, (a, b) in RATIOS.items())} FROM frame""")
def ratios(spark, sf_dir):
    return rounded(_f(spark, sf_dir).select("id", *[rw.ratio(a, b).alias(n) for n, (a, b) in RATIOS.items()]))


@query("p2_null_skipping_sum", f"WITH {FRAME_SQL} SELECT id, {r(_SUM, 'sum_parts')} FROM frame")
def null_skipping_sum(spark, sf_dir):
    return rounded(_f(spark, sf_dir).select("id", rw.null_skipping_sum(PARTS).alias("sum_parts")))


@query("p3_differences", f"""WITH {FRAME_SQL}
SELECT id, {r('acctbal - total_k', 'diff_bal_total')}, {r(f'total_k - ({_SUM})', 'diff_total_sum')} FROM frame""")
def differences(spark, sf_dir):
    return rounded(
        _f(spark, sf_dir).select(
            "id",
            (F.col("acctbal") - F.col("total_k")).alias("diff_bal_total"),
            (F.col("total_k") - rw.null_skipping_sum(PARTS)).alias("diff_total_sum"),
        )
    )


@query("p4_complete_case_mask", f"""WITH {FRAME_SQL}
SELECT id, {r('total_k - (qty_r + qty_a + qty_n)', 'diff_total_sum_clean')} FROM frame""")
def complete_case_mask(spark, sf_dir):
    resid = F.col(WHOLE) - rw.null_skipping_sum(PARTS)
    return rounded(_f(spark, sf_dir).select("id", rw.complete_case(resid, [WHOLE, *PARTS]).alias("diff_total_sum_clean")))


@query("p5_row_extrema", f"""WITH {FRAME_SQL}, e AS (SELECT id, qty_r, qty_a, qty_n,
  CASE WHEN {_ALL3} THEN greatest(qty_r, qty_a, qty_n) END AS mx, CASE WHEN {_ALL3} THEN least(qty_r, qty_a, qty_n) END AS mn FROM frame)
SELECT id, mx AS row_max, mn AS row_min, mx - mn AS row_range, mx - qty_r AS gap_r, mx - qty_a AS gap_a, mx - qty_n AS gap_n FROM e""")
def row_extrema(spark, sf_dir):
    return _f(spark, sf_dir).select(
        "id", rw.row_max(PARTS).alias("row_max"), rw.row_min(PARTS).alias("row_min"), rw.row_range(PARTS).alias("row_range"),
        *[rw.gap_to_max(c, PARTS).alias(f"gap_{c[-1]}") for c in PARTS],
    )


@query("p6_row_argmax", f"""WITH {FRAME_SQL} SELECT id, CASE WHEN {_ALL3} THEN
  CASE WHEN qty_r >= qty_a AND qty_r >= qty_n THEN 'returned' WHEN qty_a >= qty_n THEN 'accepted' ELSE 'none' END END AS dominant FROM frame""")
def row_argmax(spark, sf_dir):
    return _f(spark, sf_dir).select("id", rw.row_argmax({"returned": "qty_r", "accepted": "qty_a", "none": "qty_n"}).alias("dominant"))


@query("p7_decimal_lattice", f"""WITH {FRAME_SQL} SELECT id, {', '.join(
    r(f'{c} - floor({c})', f'frac_{c}') + f", (((floor({c} * 10)::BIGINT % 10) + 10) % 10)::DOUBLE AS d1_{c}" for c in DECIMALS)} FROM frame""")
def decimal_lattice(spark, sf_dir):
    cols = [e for c in DECIMALS for e in (rw.fraction(c).alias(f"frac_{c}"), rw.first_decimal(c).alias(f"d1_{c}"))]
    return rounded(_f(spark, sf_dir).select("id", *cols))


@query("p8_numeric_sentinel", f"""WITH {FRAME_SQL}
SELECT id, {', '.join(f'coalesce(try_cast({c} AS DOUBLE), -999) AS {c}' for c in FEATURES)} FROM frame""")
def numeric_sentinel(spark, sf_dir):
    return _f(spark, sf_dir).select("id", *[rw.numeric_or(c).alias(c) for c in FEATURES])


@query("p9_missing_flags", f"""WITH {FRAME_SQL}
SELECT id, {', '.join(f'({c} IS NULL)::INT AS miss_{c}' for c in FEATURES)}, ({_MISSING})::INT AS n_missing FROM frame""")
def missing_flags(spark, sf_dir):
    return _f(spark, sf_dir).select(
        "id", *[rw.missing_flag(c).alias(f"miss_{c}") for c in FEATURES], rw.missing_count(FEATURES).alias("n_missing")
    )


@query("p10_rule_flags", f"""WITH {FRAME_SQL}
SELECT id, (total_k > 300 OR qty_r > 40)::INT AS rule_pos, (total_k <= 150 AND qty_r <= 40)::INT AS rule_neg FROM frame""")
def rule_flags(spark, sf_dir):
    t, q = F.col("total_k"), F.col("qty_r")
    return _f(spark, sf_dir).select(
        "id", rw.rule_flag((t > 300) | (q > 40)).alias("rule_pos"), rw.rule_flag((t <= 150) & (q <= 40)).alias("rule_neg")
    )


_PAIRS = [("qty", "lines"), ("qty", "disc"), ("lines", "disc")]


@query("p11_pairwise", f"""WITH {FRAME_SQL} SELECT id, {', '.join(
    r(f'{a} * {b}', f'{a}_x_{b}') + ', ' + r(f'{a} - {b}', f'{a}_minus_{b}') for a, b in _PAIRS)} FROM frame""")
def pairwise(spark, sf_dir):
    new = rw.pairwise(["qty", "lines", "disc"])
    return rounded(_f(spark, sf_dir).select("id", *[e.alias(n) for n, e in new.items()]))


@query("p12_extra_ratios", f"""WITH {FRAME_SQL} SELECT id, {r('24 - lines', 'budget')}, {r('total_k / nullif(24 - lines, 0)', 'ratio_budget')},
  {r('24 - lines - total_k', 'budget_left')}, {r('total_k / nullif(tax, 0)', 'per_tax')}, {r('total_k / nullif(disc, 0)', 'per_disc')},
  {r('qty_r / nullif(qty_a, 0)', 'ratio_r_a')}, {r('qty_r - qty_a', 'diff_r_a')} FROM frame""")
def extra_ratios(spark, sf_dir):
    budget = F.lit(24) - F.col("lines")
    return rounded(
        _f(spark, sf_dir).select(
            "id", budget.alias("budget"), rw.ratio("total_k", budget).alias("ratio_budget"),
            (budget - F.col("total_k")).alias("budget_left"), rw.ratio("total_k", "tax").alias("per_tax"),
            rw.ratio("total_k", "disc").alias("per_disc"), rw.ratio("qty_r", "qty_a").alias("ratio_r_a"),
            (F.col("qty_r") - F.col("qty_a")).alias("diff_r_a"),
        )
    )


_P = "least(greatest(m_a, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"


@query("p13_logit_expit", f"""WITH {MEMBERS_SQL}
SELECT id, {r(f'ln({_P} / (1 - {_P}))', 'logit_a')}, {r('1 / (1 + exp(-m_b))', 'expit_b')} FROM members""")
def logit_expit(spark, sf_dir):
    return rounded(member_frame(spark, sf_dir).select("id", rw.logit("m_a").alias("logit_a"), rw.expit("m_b").alias("expit_b")))


@query("p14_within_row_rank", f"""WITH {MEMBERS_SQL}, rk AS (SELECT id, member,
  (rank() OVER (PARTITION BY id ORDER BY score) + (count(*) OVER (PARTITION BY id, score) - 1) / 2.0)::DOUBLE
  / (SELECT count(*) FROM orders) AS rank FROM pred)
SELECT id, member, {r('rank', 'rank', 9)},
  {r('(rank - avg(rank) OVER (PARTITION BY id)) / (stddev_pop(rank) OVER (PARTITION BY id) + 1e-12)', 'z', 5)} FROM rk""")
def within_row_rank(spark, sf_dir):
    wide = member_frame(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    cells = rw.within_row_rank_z(list(MEMBERS), n)
    out = wide.select("id", F.inline(cells))
    return out.select("id", "member", F.round("rank", 9).alias("rank"), (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("p15_standardise_members", f"""WITH {MEMBERS_SQL}
SELECT id, {r(f'ln({_P} / (1 - {_P}))', 'm_a')}, {r("(m_b - (SELECT avg(m_b) FROM members WHERE split = 'train')) / "
    "((SELECT stddev_pop(m_b) FROM members WHERE split = 'train') + 1e-12)", 'm_b')} FROM members""")
def standardise_members(spark, sf_dir):
    wide = member_frame(spark, sf_dir).select("id", "split", "m_a", "m_b")
    return rounded(standardise(wide, ["m_a", "m_b"], wide.filter(F.col("split") == "train"), ["m_a"]).drop("split"))


@query("p16_completeness_filter", f"""WITH {FRAME_SQL} SELECT id, ({_MISSING})::INT AS n_missing FROM frame
WHERE total_k IS NOT NULL AND {_ALL3} AND ({_MISSING}) = 1""")
def completeness_filter(spark, sf_dir):
    return (
        _f(spark, sf_dir).dropna(subset=[WHOLE, *PARTS]).select("id", rw.missing_count(FEATURES).alias("n_missing"))
        .filter(F.col("n_missing") == 1)
    )


@query("p17_regime", f"WITH {FRAME_SQL} SELECT id, least({_MISSING}, 3)::INT AS regime FROM frame")
def regime(spark, sf_dir):
    return _f(spark, sf_dir).select("id", rw.regime(rw.missing_count(FEATURES)).alias("regime"))


@query("p18_seeded_sample", f"WITH {FRAME_SQL} SELECT id, label FROM frame ORDER BY md5('7:' || id), id LIMIT 500")
def sample(spark, sf_dir):
    return seeded_sample(_f(spark, sf_dir).select("id", "label"), "id", 500, seed=7)


@query("p19_validated_pruning", f"WITH {FRAME_SQL} SELECT id, total_k, acctbal, qty, lines, prio FROM frame")
def validated_pruning(spark, sf_dir):
    kept = _f(spark, sf_dir).select("id", *FEATURES)
    return drop_validated(kept, ["qty_r", "qty_a", "qty_n", "disc", "tax", "seg", "nation"])


@query("p20_formula_imputation", f"""WITH {FRAME_SQL}
SELECT id, {r(f"coalesce(total_k, ({_SUM}) + (SELECT median(total_k - (qty_r + qty_a + qty_n)) FROM frame))", 'total_imputed')} FROM frame""")
def formula_imputation(spark, sf_dir):
    frame = _f(spark, sf_dir).select("id", WHOLE, *PARTS)
    parts = rw.null_skipping_sum(PARTS)
    resid = rw.complete_case(F.col(WHOLE) - parts, [WHOLE, *PARTS])
    median = fit_medians(frame.select(resid.alias("resid")), ["resid"])["resid"]
    return rounded(frame.select("id", F.coalesce(F.col(WHOLE), parts + F.lit(median)).alias("total_imputed")))


_MED = {c: f"(SELECT median({c}) FROM frame)" for c in [WHOLE, *PARTS]}
_FILLED = {c: f"coalesce({c}, {m})" for c, m in _MED.items()}
_N4 = " + ".join(f"({c} IS NULL)::INT" for c in [WHOLE, *PARTS])
EXTENDED_SQL = f"""CASE WHEN {_N4} <= 1 THEN {_FILLED[WHOLE]} - ({_FILLED['qty_r']} + {_FILLED['qty_a']} + {_FILLED['qty_n']}) END"""


def extended_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame with the extended residual; a missing part is predicted by its column median."""
    frame = _f(spark, sf_dir).select("id", "label", WHOLE, *PARTS)
    predicted = {c: f"_p_{c}" for c in [WHOLE, *PARTS]}
    medians = fit_medians(frame, [WHOLE, *PARTS])
    with_p = frame.withColumns({predicted[c]: F.lit(m) for c, m in medians.items()})
    return with_p.withColumn("extended", rw.extended_residual(WHOLE, PARTS, predicted)).drop(*predicted.values())


@query("p21_extended_residual", f"WITH {FRAME_SQL} SELECT id, {r(EXTENDED_SQL, 'extended')} FROM frame")
def extended_residual(spark, sf_dir):
    return rounded(extended_frame(spark, sf_dir).select("id", "extended"))


@query("p22_missing_as_category", f"""WITH {FRAME_SQL}
SELECT id, {', '.join(f"coalesce({c}, 'missing') AS {c}" for c in CATS)} FROM frame""")
def missing_as_category(spark, sf_dir):
    return _f(spark, sf_dir).select("id", *[rw.missing_label(c).alias(c) for c in CATS])


def _sql_aug(c: str) -> str:
    return f"CASE WHEN {sql_hash('id', 'aug_' + c)} % 10000 >= 4000 THEN {c} END"


def _augmented(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: hidden(F.col(c), F.col("id"), 0.40, tag=f"aug_{c}") for c in cols})


@query("p23_missing_augmentation", f"""WITH {FRAME_SQL}, d AS (SELECT DISTINCT acctbal AS v FROM frame WHERE acctbal IS NOT NULL),
ix AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM d), a AS (SELECT id, {', '.join(f'{_sql_aug(c)} AS {c}' for c in CONT)} FROM frame)
SELECT id, {', '.join(r(c, c) for c in CONT)}, {', '.join(f'({c} IS NULL)::INT AS miss_{c}' for c in CONT)},
  coalesce(k, 0)::BIGINT AS idx_acctbal FROM a LEFT JOIN ix ON v = acctbal""")
def missing_augmentation(spark, sf_dir):
    frame = _f(spark, sf_dir).select("id", *CONT)
    indexed = value_index(frame, ["acctbal"])
    hiding = _augmented(indexed, CONT)
    index = F.when(F.col("acctbal").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("idx_acctbal"))
    return rounded(
        hiding.select("id", *CONT, *[rw.missing_flag(c).alias(f"miss_{c}") for c in CONT], index.alias("idx_acctbal"))
    )


@query("p24_cascaded_augmentation", f"""WITH {FRAME_SQL}, a AS (SELECT id, {', '.join(f'{_sql_aug(c)} AS {c}' for c in CONT)} FROM frame)
SELECT id, {r('acctbal / nullif(total_k, 0)', 'ratio_bal_total')}, {r(_SUM, 'sum_parts')},
  {r('total_k - (qty_r + qty_a + qty_n)', 'diff_total_sum_clean')}, {r('total_k - floor(total_k)', 'frac_total_k')} FROM a""")
def cascaded_augmentation(spark, sf_dir):
    a = _augmented(_f(spark, sf_dir).select("id", *CONT), CONT)
    parts = rw.null_skipping_sum(PARTS)
    return rounded(
        a.select(
            "id", rw.ratio("acctbal", "total_k").alias("ratio_bal_total"), parts.alias("sum_parts"),
            rw.complete_case(F.col(WHOLE) - parts, [WHOLE, *PARTS]).alias("diff_total_sum_clean"),
            rw.fraction(WHOLE).alias("frac_total_k"),
        )
    )


def _sql_dense(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) END::BIGINT AS idx_{c}"


@query("p25_value_index", f"WITH {FRAME_SQL} SELECT id, {', '.join(_sql_dense(c) for c in CONT)} FROM frame")
def value_lookup_index(spark, sf_dir):
    frame = materialize(_f(spark, sf_dir).select("id", *CONT), "frame")
    return value_index(frame, CONT).select("id", *[f"idx_{c}" for c in CONT])


@query("p26_confidence_filter", f"""WITH {MEMBERS_SQL}
SELECT id, hi, CASE WHEN m_a >= hi THEN 1 ELSE 0 END::INT AS pseudo FROM members,
  (VALUES (0.98::DOUBLE, 0.02::DOUBLE), (0.95, 0.05), (0.90, 0.10)) t(hi, lo) WHERE m_a >= hi OR m_a <= lo""")
def confidence_filter(spark, sf_dir):
    bands = [(0.98, 0.02), (0.95, 0.05), (0.90, 0.10)]
    cells = F.array(
        *[F.struct(F.lit(hi).alias("hi"), rw.confident_label("m_a", hi, lo).alias("pseudo")) for hi, lo in bands]
    )
    return member_frame(spark, sf_dir).select("id", F.inline(cells)).filter(F.col("pseudo").isNotNull())


# --- set operations -----------------------------------------------------------------

@query("u1_transductive_union", f"WITH {FRAME_SQL} SELECT id, split, CASE WHEN split = 'train' THEN label END AS label FROM frame")
def transductive_union(spark, sf_dir):
    frame = _f(spark, sf_dir)
    train = frame.filter(F.col("split") == "train").select("id", "label")
    test = frame.filter(F.col("split") == "test").select("id")
    return sets.stack_splits(train, test)


@query("u2_pseudo_append", f"""WITH {MEMBERS_SQL}
SELECT id, y::INT AS label, fold::BIGINT AS fold, 0::INT AS is_pseudo FROM members WHERE split = 'train'
UNION ALL SELECT id, (m_a >= 0.9)::INT, -1, 1 FROM members WHERE split = 'test' AND (m_a >= 0.9 OR m_a <= 0.1)""")
def pseudo_append(spark, sf_dir):
    wide = member_frame(spark, sf_dir)
    train = wide.filter(F.col("split") == "train").select("id", F.col("y").alias("label"), "fold")
    pseudo = sets.pseudo_rows(wide.filter(F.col("split") == "test").select("id", "m_a"), "m_a", "label", 0.9, 0.1)
    return sets.append_pseudo(train, pseudo.select("id", "label"))


@query("u3_vocabulary", f"""WITH {FRAME_SQL} {' UNION '.join(
    f"SELECT '{c}' AS feature, coalesce({c}, 'missing') AS value FROM frame" for c in CATS)}""")
def vocabulary(spark, sf_dir):
    return sets.vocabulary(_f(spark, sf_dir), CATS)


@query("u4_keep_first", f"""WITH {FRAME_SQL} SELECT {', '.join(FEATURES)}, id, label FROM frame WHERE status = 'P'
QUALIFY row_number() OVER (PARTITION BY {', '.join(FEATURES)} ORDER BY id) = 1""")
def keep_first(spark, sf_dir):
    ref = archive(_f(spark, sf_dir)).select(*FEATURES, "id", "label")
    return sets.keep_first(ref, FEATURES, "id")


# --- scalar families -----------------------------------------------------------------

@query("f1_math", f"""WITH {FRAME_SQL} SELECT id, floor(total_k)::BIGINT AS floor_total, (((floor(acctbal)::BIGINT % 7) + 7) % 7) AS mod_bal,
  {r('abs(acctbal)', 'abs_bal')}, sign(acctbal)::DOUBLE AS sign_bal, {r('exp(-disc)', 'exp_disc')}, {r('ln(total_k)', 'log_total')},
  {r('pow(lines, 1.5)', 'pow_lines')}, {r('CASE WHEN acctbal IS NOT NULL THEN least(greatest(acctbal, 0), 5000) END', 'clip_bal')} FROM frame""")
def math_functions(spark, sf_dir):
    return rounded(
        _f(spark, sf_dir).select(
            "id", F.floor("total_k").alias("floor_total"), F.pmod(F.floor("acctbal"), F.lit(7)).alias("mod_bal"),
            F.abs("acctbal").alias("abs_bal"), F.signum("acctbal").alias("sign_bal"), F.exp(-F.col("disc")).alias("exp_disc"),
            F.ln("total_k").alias("log_total"), F.pow("lines", F.lit(1.5)).alias("pow_lines"),
            rw.clip("acctbal", 0.0, 5000.0).alias("clip_bal"),
        )
    )


@query("f2_nulls", f"""WITH {FRAME_SQL} SELECT id, (total_k IS NULL)::INT AS is_null, coalesce(total_k, -999) AS filled,
  nullif(lines, 1) AS nullif_one, CASE WHEN disc > 0.05 THEN disc END AS kept, coalesce(qty, 0) AS nan_filled FROM frame""")
def null_functions(spark, sf_dir):
    as_nan = F.coalesce("qty", F.lit(float("nan")))
    return _f(spark, sf_dir).select(
        "id", rw.missing_flag("total_k").alias("is_null"), F.coalesce("total_k", F.lit(-999.0)).alias("filled"),
        F.nullif(F.col("lines"), F.lit(1.0)).alias("nullif_one"), F.when(F.col("disc") > 0.05, F.col("disc")).alias("kept"),
        F.coalesce(rw.nan_to_null(as_nan), F.lit(0.0)).alias("nan_filled"),
    )


@query("f3_strings", f"""WITH {FRAME_SQL} SELECT id, id::VARCHAR AS id_text, coalesce(prio, 'nan') || '_' || coalesce(seg, 'nan') AS joint_key FROM frame""")
def string_functions(spark, sf_dir):
    return _f(spark, sf_dir).select(
        "id", F.col("id").cast("string").alias("id_text"),
        F.concat_ws("_", rw.missing_label("prio", "nan"), rw.missing_label("seg", "nan")).alias("joint_key"),
    )


@query("f4_conditionals", f"""WITH {FRAME_SQL} SELECT id, CASE WHEN lines > 4 THEN 'many' ELSE 'few' END AS size,
  CASE status WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END::INT AS rank FROM frame""")
def conditional_functions(spark, sf_dir):
    codes = F.create_map(F.lit("F"), F.lit(2), F.lit("O"), F.lit(1))
    return _f(spark, sf_dir).select(
        "id", F.when(F.col("lines") > 4, "many").otherwise("few").alias("size"),
        F.coalesce(F.element_at(codes, F.col("status")), F.lit(0)).alias("rank"),
    )


@query("f5_casts", f"""WITH {FRAME_SQL} SELECT id, try_cast(nation AS DOUBLE) AS nation_num, try_cast(prio AS DOUBLE) AS prio_num,
  lines::INT AS lines_int FROM frame""")
def cast_functions(spark, sf_dir):
    return _f(spark, sf_dir).select(
        "id", F.col("nation").try_cast("double").alias("nation_num"), F.col("prio").try_cast("double").alias("prio_num"),
        F.col("lines").cast("int").alias("lines_int"),
    )


@query("d2_percentile_rank", f"""WITH {FRAME_SQL} SELECT id, {', '.join(
    r(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END",
      f'pct_{c}', 9) for c in ('total_k', 'qty', 'disc'))} FROM frame""")
def percentile_rank(spark, sf_dir):
    frame = materialize(_f(spark, sf_dir).select("id", "total_k", "qty", "disc"), "frame")
    return rounded(rank_columns(frame, ["total_k", "qty", "disc"], "pct_", pct=True).select("id", "pct_total_k", "pct_qty", "pct_disc"), 9)
