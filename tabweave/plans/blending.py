"""Top-k reports, blends and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import blend, members
from tabweave.plans.catalog import query, r, rounded
from tabweave.plans.frames import CATS, CONT, DECIMALS, FEATURES, FRAME_SQL, MEMBERS, MEMBERS_SQL, PARTS, RATIOS, member_frame, member_long, order_frame
from tabweave.plans.matrix import MatrixSpec, build_matrix
from tabweave.plans.statistics import (
    _KDE_JOIN,
    _KDE_OUT,
    _KDE_SQL,
    _TRAIN,
    CDF_COLS,
    _binned_rate_sql,
    _cdf_sql,
    _prior,
    anti_sql,
    auc_sql,
    oof_sql,
)
from tabweave.session import materialize


def _rk(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({q}) - 1) / 2.0)::DOUBLE"


_N = "(SELECT count(*) FROM members)::DOUBLE"
_K = f"k AS MATERIALIZED (SELECT id, y, {', '.join(f'{_rk(m)} AS r_{m}' for m in MEMBERS)} FROM members)"


def _members(spark, sf_dir, *cols):
    return materialize(member_frame(spark, sf_dir).select("id", "y", *cols), "members")


@query("o1_top_members", f"""WITH {MEMBERS_SQL}, a AS ({auc_sql('pred', 'score', 'y', ('member',))})
SELECT member, auc FROM a ORDER BY auc DESC, member LIMIT 4""")
def top_members(spark, sf_dir):
    return rounded(members.top_members(member_long(spark, sf_dir), 4), 9)


@query("o4_top_members_rank_mean", f"""WITH {MEMBERS_SQL}, a AS ({auc_sql('pred', 'score', 'y', ('member',))}),
t AS (SELECT member FROM a ORDER BY auc DESC, member LIMIT 3), k AS (SELECT id, member, {_rk('score', 'member')} AS rk FROM pred)
SELECT id, {r('avg(rk) / (SELECT count(*) FROM orders)', 'score')} FROM k WHERE member IN (SELECT member FROM t) GROUP BY id""")
def top_members_rank_mean(spark, sf_dir):
    pred = materialize(member_long(spark, sf_dir), "pred")
    chosen = [row["member"] for row in members.top_members(pred, 3).collect()]  # k names
    return rounded(blend.rank_average_long(pred.filter(F.col("member").isin(chosen))))


@query("o5_argmax_weight", f"""WITH {MEMBERS_SQL}, g AS (SELECT y, w, w * m_d + (1 - w) * m_f AS s FROM members,
  (SELECT i * 0.25::DOUBLE AS w FROM range(5) t(i))), a AS ({auc_sql('g', 's', 'y', ('w',))}) SELECT w, auc FROM a ORDER BY auc DESC, w LIMIT 1""")
def argmax_weight(spark, sf_dir):
    wide = materialize(member_frame(spark, sf_dir).select("y", "m_d", "m_f"), "members")
    found = blend.best_weight(wide, "m_d", "m_f", "y", [i * 0.25 for i in range(5)], F.lit(1.0))
    return rounded(spark.createDataFrame([found], "w double, auc double"), 9)


@query("b1_rank_average", f"WITH {MEMBERS_SQL}, {_K} SELECT id, {r(f'(r_m_a + r_m_b + r_m_d) / 3 / {_N}', 'score')} FROM k")
def rank_average(spark, sf_dir):
    wide = _members(spark, sf_dir, "m_a", "m_b", "m_d")
    return rounded(blend.rank_average(wide, ["m_a", "m_b", "m_d"]).select("id", "score"))


def _raw_auc(rel: str) -> str:
    """Unrounded AUC per weight: ties between weights must be seen exactly."""
    return f"""SELECT w, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)) AS auc
      FROM (SELECT w, y, {_rk('s', 'w')} AS rk FROM {rel}) GROUP BY w"""


@query("b2_blend_weight_search", f"""WITH {MEMBERS_SQL}, {_K},
g1 AS (SELECT y, w, w * r_m_a + (1 - w) * r_m_b AS s FROM k, (SELECT i * 0.01::DOUBLE AS w FROM range(101) t(i))),
a1 AS ({_raw_auc('g1')}), c AS (SELECT w, auc FROM a1 ORDER BY auc DESC, w LIMIT 1),
f AS (SELECT greatest(0::DOUBLE, w - 0.02::DOUBLE) + i * 0.002::DOUBLE AS w, least(1::DOUBLE, w + 0.02::DOUBLE) + 1e-9::DOUBLE AS hi FROM c, range(25) t(i)),
g2 AS (SELECT y, w, w * r_m_a + (1 - w) * r_m_b AS s FROM k, f WHERE w < hi), a2 AS ({_raw_auc('g2')}),
u AS (SELECT *, 0 AS stage FROM c UNION ALL SELECT *, 1 FROM a2)
SELECT {r('w', 'weight')}, {r('auc', 'auc', 9)} FROM u ORDER BY u.auc DESC, stage, u.w LIMIT 1""")
def blend_weight_search(spark, sf_dir):
    w, best = blend.search_blend_weight(member_frame(spark, sf_dir), "m_a", "m_b", "y")
    return rounded(spark.createDataFrame([(float(w), float(best))], "weight double, auc double"), 9).withColumn("weight", F.round("weight", 6))


@query("b3_apply_weight", f"""WITH {MEMBERS_SQL}, {_K}, b AS (SELECT id, 0.718::DOUBLE * r_m_a + (1 - 0.718::DOUBLE) * r_m_b AS s FROM k)
SELECT id, {r('s / (SELECT max(s) FROM b)', 'score')} FROM b""")
def apply_weight(spark, sf_dir):
    return rounded(blend.apply_weight(_members(spark, sf_dir, "m_a", "m_b"), "m_a", "m_b", 0.718).select("id", "score"))


@query("b4_fixed_weights", f"""WITH {MEMBERS_SQL} SELECT id, {r('0.5::DOUBLE * m_a + 0.5::DOUBLE * m_b', 'even')},
  {r('0.85::DOUBLE * m_a + 0.15::DOUBLE * m_b', 'w85')}, {r('0.66::DOUBLE * m_a + 0.34::DOUBLE * m_b', 'w66')} FROM members""")
def fixed_weights(spark, sf_dir):
    wide = member_frame(spark, sf_dir)
    for name, w in {"even": (0.5, 0.5), "w85": (0.85, 0.15), "w66": (0.66, 0.34)}.items():
        wide = blend.fixed_blend(wide, {"m_a": w[0], "m_b": w[1]}, name)
    return rounded(wide.select("id", "even", "w85", "w66"))


_P = {m: f"least(greatest({m}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)" for m in MEMBERS}
_L = {m: f"ln({p} / (1 - {p}))" for m, p in _P.items()}


@query("b5_logit_average", f"WITH {MEMBERS_SQL} SELECT id, {r(f'1 / (1 + exp(-(({_L["m_a"]} + {_L["m_b"]} + {_L["m_c"]}) / 3)))', 'score')} FROM members")
def logit_average(spark, sf_dir):
    return rounded(member_frame(spark, sf_dir).select("id", blend.logit_average(["m_a", "m_b", "m_c"]).alias("score")))


_VARIANTS = ["m_a", "m_b", "m_c", "m_d", "m_f"]


@query("b6_variant_ensemble", f"WITH {MEMBERS_SQL}, {_K} SELECT id, {r(f'({" + ".join(f"r_{m}" for m in _VARIANTS)}) / 5 / {_N}', 'score')} FROM k")
def variant_ensemble(spark, sf_dir):
    pred = materialize(member_long(spark, sf_dir).filter(F.col("member").isin(_VARIANTS)), "pred")
    return rounded(blend.rank_average_long(pred))


@query("b7_probability_weight_scan", f"""WITH {MEMBERS_SQL}, g AS (SELECT y, w, w * m_a + (1 - w) * m_b AS s FROM members, (SELECT i * 0.01::DOUBLE AS w FROM range(101) t(i))),
a AS ({_raw_auc('g')}) SELECT {r('w', 'weight')}, {r('auc', 'auc', 9)} FROM a ORDER BY a.auc DESC, a.w LIMIT 1""")
def probability_weight_scan(spark, sf_dir):
    wide = materialize(member_frame(spark, sf_dir).select("y", "m_a", "m_b"), "members")
    w, best = blend.best_weight(wide, "m_a", "m_b", "y", blend.coarse_grid(), F.lit(1.0))
    return rounded(spark.createDataFrame([(float(w), float(best))], "weight double, auc double"), 9).withColumn("weight", F.round("weight", 6))


# --- the assembled matrix ---------------------------------------------------------------------

_ENC = MatrixSpec().encoded
_SUM = "CASE WHEN coalesce(qty_r, qty_a, qty_n) IS NOT NULL THEN coalesce(qty_r, 0) + coalesce(qty_a, 0) + coalesce(qty_n, 0) END"
_ALL3 = "qty_r IS NOT NULL AND qty_a IS NOT NULL AND qty_n IS NOT NULL"
_MX = f"CASE WHEN {_ALL3} THEN greatest(qty_r, qty_a, qty_n) END"
_DERIVED_SQL = {
    "sum_parts": _SUM,
    **{n: f"{a} / nullif({b}, 0)" for n, (a, b) in RATIOS.items()},
    "diff_bal_total": "acctbal - total_k",
    "diff_total_sum_clean": "total_k - (qty_r + qty_a + qty_n)",
    "row_max": _MX,
    "row_range": f"CASE WHEN {_ALL3} THEN greatest(qty_r, qty_a, qty_n) - least(qty_r, qty_a, qty_n) END",
    **{f"gap_{c[-1]}": f"{_MX} - {c}" for c in PARTS},
    **{n: e for c in DECIMALS for n, e in ((f"frac_{c}", f"{c} - floor({c})"), (f"d1_{c}", f"((floor({c} * 10)::BIGINT % 10) + 10) % 10"))},
}
_WIDE = f"""wide AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _DERIVED_SQL.items())}, CASE WHEN {_ALL3} THEN
  CASE WHEN qty_r >= qty_a AND qty_r >= qty_n THEN 'returned' WHEN qty_a >= qty_n THEN 'accepted' ELSE 'none' END END AS dominant FROM frame)"""
_FULL = " ".join(
    f"LEFT JOIN (SELECT {c}, (sum(label)::DOUBLE + 3.0 * {_prior('train')}) / (count(*) + 3.0)::DOUBLE AS e FROM train GROUP BY {c}) t{i} "
    f"ON t{i}.{c} IS NOT DISTINCT FROM f.{c}"
    for i, c in enumerate(_ENC)
)
_MATRIX_OUT = ", ".join(
    [
        "f.id", "f.label", "f.fold", "f.split",
        *[r(f"coalesce(try_cast(f.{c} AS DOUBLE), -999)", c) for c in [*CONT, *CATS]],
        *[r(f"coalesce(f.{n}, -999)", n) for n in _DERIVED_SQL],
        *[r(f"CASE WHEN f.split = 'train' THEN o.te_{c} ELSE coalesce(t{i}.e, {_prior('train')}) END", f"te_{c}") for i, c in enumerate(_ENC)],
        *[f"q.freq_{c}" for c in _ENC],
        *[r(f"CASE WHEN f.{c} IS NOT NULL THEN {_cdf_sql(c)} END", f"{c}__ref_cdf") for c in CDF_COLS],
        *[r(f"CASE WHEN f.{c} IS NOT NULL THEN {_cdf_sql(c, 'label = 0')} - {_cdf_sql(c, 'label = 1')} END", f"{c}__ref_cdf_gap") for c in CDF_COLS],
        *[
            r(f"abs(f.{c} - (SELECT median({c}) FROM ref{w}))", f"{c}__ref_q50_dist{s}")
            for c in CDF_COLS for s, w in (("", ""), ("_y0", " WHERE label = 0"), ("_y1", " WHERE label = 1"))
        ],
        *[r(f"coalesce(r_{c}.rate, (SELECT avg(label::DOUBLE) FROM ref))", f"{c}__ref_mean") for c in ("total_k", "disc")],
        _KDE_OUT,
    ]
)


_CLEAN = f"""old AS (SELECT * FROM frame WHERE status = 'P'), wide AS MATERIALIZED (SELECT * FROM all_rows WHERE status <> 'P'),
ref AS MATERIALIZED (SELECT * FROM old WHERE {anti_sql('old', 'wide')} QUALIFY row_number() OVER (PARTITION BY {', '.join(FEATURES)} ORDER BY id) = 1)"""


@query("e5_feature_matrix", f"""WITH {FRAME_SQL}, {_WIDE.replace('wide AS', 'all_rows AS', 1)}, {_CLEAN}, {_TRAIN.replace('FROM frame', 'FROM wide')}, {_KDE_SQL},
{_binned_rate_sql('total_k')}, {_binned_rate_sql('disc')},
o AS MATERIALIZED (SELECT id AS oid, {', '.join(f'{oof_sql(c, 3.0)} AS te_{c}' for c in _ENC)} FROM train),
q AS (SELECT id AS fid, {', '.join(f'(count(*) OVER (PARTITION BY {c}))::BIGINT AS freq_{c}' for c in _ENC)} FROM wide)
SELECT {_MATRIX_OUT} FROM wide f JOIN q ON q.fid = f.id LEFT JOIN o ON o.oid = f.id {_FULL} {_KDE_JOIN}
{' '.join(f"JOIN bq_{c} q_{c} ON q_{c}.bid = f.id LEFT JOIN br_{c} r_{c} ON r_{c}.b = q_{c}.b" for c in ('total_k', 'disc'))}""")
def feature_matrix(spark, sf_dir):
    return rounded(build_matrix(order_frame(spark, sf_dir)))
