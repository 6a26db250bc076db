"""Joins, encodings, aggregations, reference distributions and profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import rowwise as rw
from tabweave.operators import encode, joins, metrics, ordering, prep, profile, refdist, search
from tabweave.operators.blend import auc_per_weight
from tabweave.operators.folds import hash_fold, seeded_sample, stratified_folds
from tabweave.plans.catalog import query, r, rounded
from tabweave.plans.frames import (
    CATS,
    CONT,
    FEATURES,
    FRAME_SQL,
    MEMBERS,
    MEMBERS_SQL,
    PARTS,
    WHOLE,
    archive,
    current,
    member_frame,
    member_long,
    order_frame,
    sql_hash,
    table,
)
from tabweave.plans.rows import EXTENDED_SQL, extended_frame
from tabweave.session import materialize

REF_SQL = "ref AS (SELECT * FROM frame WHERE status = 'P'), cur AS (SELECT * FROM frame WHERE status <> 'P')"
KDE_COLS = ["qty", "lines"]
CDF_COLS = ["total_k", "qty", "disc"]


def _frame(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return order_frame(spark, sf_dir).select(*cols)


def _written(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return materialize(_frame(spark, sf_dir, *cols), "frame")


def auc_sql(relation: str, score: str, label: str, by: tuple[str, ...] = (), alias: str = "auc") -> str:
    """Rank-based AUC in SQL: (positive rank sum - n1 (n1 + 1) / 2) / (n1 n0)."""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    tie = f"PARTITION BY {', '.join([*by, 's'])}"
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {keys}{r('(sum(rk) FILTER (l = 1) - sum(l) * (sum(l) + 1) / 2.0) / nullif(sum(l)::DOUBLE * sum(1 - l), 0)', alias, 9)}
      FROM (SELECT *, (rank() OVER ({part} ORDER BY s) + (count(*) OVER ({tie}) - 1) / 2.0)::DOUBLE AS rk
            FROM (SELECT {keys}{label} AS l, {score} AS s FROM {relation} WHERE {score} IS NOT NULL AND {label} IS NOT NULL)) {group}"""


def melt_sql(cols: list[str], relation: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c}::DOUBLE AS value FROM {relation}" for c in cols)


# --- encodings -----------------------------------------------------------------------

def _prior(rel: str) -> str:
    return f"(SELECT sum(label)::DOUBLE / count(*) FROM {rel})"


def oof_sql(key: str, m: float, rel: str = "train") -> str:
    """Out-of-fold value of each row of ``rel``: the key's totals less the row's own (key, fold) cell, by windows alone."""
    rest = lambda what: f"({what} OVER (PARTITION BY {key}) - {what} OVER (PARTITION BY {key}, fold))"
    n, s = rest("count(*)"), rest("sum(label)")
    return f"CASE WHEN {n} = 0 THEN {_prior(rel)} ELSE ({s}::DOUBLE + {m} * {_prior(rel)}) / ({n} + {m})::DOUBLE END"


ENC_COLS = ["lines", "qty_r", "prio", "seg"]
_TRAIN = "train AS MATERIALIZED (SELECT * FROM frame WHERE split = 'train')"


@query("a1_m_estimate", f"""WITH {FRAME_SQL}, {_TRAIN} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, {c} AS k1, count(*)::BIGINT AS n, sum(label)::BIGINT AS s, "
    + r(f'(sum(label)::DOUBLE + 3.0 * {_prior("train")}) / (count(*) + 3.0)::DOUBLE', 'enc') + f" FROM train GROUP BY {c}" for c in CATS)}""")
def m_estimate(spark, sf_dir):
    train = _frame(spark, sf_dir, *CATS, "label", "split").filter(F.col("split") == "train")
    return rounded(encode.encoding_table(train, CATS, "label", 3.0).drop("k2"))


@query("a2_oof_target_encoding", f"""WITH {FRAME_SQL}, {_TRAIN}
SELECT id, {', '.join(r(oof_sql(c, 3.0), 'te_' + c) for c in ENC_COLS)} FROM train""")
def oof_target_encoding(spark, sf_dir):
    train = _written(spark, sf_dir, "id", *ENC_COLS, "label", "fold", "split").filter(F.col("split") == "train")
    enc = encode.fit_encoding(train, ENC_COLS, "label", "fold")
    return rounded(encode.encode_oof(train, enc, "fold", 3.0).select("id", *[f"te_{c}" for c in ENC_COLS]))


_NESTED_COLS, _OUTER = ["prio", "lines"], 3


def _nested_sql(key: str, v: int) -> str:
    """What outer fold ``v``'s model may know of a row's key: by windows over the key, and over the key and inner fold."""
    prior = f"(SELECT sum(label)::DOUBLE / count(*) FROM t WHERE outer_fold <> {v})"

    def rest(what: str) -> str:
        both = f"{what} FILTER (outer_fold = {v})"
        alone = f"({what} OVER (PARTITION BY {key}) - coalesce({both} OVER (PARTITION BY {key}), 0))"
        own = f"({what} OVER (PARTITION BY {key}, fold) - coalesce({both} OVER (PARTITION BY {key}, fold), 0))"
        return f"({alone} - CASE WHEN outer_fold = {v} THEN 0 ELSE {own} END)"

    n, s = rest("count(*)"), rest("sum(label)")
    return f"CASE WHEN {n} = 0 THEN {prior} ELSE ({s}::DOUBLE + 3.0 * {prior}) / ({n} + 3.0)::DOUBLE END"


@query("a2_nested_encoding", f"""WITH {FRAME_SQL}, t AS MATERIALIZED (SELECT *, {sql_hash('id', 'outer')} % {_OUTER} AS outer_fold FROM frame WHERE split = 'train')
SELECT id, outer_fold, {', '.join(r(_nested_sql(c, v), f'te_{c}_{v}') for c in _NESTED_COLS for v in range(_OUTER))} FROM t""")
def nested_encoding(spark, sf_dir):
    """The encodings that the models of other folds than the encodings' may use: both a row's inner fold and the model's outer fold are left out."""
    frame = _frame(spark, sf_dir, "id", *_NESTED_COLS, "label", "fold", "split").filter(F.col("split") == "train")
    train = materialize(frame.withColumn("outer_fold", hash_fold(F.col("id"), _OUTER, tag="outer")), "frame")
    enc = encode.fit_nested(train, _NESTED_COLS, "label", "fold", "outer_fold", _OUTER)
    out = encode.encode_nested(train, enc, "fold", "outer_fold")
    return rounded(out.select("id", "outer_fold", *[F.col(f"te_{c}")[v].alias(f"te_{c}_{v}") for c in _NESTED_COLS for v in range(_OUTER)]))


@query("a3_test_encoding", f"""WITH {FRAME_SQL}, {_TRAIN} SELECT id, {', '.join(r(f'coalesce(e{i}.e, {_prior("train")})', 'te_' + c) for i, c in enumerate(ENC_COLS))}
FROM (SELECT * FROM frame WHERE split = 'test') q {' '.join(
    f"LEFT JOIN (SELECT {c}, (sum(label)::DOUBLE + 3.0 * {_prior('train')}) / (count(*) + 3.0)::DOUBLE AS e FROM train GROUP BY {c}) e{i} "
    f"ON e{i}.{c} IS NOT DISTINCT FROM q.{c}" for i, c in enumerate(ENC_COLS))}""")
def test_encoding(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", *ENC_COLS, "label", "fold", "split")
    enc = encode.fit_encoding(frame.filter(F.col("split") == "train"), ENC_COLS, "label", "fold")
    test = frame.filter(F.col("split") == "test")
    return rounded(encode.encode_full(test, enc, 3.0).select("id", *[f"te_{c}" for c in ENC_COLS]))


@query("a4_frequency_encoding", f"""WITH {FRAME_SQL}
SELECT id, {', '.join(f'(count(*) OVER (PARTITION BY {c}))::BIGINT AS freq_{c}' for c in FEATURES)} FROM frame""")
def frequency_encoding(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", *FEATURES)
    return encode.frequency_encode(frame, FEATURES).select("id", *[f"freq_{c}" for c in FEATURES])


_PAIR_COLS = ["lines", "disc", "tax", "prio"]
_PAIRS = list(combinations(_PAIR_COLS, 2))


@query("a5_pair_encoding", f"""WITH {FRAME_SQL}, {_TRAIN}
SELECT id, {', '.join(r(oof_sql(f'{a}, {b}', 10.0), f'te_{a}__{b}') for a, b in _PAIRS)} FROM train""")
def pair_encoding(spark, sf_dir):
    train = _written(spark, sf_dir, "id", *_PAIR_COLS, "label", "fold", "split").filter(F.col("split") == "train")
    enc = encode.fit_encoding(train, _PAIRS, "label", "fold")
    return rounded(encode.encode_oof(train, enc, "fold", 10.0).select("id", *[f"te_{a}__{b}" for a, b in _PAIRS]))


@query("a6_pair_density", f"""WITH {FRAME_SQL}, d AS ({' UNION ALL '.join(
    f"SELECT '{a}__{b}' AS pair, (SELECT count(*) FROM frame)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM frame))::BIGINT AS n_cells"
    for a, b in combinations(CONT, 2))}) SELECT pair, n_rows, n_cells, {r('n_rows::DOUBLE / n_cells', 'density')} FROM d WHERE n_rows::DOUBLE / n_cells >= 15""")
def pair_density(spark, sf_dir):
    return rounded(encode.pair_density(_frame(spark, sf_dir, *CONT), list(combinations(CONT, 2)), 15.0))


_GRID = [0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0]


@query("m19_smoothing_sweep", f"""WITH {FRAME_SQL}, {_TRAIN}, cells AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, label, count(*) OVER (PARTITION BY {c}) - count(*) OVER (PARTITION BY {c}, fold) AS n, "
    f"sum(label) OVER (PARTITION BY {c}) - sum(label) OVER (PARTITION BY {c}, fold) AS s FROM train" for c in ENC_COLS)}),
enc AS (SELECT feature, m, label, CASE WHEN n = 0 THEN {_prior('train')} ELSE (s::DOUBLE + m * {_prior('train')}) / (n::DOUBLE + m) END AS e
  FROM cells, (SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in _GRID)}]) AS m))
{auc_sql('enc', 'e', 'label', ('feature', 'm'))}""")
def smoothing_sweep(spark, sf_dir):
    train = _written(spark, sf_dir, *ENC_COLS, "label", "fold", "split").filter(F.col("split") == "train")
    cells = encode.smoothing_grid(encode.fit_encoding(train, ENC_COLS, "label", "fold"), _GRID)
    out = metrics.auc_from_counts(cells, "enc", F.col("pos"), F.col("neg"), ["feature", "m"])
    return rounded(out.select("feature", "m", "auc"), 9)


# --- joins ------------------------------------------------------------------------------

def anti_sql(ref: str, cur: str) -> str:
    """Condition that no row of ``cur`` equals the row of ``ref`` on all columns, numbers rounded."""
    same = [f"round({cur}.{c}, 8) IS NOT DISTINCT FROM round({ref}.{c}, 8)" for c in CONT] + [f"{cur}.{c} IS NOT DISTINCT FROM {ref}.{c}" for c in CATS]
    return f"NOT EXISTS (SELECT 1 FROM {cur} WHERE {' AND '.join(same)})"


@query("j1_reference_anti_join", f"WITH {FRAME_SQL}, {REF_SQL} SELECT id, label FROM ref WHERE {anti_sql('ref', 'cur')}")
def reference_anti_join(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "label", "status", *FEATURES)
    return joins.null_safe_anti_join(archive(frame), current(frame), CONT, CATS).select("id", "label")


@query("j2_encoding_lookup", f"""WITH {FRAME_SQL}, {REF_SQL}, e AS (SELECT qty, (sum(label)::DOUBLE + 3.0 * {_prior('ref')}) / (count(*) + 3.0)::DOUBLE AS enc
  FROM ref GROUP BY qty) SELECT id, {r(f'coalesce(enc, {_prior("ref")})', 'enc')} FROM frame LEFT JOIN e ON e.qty IS NOT DISTINCT FROM frame.qty""")
def encoding_lookup(spark, sf_dir):
    """Encoding fitted on the archive, looked up for every order; values it never saw get the prior."""
    frame = _written(spark, sf_dir, "id", "qty", "label", "status")
    ref = archive(frame)
    prior = ref.agg(F.avg(F.col("label").cast("double"))).first()[0]
    counted = ref.groupBy("qty").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"))
    enc = materialize(counted.select("qty", "n", encode.m_estimate(F.col("n"), F.col("s"), prior, 3.0).alias("enc")), "enc")
    out = joins.lookup(frame, enc, {"qty": F.col("qty")}, ["enc"], weight="n")
    return rounded(out.select("id", F.coalesce("enc", F.lit(prior)).alias("enc")))


@query("j3_reference_position", f"""WITH {FRAME_SQL}, {REF_SQL} SELECT id, {', '.join(
    f"CASE WHEN f.{c} IS NOT NULL THEN (SELECT count(*) FROM ref WHERE ref.{c} <= f.{c}) END::BIGINT AS pos_{c}" for c in ('total_k', 'disc'))} FROM frame f""")
def reference_position(spark, sf_dir):
    cols = ["total_k", "disc"]
    frame = _written(spark, sf_dir, "id", "status", "label", *cols)
    fitted = search.reference_sums(archive(frame), cols, {"below": F.lit(1)})
    return search.add_running_sums(frame, fitted, {c: {"below": f"pos_{c}"} for c in cols}).select("id", *[f"pos_{c}" for c in cols])


@query("j4_block_assembly", f"""WITH {FRAME_SQL} SELECT frame.id, {r('total_k', 'total_k')}, freq_prio, {r('ratio_bal', 'ratio_bal')} FROM frame
JOIN (SELECT id, (count(*) OVER (PARTITION BY prio))::BIGINT AS freq_prio FROM frame) a ON a.id = frame.id
JOIN (SELECT id, acctbal / nullif(total_k, 0) AS ratio_bal FROM frame) b ON b.id = frame.id""")
def block_assembly(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "total_k", "acctbal", "prio")
    freq = encode.frequency_encode(frame.select("id", "prio"), ["prio"]).select("id", "freq_prio")
    ratio = frame.select("id", rw.ratio("acctbal", "total_k").alias("ratio_bal"))
    return rounded(joins.align(joins.align(frame.select("id", "total_k"), freq), ratio))


@query("j5_score_alignment", f"""WITH {MEMBERS_SQL}, a AS (SELECT id, m_a AS score_a FROM members), b AS (SELECT id, m_b AS score_b FROM members WHERE split = 'test')
SELECT id, {r('score_a', 'score_a')}, {r('score_b', 'score_b')} FROM a JOIN b USING (id)""")
def score_alignment(spark, sf_dir):
    wide = member_frame(spark, sf_dir)
    a = wide.select("id", F.col("m_a").alias("score_a"))
    b = wide.filter(F.col("split") == "test").select("id", F.col("m_b").alias("score_b"))
    return rounded(joins.align(a, b))


_WEIGHTS = [i * 0.1 for i in range(11)]


@query("j6_weight_grid_auc", f"""WITH {MEMBERS_SQL}, g AS (SELECT y, w, w * m_d + (1 - w) * m_f AS s FROM members,
  (SELECT unnest([{', '.join(f'{w!r}::DOUBLE' for w in _WEIGHTS)}]) AS w)), a AS ({auc_sql('g', 's', 'y', ('w',))})
SELECT {r('w', 'w', 9)}, auc FROM a""")
def weight_grid_auc(spark, sf_dir):
    return rounded(auc_per_weight(member_frame(spark, sf_dir), "m_d", "m_f", "y", _WEIGHTS).select("w", "auc"), 9)


@query("j7_subset_override", f"""WITH {FRAME_SQL}, {MEMBERS_SQL} SELECT members.id, {r('CASE WHEN total_k BETWEEN 100 AND 200 THEN m_b ELSE m_a END', 'score')}
FROM members JOIN frame USING (id)""")
def subset_override(spark, sf_dir):
    wide = member_frame(spark, sf_dir)
    band = _frame(spark, sf_dir, "id", "total_k").filter(F.col("total_k").between(100, 200)).select("id")
    patch = joins.align(wide.select("id", F.col("m_b").alias("score")), band)
    return rounded(joins.override(wide.select("id", F.col("m_a").alias("score")), patch, "id", "score"))


def _kde_sql(col: str) -> str:
    """Brute-force class-conditional kernel log ratio per distinct value."""
    stats = f"""st_{col} AS (SELECT avg({col}) AS mu, CASE WHEN stddev_pop({col}) < 1e-12 THEN 1 ELSE stddev_pop({col}) END AS sd FROM ref),
bw_{col} AS (SELECT label AS c, count({col}) AS n, least(greatest(0.9 * least(stddev_samp(({col} - mu) / sd),
    (quantile_cont(({col} - mu) / sd, 0.75) - quantile_cont(({col} - mu) / sd, 0.25)) / 1.34) * pow(count({col}), -0.2), 0.10), 1.00) AS h
  FROM ref, st_{col} WHERE {col} IS NOT NULL GROUP BY label),
rv_{col} AS (SELECT label AS c, ({col} - mu) / sd AS z, count(*) AS w FROM ref, st_{col} WHERE {col} IS NOT NULL GROUP BY ALL),
qv_{col} AS (SELECT DISTINCT {col} AS v, ({col} - mu) / sd AS z FROM frame, st_{col} WHERE {col} IS NOT NULL),
ex_{col} AS (SELECT v, q.z AS zq, rv.c, w, h, n, -0.5 * ((q.z - rv.z) / h) * ((q.z - rv.z) / h) AS e FROM qv_{col} q, rv_{col} rv JOIN bw_{col} b ON b.c = rv.c),
mx_{col} AS (SELECT v, c, max(e) AS m FROM ex_{col} GROUP BY ALL),
ld_{col} AS (SELECT x.v, x.c, ln(sum(w * exp(e - m))) + any_value(m) - ln(any_value(n) * any_value(h)) AS ld
  FROM ex_{col} x JOIN mx_{col} y ON x.v = y.v AND x.c = y.c GROUP BY ALL),
ll_{col} AS (SELECT v, least(greatest(max(ld) FILTER (c = 1) - max(ld) FILTER (c = 0), -20), 20) AS llr FROM ld_{col} GROUP BY v)"""
    return stats


_KDE_SQL = ", ".join(_kde_sql(c) for c in KDE_COLS)
_KDE_OUT = ", ".join(r(f"l_{c}.llr", f"{c}__ref_kde_llr") for c in KDE_COLS)
_KDE_JOIN = " ".join(f"LEFT JOIN ll_{c} l_{c} ON l_{c}.v = f.{c}" for c in KDE_COLS)


@query("j8_kernel_sums", f"WITH {FRAME_SQL}, {REF_SQL}, {_kde_sql('qty')} SELECT v AS value, {r('llr', 'llr')} FROM ll_qty")
def kernel_sums(spark, sf_dir):
    frame = _written(spark, sf_dir, "qty", "label", "status")
    fit = refdist.fit_kernels(archive(frame), ["qty"], "label")["qty"]
    values = frame.select(F.col("qty").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return rounded(values.withColumn("llr", refdist.kernel_log_ratio(F.col("value"), fit)))


@query("j9_group_deviation", f"""WITH {FRAME_SQL}, {_TRAIN}, g AS (SELECT seg, {', '.join(f'avg({c}) AS m_{c}' for c in [WHOLE, *PARTS])} FROM train WHERE seg IS NOT NULL GROUP BY seg)
SELECT id, {', '.join(r(f'{c} - m_{c}', f'{c}_dev', 5) for c in [WHOLE, *PARTS])} FROM frame LEFT JOIN g ON g.seg = frame.seg""")
def group_deviation(spark, sf_dir):
    cols = [WHOLE, *PARTS]
    frame = _written(spark, sf_dir, "id", "seg", "split", *cols)
    out = joins.group_deviation(frame.filter(F.col("split") == "train"), frame, "seg", cols, "_dev")
    return rounded(out.select("id", *[f"{c}_dev" for c in cols]), 5)


# --- class and category aggregates ------------------------------------------------------

@query("a7_class_means", f"""WITH {FRAME_SQL}, l AS ({melt_sql(CONT, 'frame', 'label')})
SELECT feature, {r('avg(value) FILTER (label = 0)', 'mean_0')}, {r('avg(value) FILTER (label = 1)', 'mean_1')},
  {r('avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)', 'diff')} FROM l GROUP BY feature""")
def class_means(spark, sf_dir):
    return rounded(profile.class_means(_frame(spark, sf_dir, *CONT, "label"), CONT, "label"))


@query("a8_crosstab_margins", f"""WITH {FRAME_SQL}, f AS (SELECT coalesce(prio, 'missing') AS p, label::VARCHAR AS l FROM frame)
SELECT p AS category, l AS class, count(*)::BIGINT AS n FROM f GROUP BY ALL UNION ALL SELECT p, '(all)', count(*) FROM f GROUP BY ALL
UNION ALL SELECT '(all)', l, count(*) FROM f GROUP BY ALL UNION ALL SELECT '(all)', '(all)', count(*) FROM f""")
def crosstab_margins(spark, sf_dir):
    return profile.crosstab(_frame(spark, sf_dir, "prio", "label"), "prio", "label")


def _edge_list(col: str, n: int, rel: str) -> str:
    probs = ", ".join(f"{i / n!r}" for i in range(n + 1))
    return f"(SELECT quantile_cont({col}, [{probs}]) FROM {rel} WHERE {col} IS NOT NULL)"


def _bin_sql(value: str, edges: str, op: str) -> str:
    """Bin from inner unique edges: how many the value passes."""
    return f"len(list_filter(list_sort(list_distinct({edges}))[2:-2], lambda x: x {op} {value}))"


@query("a9_tercile_pivot", f"""WITH {FRAME_SQL}, e AS (SELECT {_edge_list('total_k', 3, 'frame')} AS ea, {_edge_list('acctbal', 3, 'frame')} AS eb),
b AS (SELECT {_bin_sql('total_k', 'ea', '<')}::INT AS row_bin, {_bin_sql('acctbal', 'eb', '<')}::INT AS c, label FROM frame, e WHERE total_k IS NOT NULL AND acctbal IS NOT NULL)
SELECT row_bin, {', '.join(r(f'avg(label) FILTER (c = {i})', f'col_{i}') for i in range(3))} FROM b GROUP BY row_bin""")
def tercile_pivot(spark, sf_dir):
    frame = _written(spark, sf_dir, "total_k", "acctbal", "label")
    return rounded(profile.tercile_pivot(frame, "total_k", "acctbal", "label"))


@query("a10_null_profile", f"""WITH {FRAME_SQL}, n AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL)::BIGINT AS n_null, count(*) AS t FROM frame" for c in [*FEATURES, 'label', 'status'])})
SELECT feature, n_null, {r('n_null * 100.0 / t', 'pct_null')} FROM n WHERE n_null > 0""")
def null_profile(spark, sf_dir):
    cols = [*FEATURES, "label", "status"]
    return rounded(profile.null_profile(_frame(spark, sf_dir, *cols), cols))


@query("a11_describe", f"""WITH {FRAME_SQL}, l AS ({melt_sql(CONT, 'frame', 'id')})
SELECT feature, count(value)::BIGINT AS count, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, min(value) AS min, max(value) AS max,
  {', '.join(r(f'quantile_cont(value, {p})', n) for p, n in ((0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75')))} FROM l GROUP BY feature""")
def describe(spark, sf_dir):
    return rounded(profile.describe(_written(spark, sf_dir, *CONT), CONT))


@query("a12_category_shares", f"""WITH {FRAME_SQL}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS value, split FROM frame WHERE {c} IS NOT NULL" for c in CATS)}),
s AS (SELECT feature, value, count(*) FILTER (split = 'train') * 100.0 / any_value(ta) AS a, count(*) FILTER (split = 'test') * 100.0 / any_value(tb) AS b
  FROM l JOIN (SELECT feature, count(*) FILTER (split = 'train') AS ta, count(*) FILTER (split = 'test') AS tb FROM l GROUP BY 1) t USING (feature) GROUP BY ALL)
SELECT feature, value, {r('a', 'share_a')}, {r('b', 'share_b')}, {r('b - a', 'diff')} FROM s""")
def category_shares(spark, sf_dir):
    return rounded(profile.category_shares(_frame(spark, sf_dir, *CATS, "split"), CATS, F.col("split") == "test"))


@query("a13_split_moments", f"""WITH {FRAME_SQL}, l AS ({melt_sql(CONT, 'frame', 'split')})
SELECT feature, {r("avg(value) FILTER (split = 'train')", 'mean_train')}, {r("avg(value) FILTER (split = 'test')", 'mean_test')},
  {r("stddev_samp(value) FILTER (split = 'train')", 'std_train')}, {r("stddev_samp(value) FILTER (split = 'test')", 'std_test')},
  {r("avg(value) FILTER (split = 'test') - avg(value) FILTER (split = 'train')", 'delta_mean')} FROM l GROUP BY feature""")
def split_moments(spark, sf_dir):
    m = profile.moments(_frame(spark, sf_dir, *CONT, "split"), CONT, ["split"])
    side = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    wide = m.groupBy("feature").agg(
        side("train", "mean").alias("mean_train"), side("test", "mean").alias("mean_test"),
        side("train", "std").alias("std_train"), side("test", "std").alias("std_test"),
    )
    return rounded(wide.withColumn("delta_mean", F.col("mean_test") - F.col("mean_train")))


@query("a14_psi", f"""WITH cut AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.5) AS at FROM events),
e AS (SELECT value, length(props)::DOUBLE AS props_len, epoch_us(ts)::DOUBLE >= cut.at AS late FROM events, cut),
{', '.join(f'''q_{c} AS (SELECT quantile_cont({c}, [{', '.join(repr(i / 20) for i in range(21))}])[2:-2] AS inner_edges FROM e WHERE NOT late),
s_{c} AS (SELECT b, greatest(count(*) FILTER (NOT late) / (SELECT count(*) FROM e WHERE NOT late)::DOUBLE, 1e-6) AS pa,
  greatest(count(*) FILTER (late) / (SELECT count(*) FROM e WHERE late)::DOUBLE, 1e-6) AS pb
  FROM (SELECT late, len(list_filter(inner_edges, lambda x: x <= {c})) AS b FROM e, q_{c}) GROUP BY b)''' for c in ('value', 'props_len'))}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, {r('sum((pa - pb) * ln(pa / pb))', 'psi')} FROM s_{c}" for c in ('value', 'props_len'))}""")
def psi(spark, sf_dir):
    """Earlier half of the events against the later half: the cut is the exact median time."""
    events = materialize(
        table(spark, sf_dir, "events", "event_id").select("value", F.length("props").cast("double").alias("props_len"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at")), "events"
    )
    late = F.col("at") >= F.lit(ordering.fit_medians(events, ["at"])["at"])
    return rounded(profile.psi(events, ["value", "props_len"], late))


_CLOSED = [("left", "<="), ("right", "<")]


@query("a15_quantile_bins", f"""WITH {FRAME_SQL}, e AS (SELECT {_edge_list('total_k', 20, 'frame')} AS et, {_edge_list('lines', 20, 'frame')} AS el)
SELECT id, {', '.join(f"CASE WHEN total_k IS NULL THEN -1 ELSE {_bin_sql('total_k', 'et', op)} END::INT AS total_{n}, "
    f"CASE WHEN lines IS NULL THEN -1 ELSE {_bin_sql('lines', 'el', op)} END::INT AS lines_{n}" for n, op in _CLOSED)} FROM frame, e""")
def quantile_bins(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "total_k", "lines")
    edges = ordering.fit_bin_edges(frame, ["total_k", "lines"], 20)
    return frame.select(
        "id",
        *[
            F.coalesce(rw.bin_index(c, edges[c], closed), F.lit(-1)).alias(f"{c.split('_')[0]}_{closed}")
            for closed, _ in _CLOSED for c in ("total_k", "lines")
        ],
    )


# --- reference distributions --------------------------------------------------------------

def _binned_rate_sql(col: str) -> str:
    return f"""eg_{col} AS (SELECT {_edge_list(col, 20, 'ref')} AS ed), br_{col} AS (
  SELECT {_bin_sql(col, 'ed', '<=')} AS b, avg(label::DOUBLE) AS rate FROM ref, eg_{col} WHERE {col} IS NOT NULL GROUP BY 1),
bq_{col} AS (SELECT id AS bid, CASE WHEN {col} IS NOT NULL THEN {_bin_sql(col, 'ed', '<=')} END AS b FROM frame, eg_{col})"""


@query("a16_binned_label_mean", f"""WITH {FRAME_SQL}, {REF_SQL}, {_binned_rate_sql('total_k')}, {_binned_rate_sql('disc')}
SELECT f.id, {', '.join(r(f'coalesce(r_{c}.rate, (SELECT avg(label::DOUBLE) FROM ref))', f'{c}__ref_mean') for c in ('total_k', 'disc'))}
FROM frame f {' '.join(f"JOIN bq_{c} q_{c} ON q_{c}.bid = f.id LEFT JOIN br_{c} r_{c} ON r_{c}.b = q_{c}.b" for c in ('total_k', 'disc'))}""")
def binned_label_mean(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "status", "label", "total_k", "disc")
    fitted = refdist.fit_reference(archive(frame), "label", mean_cols=["total_k", "disc"])
    return rounded(refdist.add_reference_scalars(frame, fitted).select("id", "total_k__ref_mean", "disc__ref_mean"))


def _cdf_sql(c: str, where: str = "TRUE") -> str:
    return f"(SELECT count(*) FROM ref WHERE ref.{c} <= f.{c} AND {where}) / (SELECT count({c}) FROM ref WHERE {where})::DOUBLE"


@query("a17_reference_cdf", f"""WITH {FRAME_SQL}, {REF_SQL} SELECT id, {', '.join(
    r(f'CASE WHEN f.{c} IS NOT NULL THEN {_cdf_sql(c)} END', f'{c}__ref_cdf') for c in CDF_COLS)} FROM frame f""")
def reference_cdf(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "status", "label", *CDF_COLS)
    fitted = refdist.fit_ecdf(archive(frame), CDF_COLS, "label")
    return rounded(refdist.add_ecdf(frame, fitted, CDF_COLS).select("id", *[f"{c}__ref_cdf" for c in CDF_COLS]))


@query("a18_class_cdf_gap", f"""WITH {FRAME_SQL}, {REF_SQL} SELECT id, {', '.join(
    r(f"CASE WHEN f.{c} IS NOT NULL THEN {_cdf_sql(c, 'label = 0')} - {_cdf_sql(c, 'label = 1')} END", f'{c}__ref_cdf_gap') for c in CDF_COLS)} FROM frame f""")
def class_cdf_gap(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "status", "label", *CDF_COLS)
    fitted = refdist.fit_ecdf(archive(frame), CDF_COLS, "label")
    return rounded(refdist.add_ecdf(frame, fitted, gap_cols=CDF_COLS).select("id", *[f"{c}__ref_cdf_gap" for c in CDF_COLS]))


@query("a19_median_distance", f"""WITH {FRAME_SQL}, {REF_SQL} SELECT id, {', '.join(
    r(f'abs({c} - (SELECT median({c}) FROM ref))', f'{c}__ref_q50_dist') + ', '
    + ', '.join(r(f'abs({c} - (SELECT median({c}) FROM ref WHERE label = {y}))', f'{c}__ref_q50_dist_y{y}') for y in (0, 1)) for c in CDF_COLS)} FROM frame""")
def median_distance(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "status", "label", *CDF_COLS)
    fitted = refdist.fit_reference(archive(frame), "label", median_cols=CDF_COLS)
    out = refdist.add_reference_scalars(frame, fitted)
    return rounded(out.select("id", *[c for c in out.columns if "__ref_q50" in c]))


@query("a20_silverman_bandwidth", f"""WITH {FRAME_SQL}, {REF_SQL}, l AS ({melt_sql(CONT, 'ref', 'label')}),
st AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM l GROUP BY feature)
SELECT feature, label, count(value)::BIGINT AS n, {r('''least(greatest(0.9 * list_min(list_filter([stddev_samp((value - mu) / sd),
  (quantile_cont((value - mu) / sd, 0.75) - quantile_cont((value - mu) / sd, 0.25)) / 1.34], lambda x: x > 1e-12)) * pow(count(value), -0.2), 0.10), 1.00)''', 'bandwidth')}
FROM l JOIN st USING (feature) WHERE value IS NOT NULL GROUP BY feature, label""")
def silverman_bandwidth(spark, sf_dir):
    frame = _written(spark, sf_dir, "status", "label", *CONT)
    stats = refdist.kernel_statistics(archive(frame), CONT, "label")
    rows = [(c, y, int(st["n"][y]), float(st["bandwidth"][y])) for c, st in stats.items() for y in (0, 1)]
    return rounded(spark.createDataFrame(rows, "feature string, label int, n bigint, bandwidth double"))


# A column of few values and one of nearly as many values as rows.
_RATIO_COLS = ["lines", "total_k"]


@query("a21_kernel_log_ratio", f"""WITH {FRAME_SQL}, {REF_SQL}, {', '.join(_kde_sql(c) for c in _RATIO_COLS)}
SELECT f.id, {', '.join(r(f'l_{c}.llr', f'{c}__ref_kde_llr') for c in _RATIO_COLS)} FROM frame f {' '.join(f'LEFT JOIN ll_{c} l_{c} ON l_{c}.v = f.{c}' for c in _RATIO_COLS)}""")
def kernel_log_ratio(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "status", "label", *_RATIO_COLS)
    fits = refdist.fit_kernels(archive(frame), _RATIO_COLS, "label")
    return rounded(refdist.add_kernel_log_ratio(frame, fits).select("id", *[f"{c}__ref_kde_llr" for c in _RATIO_COLS]))


# --- correlation, metrics -------------------------------------------------------------------

@query("a22_strong_pairs", f"""WITH {FRAME_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM frame" for a, b in combinations(CONT, 2))})
SELECT a, b, {r('r', 'r')} FROM c WHERE abs(r) > 0.3""")
def strong_pairs(spark, sf_dir):
    pairs = metrics.pearson_pairs(_written(spark, sf_dir, *CONT), CONT)
    return rounded(pairs.filter(F.abs("r") > 0.3).orderBy(F.desc(F.abs("r"))))


@query("a23_spearman", f"""WITH {MEMBERS_SQL}, k AS (SELECT id, {', '.join(
    f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0 AS {m}" for m in MEMBERS)} FROM members)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'rho')} FROM k" for a, b in combinations(MEMBERS, 2))}""")
def spearman(spark, sf_dir):
    from tabweave.operators.blend import rank_columns

    wide = materialize(member_frame(spark, sf_dir).select("id", *MEMBERS), "members")
    ranked = rank_columns(wide, list(MEMBERS), "r_").select(*[F.col(f"r_{m}").alias(m) for m in MEMBERS])
    return rounded(metrics.pearson_pairs(ranked, list(MEMBERS)).withColumnRenamed("r", "rho"))


@query("a24_diversity", f"""WITH {MEMBERS_SQL}, p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM members" for a, b in combinations(MEMBERS, 2))}),
s AS (SELECT a AS member, b AS other, c FROM p UNION ALL SELECT b, a, c FROM p), x AS ({auc_sql('pred', 'score', 'y', ('member',))})
SELECT member, {r('max(c)', 'max_corr')}, {r('min(c)', 'min_corr')}, arg_max(other, c) AS closest, any_value(auc) AS auc
FROM s JOIN x USING (member) GROUP BY member ORDER BY max(c) LIMIT 12""")
def diversity_report(spark, sf_dir):
    from tabweave.operators.members import diversity, member_auc

    wide = materialize(member_frame(spark, sf_dir).select(*MEMBERS), "members")
    solo = member_auc(member_long(spark, sf_dir)).select("member", F.round("auc", 9).alias("auc"))
    report = rounded(diversity(wide, list(MEMBERS)))
    return report.join(solo, "member").orderBy("max_corr").limit(12)


@query("a25_exact_auc", f"WITH {MEMBERS_SQL}, a AS ({auc_sql('pred', 'score', 'y', ('member',))}) SELECT * FROM a")
def exact_auc(spark, sf_dir):
    return rounded(metrics.auc(member_long(spark, sf_dir), "score", "y", ["member"]).select("member", "auc"), 9)


@query("a26_auc_by_slice", f"""WITH {FRAME_SQL}, {MEMBERS_SQL}, s AS (SELECT least({' + '.join(f'({c} IS NULL)::INT' for c in FEATURES)}, 3)::INT AS slice, m_d, members.y
  FROM members JOIN frame USING (id)) {auc_sql('s', 'm_d', 'y', ('slice',))}""")
def auc_by_slice(spark, sf_dir):
    slices = _frame(spark, sf_dir, "id", rw.regime(rw.missing_count(FEATURES)).alias("slice"))
    scored = joins.align(member_frame(spark, sf_dir).select("id", "y", "m_d"), slices)
    return rounded(metrics.auc(scored, "m_d", "y", ["slice"]).select("slice", "auc"), 9)





@query("a27_feature_auc", f"""WITH {FRAME_SQL}, {_TRAIN}, e AS (SELECT id, label, {', '.join(f'coalesce({c}, -999) AS raw_{c}' for c in CONT)},
  {', '.join(f'{oof_sql(c, 5.0)} AS te_{c}' for c in FEATURES)} FROM train), l AS ({melt_sql([*[f'raw_{c}' for c in CONT], *[f'te_{c}' for c in FEATURES]], 'e', 'label')})
{auc_sql('l', 'value', 'label', ('feature',))}""")
def feature_auc(spark, sf_dir):
    train = _written(spark, sf_dir, "id", *FEATURES, "label", "fold", "split").filter(F.col("split") == "train")
    encoded = encode.encode_oof(train, encode.fit_encoding(train, FEATURES, "label", "fold"), "fold", 5.0)
    raw = encoded.withColumns({f"raw_{c}": rw.numeric_or(c) for c in CONT})
    return rounded(metrics.auc_of_columns(raw, [*[f"raw_{c}" for c in CONT], *[f"te_{c}" for c in FEATURES]], "label").select("feature", "auc"), 9)


@query("a28_duplicates", f"""WITH {FRAME_SQL}, g AS (SELECT count(*) AS n FROM frame GROUP BY {', '.join(FEATURES)})
SELECT sum(n - 1)::BIGINT AS duplicates, count(*) FILTER (n > 1)::BIGINT AS groups FROM g""")
def duplicates(spark, sf_dir):
    return profile.duplicate_count(_frame(spark, sf_dir, *FEATURES), FEATURES)


@query("a29_granularity", f"""WITH {FRAME_SQL}, l AS ({melt_sql(CONT, 'frame', 'id')}), d AS (SELECT DISTINCT feature, value FROM l WHERE value IS NOT NULL),
s AS (SELECT feature, value - lag(value) OVER (PARTITION BY feature ORDER BY value) AS step FROM d)
SELECT feature, (SELECT count(*) FROM d WHERE d.feature = s.feature)::BIGINT AS n_distinct,
  {r('(SELECT avg((abs(value - round_even(value, 0)) < 1e-9)::INT) FROM l WHERE l.feature = s.feature AND value IS NOT NULL)', 'integer_share')},
  {r('min(step)', 'min_step')}, {r('max(step)', 'max_step')}, {r('median(step)', 'median_step')} FROM s GROUP BY feature""")
def granularity(spark, sf_dir):
    return rounded(profile.granularity(_written(spark, sf_dir, *CONT), CONT))


_CURVE_COLS = ["total_k", "acctbal", "qty"]


@query("a30_monotonic_curves", f"""WITH {FRAME_SQL}, e AS (SELECT {', '.join(f"{_edge_list(c, 10, 'frame')} AS e_{c}" for c in _CURVE_COLS)}),
b AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {_bin_sql(c, f'e_{c}', '<')} AS bin, label FROM frame, e WHERE {c} IS NOT NULL" for c in _CURVE_COLS)}),
c AS (SELECT feature, bin, avg(label::DOUBLE) AS rate FROM b GROUP BY ALL),
d AS (SELECT feature, rate - lag(rate) OVER (PARTITION BY feature ORDER BY bin) AS s FROM c),
v AS (SELECT feature, avg((s >= 0)::INT) AS up, avg((s <= 0)::INT) AS down FROM d WHERE s IS NOT NULL GROUP BY feature)
SELECT feature, {r('up', 'rising_share')}, {r('down', 'falling_share')}, CASE WHEN up >= 0.8 THEN 'rising' WHEN down >= 0.8 THEN 'falling' ELSE 'mixed' END AS verdict FROM v""")
def monotonic_curves(spark, sf_dir):
    frame = _written(spark, sf_dir, *_CURVE_COLS, "label")
    return rounded(profile.monotonic_verdict(profile.rate_curve(frame, _CURVE_COLS, "label")))


@query("a31_value_rates", f"""WITH {FRAME_SQL} SELECT qty AS value, count(*)::BIGINT AS n, {r('avg(label::DOUBLE)', 'rate')} FROM frame
WHERE qty IS NOT NULL GROUP BY qty HAVING count(*) > 50 AND count(*) < 500""")
def value_rates(spark, sf_dir):
    return rounded(profile.value_rates(_frame(spark, sf_dir, "qty", "label"), "qty", "label", 50, 500))


@query("a32_residual_identity", f"""WITH {FRAME_SQL}, x AS (SELECT split, total_k - (qty_r + qty_a + qty_n) AS v FROM frame)
SELECT split, count(v)::BIGINT AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM x WHERE v IS NOT NULL GROUP BY split""")
def residual_identity(spark, sf_dir):
    return rounded(profile.residual_identity(_frame(spark, sf_dir, WHOLE, *PARTS, "split"), WHOLE, PARTS, ["split"]))


@query("a33_prediction_quality", f"""WITH {FRAME_SQL}, x AS (SELECT split, qty AS t, coalesce(qty_r, 0) * 3 AS p FROM frame WHERE qty IS NOT NULL)
SELECT split, {r('1 - avg((t - p) * (t - p)) / var_pop(t)', 'r2')}, {r('corr(t, p)', 'pearson_r')} FROM x GROUP BY split""")
def prediction_quality(spark, sf_dir):
    scored = _frame(spark, sf_dir, "split", "qty", (F.coalesce("qty_r", F.lit(0.0)) * 3).alias("pred")).filter(F.col("qty").isNotNull())
    return rounded(metrics.regression_quality(scored, "qty", "pred", ["split"]))


@query("a34_class_balance", f"""WITH {FRAME_SQL}, c AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM frame)
SELECT p::BIGINT AS n_pos, n::BIGINT AS n_neg, {r('n / p::DOUBLE', 'neg_pos_ratio')}, {r('(p + n) / (2.0 * p)', 'balanced_weight_pos')},
  {r('(p + n) / (2.0 * n)', 'balanced_weight_neg')} FROM c""")
def class_balance(spark, sf_dir):
    return rounded(metrics.class_balance(_frame(spark, sf_dir, "label"), "label"))


@query("a35_focal_loss", f"""WITH {MEMBERS_SQL}, p AS (SELECT least(greatest(CASE WHEN y = 1 THEN m_a ELSE 1 - m_a END, 1e-9), 1 - 1e-9) AS pt, y FROM members)
SELECT {r('avg(-0.5 * pow(1 - pt, 2) * ln(pt))', 'focal_loss')} FROM p""")
def focal_loss(spark, sf_dir):
    return rounded(metrics.focal_loss(member_frame(spark, sf_dir), "m_a", "y", 2.0))


@query("a36_fold_seed_mean", f"""WITH {MEMBERS_SQL}, s AS (SELECT id, avg(floor(score * 1e9)) AS m FROM pred WHERE member IN ('m_a', 'm_b', 'm_c') GROUP BY id)
SELECT id, {r('m', 'score', 3)}, {r('(rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / (SELECT count(*) FROM s)::DOUBLE', 'rank', 6)} FROM s""")
def fold_seed_mean(spark, sf_dir):
    from tabweave.operators.blend import rank_columns

    seeds = ["m_a", "m_b", "m_c"]
    # Whole billionths, so that sums are exact and equal means are equal in any order.
    pred = member_long(spark, sf_dir).filter(F.col("member").isin(*seeds)).withColumn("score", F.floor(F.col("score") * 1e9).cast("double"))
    mean = materialize(metrics.fold_mean(pred, ["id"]), "mean")
    ranked = rank_columns(mean, ["score"], "rank_", pct=True)
    return ranked.select("id", F.round("score", 3).alias("score"), F.round("rank_score", 6).alias("rank"))


@query("a37_extended_coverage", f"""WITH {FRAME_SQL}, x AS (SELECT {EXTENDED_SQL} AS e, total_k - (qty_r + qty_a + qty_n) AS c FROM frame)
SELECT count(*)::BIGINT AS n_rows, count(c)::BIGINT AS n_complete, count(e)::BIGINT AS n_extended, (count(e) - count(c))::BIGINT AS n_gained,
  {r('count(e) / count(*)::DOUBLE', 'share')} FROM x""")
def extended_coverage(spark, sf_dir):
    frame = extended_frame(spark, sf_dir)
    complete = rw.all_present([WHOLE, *PARTS])
    extended = F.col("extended").isNotNull()
    return rounded(
        frame.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete"), F.count_if(extended).alias("n_extended"),
            F.count_if(extended & ~complete).alias("n_gained"), (F.count_if(extended) / F.count(F.lit(1))).alias("share"),
        )
    )


# --- folds and ranks -------------------------------------------------------------------------

@query("d1_average_rank", f"""WITH {FRAME_SQL} SELECT id, {', '.join(
    f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE AS r_{c}" for c in ('total_x', 'qty_x'))}
FROM (SELECT id, coalesce(total_k, -1) AS total_x, coalesce(qty, -1) AS qty_x FROM frame)""")
def average_rank(spark, sf_dir):
    from tabweave.operators.blend import rank_columns

    filled = materialize(
        order_frame(spark, sf_dir).select("id", F.coalesce("total_k", F.lit(-1.0)).alias("total_x"), F.coalesce("qty", F.lit(-1.0)).alias("qty_x")), "frame"
    )
    return rank_columns(filled, ["total_x", "qty_x"]).select("id", "r_total_x", "r_qty_x")


@query("d3_stratified_folds", f"""WITH {FRAME_SQL} SELECT id, label,
  ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) - 1) % 5)::BIGINT AS fold FROM frame""")
def stratified_fold(spark, sf_dir):
    return stratified_folds(_frame(spark, sf_dir, "id", "label"), "id", "label", 5)


@query("d4_value_steps", f"""WITH {FRAME_SQL}, l AS ({melt_sql(['qty', 'disc', 'acctbal'], 'frame', 'id')}), d AS (SELECT DISTINCT feature, value FROM l WHERE value IS NOT NULL),
s AS (SELECT feature, value, value - lag(value) OVER (PARTITION BY feature ORDER BY value) AS step FROM d)
SELECT feature, {r('value', 'value')}, {r('step', 'step')}, sign(step)::DOUBLE AS direction FROM s WHERE step IS NOT NULL""")
def value_steps(spark, sf_dir):
    cols = ["qty", "disc", "acctbal"]
    return rounded(profile.steps(_frame(spark, sf_dir, *cols), cols).withColumn("direction", F.signum("step")))


@query("d5_stratified_holdout", f"""WITH {FRAME_SQL} SELECT id, label,
  CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) - 1) % 10 = 0 THEN 'holdout' ELSE 'fit' END AS part FROM frame""")
def stratified_holdout(spark, sf_dir):
    folds = stratified_folds(_frame(spark, sf_dir, "id", "label"), "id", "label", 10)
    return folds.select("id", "label", F.when(F.col("fold") == 0, "holdout").otherwise("fit").alias("part"))


# --- model inputs -------------------------------------------------------------------------------

def _scale_sql(c: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}) FROM train))"
    return r(f"({filled} - (SELECT avg({filled}) FROM train)) / (SELECT stddev_pop({filled}) FROM train)", f"z_{c}")


@query("e1_fill_and_scale", f"WITH {FRAME_SQL}, {_TRAIN} SELECT id, {', '.join(_scale_sql(c) for c in CONT)} FROM frame")
def fill_and_scale(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "split", *CONT)
    fitted = prep.fit_fill_scale(frame.filter(F.col("split") == "train"), CONT)
    return rounded(frame.select("id", *[e.alias(n) for n, e in prep.fill_scale(fitted).items()]))


@query("e2_missing_mask", f"WITH {FRAME_SQL} SELECT id, {', '.join(f'({c} IS NULL)::INT::DOUBLE AS miss_{c}' for c in FEATURES)} FROM frame")
def missing_mask(spark, sf_dir):
    return _frame(spark, sf_dir, "id", *[e.alias(n) for n, e in prep.mask_block(FEATURES).items()])


@query("e3_category_index", f"WITH {FRAME_SQL} SELECT id, {', '.join(f'''(dense_rank() OVER (ORDER BY coalesce({c}, 'missing')) - 1)::BIGINT AS cat_{c}''' for c in CATS)} FROM frame")
def category_index(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", *CATS)
    return prep.category_index(frame, CATS).select("id", *[f"cat_{c}" for c in CATS])


_PRIO = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "missing"]
_SEG = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing"]


@query("e4_one_hot", f"""WITH {FRAME_SQL} SELECT id, {', '.join(f'''(coalesce(prio, 'missing') = '{v}')::INT::DOUBLE AS "prio={v}"''' for v in _PRIO)},
  {', '.join(f'''(coalesce(seg, 'missing') = '{v}')::INT::DOUBLE AS "seg={v}"''' for v in _SEG)} FROM frame""")
def one_hot(spark, sf_dir):
    frame = _written(spark, sf_dir, "id", "prio", "seg")
    vocab = prep.fit_one_hot(frame, ["prio", "seg"])
    return frame.select("id", *[e.alias(n) for n, e in prep.one_hot(vocab).items()])


@query("p18_sampled_residual", f"""WITH {FRAME_SQL}, s AS (SELECT total_k - (qty_r + qty_a + qty_n) AS v FROM frame
  WHERE total_k IS NOT NULL AND qty_r IS NOT NULL AND qty_a IS NOT NULL AND qty_n IS NOT NULL ORDER BY md5('1:' || id), id LIMIT 1000)
SELECT count(*)::BIGINT AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM s""")
def sampled_residual(spark, sf_dir):
    complete = materialize(_frame(spark, sf_dir, "id", WHOLE, *PARTS).dropna(subset=[WHOLE, *PARTS]), "complete")
    return rounded(profile.residual_identity(seeded_sample(complete, "id", 1000, seed=1), WHOLE, PARTS))
