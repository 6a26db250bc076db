"""The order frame: one row per order with nullable usage-like columns, built from the tables.

Nine continuous columns (a whole, three parts of it and others), three categories, two
labels and a split, so every operator has a table of the shape it is meant for.  Cells are
hidden by hash so that missingness is the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.hashing import hash_mod, hidden
from tabweave.operators.folds import hash_fold

WHOLE = "total_k"
PARTS = ["qty_r", "qty_a", "qty_n"]
CONT = ["total_k", "acctbal", "qty", "qty_r", "qty_a", "qty_n", "lines", "disc", "tax"]
CATS = ["prio", "seg", "nation"]
FEATURES = [*CONT, *CATS]
DECIMALS = ["total_k", "acctbal", "disc", "tax"]
# Ratio name -> (numerator, divisor).
RATIOS = {
    "ratio_bal_total": ("acctbal", "total_k"),
    "ratio_total_lines": ("total_k", "lines"),
    "ratio_n_total": ("qty_n", "total_k"),
    "ratio_r_total": ("qty_r", "total_k"),
    "ratio_disc_total": ("disc", "total_k"),
    "ratio_r_lines": ("qty_r", "lines"),
    "ratio_bal_lines": ("acctbal", "lines"),
    "ratio_a_total": ("qty_a", "total_k"),
    "ratio_tax_total": ("tax", "total_k"),
    "ratio_tax_lines": ("tax", "lines"),
    "ratio_disc_lines": ("disc", "lines"),
    "ratio_n_lines": ("qty_n", "lines"),
    "ratio_disc_tax": ("disc", "tax"),
}
# Share of cells hidden per column.
HIDDEN = {"total_k": 0.14, "acctbal": 0.08, "disc": 0.10, "tax": 0.12, "prio": 0.08, "seg": 0.06, "nation": 0.05}
ARCHIVE_STATUS = "P"


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """Scan of a table; a file too small or unsplittable to keep the cores busy is spread by ``key``.

    Any table with at least as many splits as cores is scanned as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if key and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        df = df.repartition(spark.sparkContext.defaultParallelism, key)
    return df


def order_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty_of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    items = table(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.max("l_discount").alias("disc"),
        F.max("l_tax").alias("tax"),
        qty_of("R").alias("qty_r"),
        qty_of("A").alias("qty_a"),
        qty_of("N").alias("qty_n"),
    )
    orders, customer = table(spark, sf_dir, "orders", "o_orderkey"), table(spark, sf_dir, "customer")
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey, "left").join(
        customer, orders.o_custkey == customer.c_custkey, "left"
    )
    key = F.col("o_orderkey")
    raw: dict[str, Column] = {
        "total_k": F.floor(F.col("o_totalprice") / 10).cast("double") / 100,
        "acctbal": F.col("c_acctbal"),
        **{c: F.col(c) for c in ("qty", "qty_r", "qty_a", "qty_n", "lines", "disc", "tax")},
        "prio": F.col("o_orderpriority"),
        "seg": F.col("c_mktsegment"),
        "nation": F.col("c_nationkey").cast("string"),
    }
    cells = [(hidden(e, key, HIDDEN[c], tag=c) if c in HIDDEN else e).alias(c) for c, e in raw.items()]
    return joined.select(
        key.alias("id"),
        *cells,
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("placed"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        ((F.coalesce(F.col("qty"), F.lit(0.0)) > 100) | (F.col("o_totalprice") > 250_000)).cast("int").alias("label"),
        F.when(hash_mod(key, 10, tag="split") < 7, "train").otherwise("test").alias("split"),
        hash_fold(key, 10).alias("fold"),
    )


def archive(frame: DataFrame) -> DataFrame:
    """The labelled reference table: orders of the archive status."""
    return frame.filter(F.col("status") == ARCHIVE_STATUS)


def current(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("status") != ARCHIVE_STATUS)


# Pseudo members: weight of the label in the score, and optional rounding grid that forces ties.
MEMBERS = {"m_a": (0.30, 0), "m_b": (0.20, 0), "m_c": (0.10, 0), "m_d": (0.25, 20), "m_e": (0.0, 0), "m_f": (0.40, 8)}


def member_score(member: str, key: Column, y: Column) -> Column:
    """Deterministic score in (0, 1): a hash of the id pulled towards the label."""
    w, grid = MEMBERS[member]
    noise = (hash_mod(key, 1_000_003, tag=member) + 1) / F.lit(1_000_005.0)
    s = F.lit(1 - w) * noise + F.lit(w) * (F.lit(0.1) + F.lit(0.8) * y)
    return (F.floor(s * grid) + 1) / F.lit(grid + 1.0) if grid else s


def member_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, split, fold and one column per pseudo member, over all orders (a pure projection)."""
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    key = F.col("o_orderkey")
    y = (F.col("o_orderstatus") == "F").cast("int")
    return orders.select(
        key.alias("id"), y.alias("y"),
        F.when(hash_mod(key, 10, tag="split") < 7, "train").otherwise("test").alias("split"),
        hash_fold(key, 10).alias("fold"),
        *[member_score(m, key, y).alias(m) for m in MEMBERS],
    )


def member_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred(id, y, split, member, score)."""
    return member_frame(spark, sf_dir).unpivot(["id", "y", "split", "fold"], list(MEMBERS), "member", "score")


# --- the same frames for the SQL side --------------------------------------------------

def sql_hash(key: str, tag: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:{tag}:' || {key}), 1, 8))::BIGINT"


def sql_hidden(expr: str, col: str) -> str:
    return f"CASE WHEN {sql_hash('o_orderkey', col)} % 10000 >= {int(round(HIDDEN[col] * 10000))} THEN {expr} END"


FRAME_SQL = f"""items AS (
  SELECT l_orderkey, sum(l_quantity) AS qty, count(*)::DOUBLE AS lines, max(l_discount) AS disc, max(l_tax) AS tax,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n
  FROM lineitem GROUP BY l_orderkey),
frame AS MATERIALIZED (
  SELECT o_orderkey AS id,
         {sql_hidden("floor(o_totalprice / 10) / 100", "total_k")} AS total_k,
         {sql_hidden("c_acctbal", "acctbal")} AS acctbal,
         qty, qty_r, qty_a, qty_n, lines,
         {sql_hidden("disc", "disc")} AS disc,
         {sql_hidden("tax", "tax")} AS tax,
         {sql_hidden("o_orderpriority", "prio")} AS prio,
         {sql_hidden("c_mktsegment", "seg")} AS seg,
         {sql_hidden("c_nationkey::VARCHAR", "nation")} AS nation,
         o_orderstatus AS status, o_orderdate AS placed,
         (o_orderstatus = 'F')::INT AS y,
         (coalesce(qty, 0) > 100 OR o_totalprice > 250000)::INT AS label,
         CASE WHEN {sql_hash('o_orderkey', 'split')} % 10 < 7 THEN 'train' ELSE 'test' END AS split,
         {sql_hash('o_orderkey', 'fold')} % 10 AS fold
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)"""


def _sql_member(m: str) -> str:
    w, grid = MEMBERS[m]
    noise = f"(({sql_hash('o_orderkey', m)} % 1000003) + 1) / 1000005.0::DOUBLE"
    y = "(o_orderstatus = 'F')::INT"
    s = f"({1 - w!r}::DOUBLE * ({noise}) + {w!r}::DOUBLE * (0.1::DOUBLE + 0.8::DOUBLE * {y}))"
    return f"(floor({s} * {grid}) + 1) / {grid + 1.0!r}::DOUBLE AS {m}" if grid else f"{s} AS {m}"


MEMBERS_SQL = f"""members AS MATERIALIZED (
  SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS y,
         CASE WHEN {sql_hash('o_orderkey', 'split')} % 10 < 7 THEN 'train' ELSE 'test' END AS split,
         {sql_hash('o_orderkey', 'fold')} % 10 AS fold,
         {", ".join(_sql_member(m) for m in MEMBERS)}
  FROM orders),
pred AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT id, y, split, fold, '{m}' AS member, {m} AS score FROM members" for m in MEMBERS)})"""
