"""Joins against fitted tables, safe for hot keys and NULL keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.session import materialize

# Fitted tables are broadcast only up to this many rows in all (counted, not guessed).
BROADCAST_ROWS = 200_000
# A key is hot when it holds at least 1/HOT_PARTS of the weight: at most HOT_PARTS keys can be.
HOT_PARTS = 2_000
# Buckets the rows of hot keys are spread over.
SALTS = 1_024


def _match(rows_on: Sequence[Column], table_on: Sequence[str]) -> Column:
    cond = None
    for left, right in zip(rows_on, table_on, strict=True):
        one = left.eqNullSafe(F.col(right))
        cond = one if cond is None else cond & one
    return cond


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: dict[str, Column],
    take: Sequence[str],
    weight: str | None = None,
    n_table: int | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Left join bringing ``take`` from a written table with unique keys; NULL equals NULL.

    ``on`` maps key columns of the table to expressions over the rows.  The table's rows
    are counted first (or the count is passed as ``n_table``).  Small: broadcast, so the
    rows are not shuffled.  Large: keys whose ``weight`` is at least 1/HOT_PARTS of the
    total (at most HOT_PARTS of them, by counting) are broadcast; the rows they match keep
    their key but get a salt no table row has, so a key holding a third of all rows is
    spread over the shuffle instead of landing in one task.
    """
    keys = list(on)
    slim = table.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys], *[F.col(c).alias(f"_v_{c}") for c in take],
        *([F.col(weight).alias("_t_w")] if weight else []),
    )
    cond = _match([on[k] for k in keys], [f"_t_{k}" for k in keys])
    kept = list(rows.columns)
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if (slim.count() if n_table is None else n_table) <= limit:
        joined = rows.join(F.broadcast(slim.drop("_t_w")), cond, "left")
        return joined.select(*kept, *[F.col(f"_v_{c}").alias(c) for c in take])
    if weight is None:  # adaptive skew join splits swollen partitions
        return rows.join(slim, cond, "left").select(*kept, *[F.col(f"_v_{c}").alias(c) for c in take])
    total = slim.agg(F.sum("_t_w")).first()[0]
    is_hot = F.col("_t_w") * HOT_PARTS >= F.lit(total)
    hot = slim.filter(is_hot).drop("_t_w").withColumns({f"_h_{c}": F.col(f"_v_{c}") for c in take}).withColumn("_is_hot", F.lit(True))
    hot = hot.drop(*[f"_v_{c}" for c in take])
    cold = slim.filter(~is_hot).drop("_t_w").withColumn("_t_salt", F.lit(-1))
    spread = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in kept]), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    tagged = rows.join(F.broadcast(hot), cond, "left").drop(*[f"_t_{k}" for k in keys]).withColumn("_salt", spread)
    joined = tagged.join(cold, cond & (F.col("_salt") == F.col("_t_salt")), "left")
    value = lambda c: F.when(F.col("_is_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_v_{c}")).alias(c)
    return joined.select(*kept, *[value(c) for c in take])


def lookup_many(
    rows: DataFrame,
    table: DataFrame,
    cells: dict[str, dict[str, Column]],
    take: dict[str, dict[str, str]],
    weight: str,
    sizes: dict[str, int],
    key: str = "id",
    base: DataFrame | None = None,
) -> DataFrame:
    """Values of many features from one written table (feature, keys.., values..): small features by broadcast, all others by one join.

    ``cells`` has, per feature, the table's key columns and the expressions over ``rows`` they are compared with (NULL equals
    NULL), ``take`` the value columns and the names they get, ``sizes`` the table's rows.  Features are broadcast from
    the smallest on while all of them together stay under ``BROADCAST_ROWS``.  The others become narrow rows (key, feature, cell),
    are joined once on (feature, cell), hot cells salted, and come back by ``key``, which must be unique.  So the
    exchanges do not grow with the number of features, and the wide rows move once.  ``base`` is a written table
    with the same keys to take the cells from, when ``rows`` is a widened view of it.  Without a ``key``
    column each large feature is joined by itself.
    """
    room, out, large = BROADCAST_ROWS, rows, []
    for f in sorted(cells, key=lambda f: (sizes.get(f, 0), f)):
        n = sizes.get(f, 0)
        room -= n
        if room < 0:
            large.append(f)
            continue
        out = _one_feature(out, table, f, cells[f], take[f], weight, n, n)
    if not large:
        return out
    source = rows if base is None else base
    if key not in source.columns:
        for f in large:
            out = _one_feature(out, table, f, cells[f], take[f], weight, sizes[f], 0)
        return out
    types = dict(table.dtypes)
    keys = list(dict.fromkeys(k for f in large for k in cells[f]))
    values = list(dict.fromkeys(v for f in large for v in take[f]))
    cell = lambda f: [cells[f].get(k, F.lit(None)).cast(types[k]).alias(f"_c_{k}") for k in keys]
    narrow = source.select(F.col(key).alias("_key"), F.inline(F.array(*[F.struct(F.lit(f).alias("_feature"), *cell(f)) for f in large])))
    mine = table.filter(F.col("feature").isin(large)).select("feature", *keys, *values, weight)
    found = lookup(narrow, mine, {"feature": F.col("_feature"), **{k: F.col(f"_c_{k}") for k in keys}}, values, weight, sum(sizes[f] for f in large), 0)
    wide = found.groupBy("_key").agg(*[F.max(F.when(F.col("_feature") == f, F.col(v))).alias(n) for f in large for v, n in take[f].items()])
    return out.join(wide, F.col(key) == F.col("_key"), "left").drop("_key")


def _one_feature(rows: DataFrame, table: DataFrame, feature: str, cell: dict[str, Column], take: dict[str, str], weight: str, n: int, limit: int) -> DataFrame:
    extra = [weight] if weight not in take else []
    part = table.filter(F.col("feature") == feature).select(*cell, *extra, *[F.col(v).alias(name) for v, name in take.items()])
    return lookup(rows, part, cell, list(take.values()), take.get(weight, weight), n, limit)


def sizes_by(table: DataFrame, key: str = "feature") -> dict[str, int]:
    """Rows per feature of a written table (one row per feature is collected)."""
    return {r[key]: r["count"] for r in table.groupBy(key).count().collect()}


def null_safe_anti_join(left: DataFrame, right: DataFrame, numeric: Sequence[str], other: Sequence[str], digits: int = 8) -> DataFrame:
    """Rows of ``left`` with no equal row in ``right`` on all columns (numbers rounded, NULL equals NULL).

    ``left`` is the small reference table as a rule, and only the right side of an anti join
    can be broadcast.  So the right table is first cut down to keys the left has, by a
    semi join that scans it without a shuffle while the left keys fit a broadcast, and the
    anti join then meets that remainder.
    """
    names = [f"_a_{c}" for c in [*numeric, *other]]
    key = [F.round(F.col(c), digits) for c in numeric] + [F.col(c) for c in other]
    wanted = materialize(left.select(*[k.alias(n) for k, n in zip(key, names, strict=True)]).distinct(), "keys")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    shared = materialize(
        right.select(*[k.alias(n.replace("_a_", "_b_")) for k, n in zip(key, names, strict=True)])
        .join(wanted, _match([F.col(n.replace("_a_", "_b_")) for n in names], names), "left_semi").distinct(),
        "shared",
    )
    return left.join(shared, _match(key, [n.replace("_a_", "_b_") for n in names]), "left_anti")


def override(rows: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """Replace ``value`` for the keys present in ``patch`` (unique keys), keep the others."""
    new = patch.select(F.col(key).alias("_p_key"), F.col(value).alias("_p_value"))
    return (
        rows.join(new, F.col(key) == F.col("_p_key"), "left")
        .withColumn(value, F.coalesce("_p_value", value))
        .drop("_p_key", "_p_value")
    )


def align(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner equi-join of two keyed tables (the positional alignment of score vectors)."""
    return left.join(right, key, "inner")


def group_deviation(train: DataFrame, rows: DataFrame, group: str, cols: Sequence[str], suffix: str) -> DataFrame:
    """Column minus its group mean fitted on ``train``; NULL where the group is NULL or unseen."""
    stats = materialize(
        train.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in cols]),
        "groupstats",
    )
    joined = lookup(rows, stats, {group: F.col(group)}, [f"_m_{c}" for c in cols] + ["_n"], weight="_n")
    return joined.select(
        *rows.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(f"{c}{suffix}") for c in cols]
    )
