"""Fold, split and sample assignment as columns computed from the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.hashing import hash_mod, portable_hash
from tabweave.operators.ordering import row_index


def hash_fold(key: Column, k: int, seed: int = 42, tag: str = "fold") -> Column:
    """Fold number in 0..k-1 from the key alone: no shuffle, stable under re-reads."""
    return hash_mod(key, k, seed, tag)


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Exactly balanced folds: within each class fold sizes differ by at most one row.

    Rows are ordered by the md5 of the key inside their class and dealt out in turn.  Only keys and
    labels are ordered; other columns come back by the key, which must be unique.
    """
    shuffled = df.select(key, label).withColumn("_md5", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    dealt = row_index(shuffled, ["_md5", key], [label], "_pos")
    fold = F.pmod(F.col("_pos"), F.lit(k)).cast("bigint").alias(name)
    if set(df.columns) == {key, label}:
        return dealt.select(*df.columns, fold)
    folds = dealt.select(F.col(key).alias("_fold_key"), fold)
    return df.drop(name).join(folds, F.col(key) == F.col("_fold_key")).drop("_fold_key")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by hash order.

    A hash threshold first cuts the table down to little more than ``n`` candidates, in the
    scan; only those are ordered.  The threshold is widened until it holds ``n`` rows, so
    the result is exactly the first ``n`` in hash order.
    """
    total = df.count()
    prefix = portable_hash(F.col(key), seed)  # the leading digits of the digest: same order
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    share = min(1.0, (n + 6 * n**0.5 + 10) / max(total, 1))
    while share < 1.0 and df.filter(prefix < int(share * 2**32)).count() < n:
        share = min(1.0, share * 2)
    near = df if share >= 1.0 else df.filter(prefix < int(share * 2**32))
    return near.orderBy(digest, key).limit(n)
