"""Deterministic pseudo-random columns built from md5, identical in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(key: Column, seed: int = 42, tag: str = "") -> Column:
    """32-bit non-negative BIGINT from ``seed:tag:key``."""
    prefix = f"{seed}:{tag}:" if tag else f"{seed}:"
    digest = F.md5(F.concat(F.lit(prefix), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_mod(key: Column, modulus: int, seed: int = 42, tag: str = "") -> Column:
    return F.pmod(portable_hash(key, seed, tag), F.lit(modulus))


def hidden(value: Column, key: Column, prob: float, seed: int = 42, tag: str = "") -> Column:
    """``value`` with a share ``prob`` of the observed cells set to NULL; NULL stays NULL."""
    return F.when(hash_mod(key, 10_000, seed, tag) >= int(round(prob * 10_000)), value)
