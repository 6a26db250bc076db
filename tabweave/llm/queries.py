"""Imports every operator module so that its query is registered."""

from tabweave.llm import ann, conversations, decontaminate, mixing, ngram_join, packing, pitman_yor, quality, rans, sharding, spelling, suffix_dedup, vector_join  # noqa: F401
from tabweave.llm.common import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
