"""Imports every plan module so that its queries are registered."""

from tabweave.plans import blending, modelling, proofs, rows, scans, statistics  # noqa: F401
from tabweave.plans.catalog import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
