"""Every registered query with check SQL gives the SQL's columns, types, rows and values.

Proofs of the same kind train many models; one of each kind is run here, the others too if ``ALL_QUERIES`` is set.
"""

import os

import pytest
from oracle import connect, differences

from tabweave.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


KINDS = {f"{op}_proof" for op in ("m1", "m4", "m6", "m7", "m10", "m12", "m13", "m18", "m21", "m22", "o2")}
NAMES = sorted(n for n in registry.CHECKS if not n.endswith("_proof") or n in KINDS or os.environ.get("ALL_QUERIES"))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), con, registry.CHECKS[name]) == []


def test_every_check_has_a_query():
    assert set(registry.CHECKS) <= set(registry.QUERIES)
