"""The pipeline stage by stage, and the registered queries with SQL."""

import os
import sys
from pathlib import Path

import pytest
from oracle import connect, differences

import corpus_pipeline
from tabweave.llm.common import CHECKS, QUERIES, keep
from tabweave.llm.queries import QUERIES as REGISTERED

ROOT = Path(__file__).resolve().parents[2]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTERED) == list(range(1, 14)) and REGISTERED is QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), CHECKS[name]) == []


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packed":
            assert out.columns == columns and out.dtypes == docs.dtypes
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now <= ids
        if name == "quality":
            assert all(d not in labels or labels[d] == 1 for d in now) or sum(labels.get(d, 1) for d in now) / max(1, sum(d in labels for d in now)) > 0.95
            assert sum(labels.get(d, 0) == 1 for d in now) >= 0.95 * sum(v == 1 for v in labels.values())
        docs, ids = out, now
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_entry_registers_and_survives_without_the_optional_part():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert {"pipeline", *QUERIES} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(ROOT / "tabweave" / "llm")
