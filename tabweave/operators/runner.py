"""Runs of named variants that can be broken off and taken up again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabweave.operators.metrics import auc

JOURNAL = "variant string, params string, auc double, n_rows long, seconds double, scores string, written_at long"


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """The journal of a folder: one row for each variant that was finished, the newest if there are several."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/journal")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], JOURNAL)
    rows = spark.read.schema(StructType.fromDDL(JOURNAL)).parquet(f"{folder}/journal")
    rest = [c for c in rows.columns if c != "variant"]
    return rows.groupBy("variant").agg(F.max_by(F.struct(*rest), "written_at").alias("r")).select("variant", "r.*")


def run_variants(
    spark: SparkSession, folder: str, variants: dict[str, tuple[dict, Callable[[dict], DataFrame]]], again: tuple[str, ...] = ()
) -> DataFrame:
    """Scores every variant that the journal in ``folder`` doesn't have yet, and returns the journal of those named.

    ``variants`` maps a name to its parameters and a function from them to scored rows (id, label, score, ..).  A
    variant's scores are written first and its journal row last, each once; so a run that is
    ended at any point, or a lost driver, costs the variant at hand.  A variant whose parameters differ from
    those of the journal is run anew, as are those in ``again``.
    """
    done = {r["variant"]: r["params"] for r in finished(spark, folder).collect()}  # one row a variant
    for name, (params, build) in variants.items():
        text = json.dumps(params, sort_keys=True)
        if done.get(name) == text and name not in again:
            continue
        start, at = time.time(), time.time_ns()
        scores = f"{folder}/scores/{name}-{at}"
        build(params).write.parquet(scores)
        row = auc(spark.read.parquet(scores), "score", "label").first()
        n = spark.read.parquet(scores).count()
        entry = (name, text, None if row is None else row["auc"], n, round(time.time() - start, 3), scores, at)
        spark.createDataFrame([entry], JOURNAL).coalesce(1).write.mode("append").parquet(f"{folder}/journal")
    return finished(spark, folder).filter(F.col("variant").isin(list(variants)))
