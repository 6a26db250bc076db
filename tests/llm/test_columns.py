"""Columns of documents whose names the operators use themselves, in every stage that returns documents."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tabweave.llm import decontaminate, mixing, ngram_join, quality, suffix_dedup

NAMES = ["_id", "_key", "_cuts", "_score", "_mix", "_source", "_taken", "_size", "_same", "_turn", "_left", "_c", "_t_key", "node", "component", "label", "words", "mix", "__id", "_ID2"]


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in NAMES]).cache()


@pytest.mark.parametrize("stage", [ngram_join.keep_one_of_each_group, suffix_dedup.remove_repeats, mixing.mixed_texts, lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "lorem ipsum dolor lorem")], "item_id long, text string"))])
def test_clashing_columns_pass_through(wide, docs, stage):
    out = stage(wide)
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    slim = stage(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, slim.select("doc_id", "text").collect()))
    assert out.filter(" or ".join(f"`{n}` <> concat('{n}:', coalesce(string(doc_id), ''))" for n in NAMES)).count() == 0


def test_the_quality_stage_keeps_clashing_columns(spark, wide, tmp_path):
    labels = spark.createDataFrame([(r["doc_id"], int(r["doc_id"] % 2)) for r in wide.filter("doc_id is not null").select("doc_id").distinct().collect()], "doc_id long, quality int")
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.quality(spark, wide, folder)
    assert out.columns == wide.columns and out.filter("_score <> concat('_score:', coalesce(string(doc_id), ''))").count() == 0
    assert set(quality.score(wide, quality.fit_on_labels(wide, labels), "_mine").columns) >= {"_mine"}


def test_sets_that_share_a_common_passage_only_are_not_linked(spark):
    common = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"{common} " + " ".join(f"own{i}x{j}" for j in range(14 + i % 5))) for i in range(150)]
    rows += [(1_000 + i, f"{common} " + " ".join(f"twin{i // 2}x{j}" for j in range(40)) + (" tail" if i % 2 else "")) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert got == least and len(set(got.values())) == 150 + 30
