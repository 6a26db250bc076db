"""A training corpus from raw documents: quality, near duplicates, repeated passages, source mix, packed sequences.

Every stage takes all rows that the one before kept, is written as Parquet and read again.  Columns beside doc_id, text,
source and n_chars pass through all stages but the last, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import free_names, keep, table
from tabweave.llm.mixing import mixed_texts
from tabweave.llm.ngram_join import keep_one_of_each_group
from tabweave.llm.packing import pack_documents
from tabweave.llm.quality import fit_on_labels, score
from tabweave.llm.suffix_dedup import remove_repeats

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine gives at least even odds of label 1; null and empty texts get a score too."""
    m = fit_on_labels(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    (odds,) = free_names(docs, "odds")
    return score(docs, m, odds).filter(F.col(odds) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.75; all without words or id stay."""
    return keep_one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier document has; what is left without words goes."""
    return remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources at weights 5, 2, 1 takes them, three times at most; those without words go, a null source is the last."""
    return mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 4096; longer texts are cut, empty ones hold their end mark."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packed", packed)]

#: The first stage is a trained model, so there is no SQL; the operators of the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = keep(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
