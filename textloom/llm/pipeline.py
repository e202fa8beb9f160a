"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all rows
of `docs` and returns a DataFrame; all but the last return the columns of documents.

Null texts are kept until a stage's own rule removes them; rows that share an id share
the fate of that id; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontam, jaccard, quality, suffix


def _stage(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, in no more files than its rows are worth."""
    return common.merged(out.select(*docs.columns), docs=docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    rejected = quality.classify(docs, common.labels(spark, sf_dir)).where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return _stage(docs.join(rejected, "doc_id", "left_anti"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return _stage(jaccard.keep_one(docs, 5, 80, 100), docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 100-byte strings repeat from earlier places."""
    return _stage(suffix.remove_repeats(docs), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _stage(decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of the remaining texts."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written and read again, and
    what a stage wrote besides it is removed."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before = docs
        with common.scratch():
            docs = common.materialize(stage(spark, before, sf_dir), f"stage-{name}")
        common.release(before)
    return docs
