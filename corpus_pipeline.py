"""A corpus pipeline from five of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import pipeline

STAGES = pipeline.STAGES

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table of documents."""
    return pipeline.run(spark, sf_dir)
