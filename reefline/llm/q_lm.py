"""Registered query of language-model scoring. SQL can't train a network; tests check its likelihood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reefline.llm import lm


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm.score(docs, lm.train(docs))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLES: dict[str, str] = {}
