"""Registered query of SimHash near-duplicates. SQL has no XXH64, so tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import simhash


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLES: dict[str, str] = {}
