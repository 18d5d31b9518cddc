"""Registered query of best-fit packing. SQL has no tokenizer; tests check the sequences themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reefline.llm import packing


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
