"""Registered query of HTML extraction. SQL has no tree builder; tests check rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reefline.llm import html_text


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_extract": op10_html_extract}
ORACLES: dict[str, str] = {}
