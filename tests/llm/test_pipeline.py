"""The pipeline on a small corpus, each stage on its own input."""

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from reefline.llm import simhash
from tests.llm.test_free import _hits
from tests.llm.test_native import _dedupe


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 120")
    labels = pd.read_parquet(f"{small}/labels.parquet").set_index("doc_id")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.toPandas(), docs.schema).cache()
        before, after = ({r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in (docs, rows))
        texts[name] = (before, after)
        docs = rows
    before, after = texts["toxicity"]
    clean = [i for i in before if i in labels.index and labels.toxic[i] == 0]
    assert sum(i in after for i in clean) >= 0.85 * len(clean)  # some sixty labelled texts to learn from
    before, after = texts["line_dedup"]
    assert after == _dedupe(sorted(before.items()))
    before, after = texts["simhash_dedup"]
    groups = simhash.groups(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()
    assert set(after) == {r.component_id for r in groups}
    before, after = texts["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for i, t in before.items():
        n, hit, _ = _hits(t, items)
        assert (i in after) == (not (hit > 0 and 20 * hit >= n))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == len(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
