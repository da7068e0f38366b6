"""Stages on the smallest tables: what each keeps, and the columns that it returns."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from travelfields.llm import ngram_join, quality, queries
from travelfields.llm.text import words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.classify_quality(spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    near = corpus_pipeline.drop_near_copies(spark, kept, SF).cache()
    comp = {r.component_id for r in ngram_join.jaccard_groups(kept).collect()}
    assert {r.doc_id for r in near.select("doc_id").collect()} == comp
    cut = corpus_pipeline.remove_repeated_passages(spark, near, SF).cache()
    count = Counter()
    for r in cut.collect():
        b = r.text.encode()
        assert r.n_chars == len(r.text) and "�" not in r.text
        count.update({b[i : i + 200] for i in range(len(b) - 199)})
    assert cut.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, cut, SF).cache()
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert mixed.columns == docs.columns and max(copies.values()) <= 2
    total = sum(len(words(r.text)) for r in cut.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) < 0.15 * total
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF)
    assert packed.where("start = 0").count() == mixed.count()
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_clean_labels_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = queries.good_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    out = quality.classify(docs, good, F.col("source"), F.col("lang"), F.col("doc_id")).join(good.where("good"), "doc_id")
    assert out.where("keep").count() >= 0.95 * out.count()
