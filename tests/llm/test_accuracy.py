"""Held-out accuracy of the trained operators, on a table with enough labels."""

import pytest
from pyspark.sql import functions as F

from lorebase.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_toxicity(spark, labels):
    t = QUERIES["op5_toxicity"](spark, SF_DIR).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in t}
    assert n[1, 1] >= 0.93 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.03 * (n[0, 0] + n.get((0, 1), 0))


def test_language(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    t = QUERIES["op10_language_id"](spark, SF_DIR).filter("held_out").join(docs, "doc_id").filter("lang is not null")
    assert t.filter("lang = lang_pred").count() >= 0.98 * t.count()


def test_quality(spark, labels):
    t = QUERIES["op4_quality_classifier"](spark, SF_DIR).filter("held_out").join(labels, "doc_id")
    good, bad = t.filter("quality = 1"), t.filter("quality = 0")
    assert good.filter("kept").count() >= 0.97 * good.count()
    assert bad.filter("kept").count() <= 0.3 * bad.count()
    grades = {r.quality: r.g for r in t.groupBy("quality").agg(F.avg("expected_grade").alias("g")).collect()}
    assert grades[1] > grades[0] + 0.8
