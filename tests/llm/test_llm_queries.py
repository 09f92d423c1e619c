"""The registered queries and the pipeline on the smallest given tables."""

from __future__ import annotations

import zlib

import corpus_pipeline
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from starloom.llm.queries import QUERIES, SQL, table
from starloom.session import materialize

FOLDER = "/root/testdata/sf0.001"


def fold(doc_id: int, divisor: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.mark.parametrize("name", SQL)
def test_query_against_sql(spark, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(SQL[name]).df()) is None


def test_folds_of_the_classifiers(spark):
    rows = QUERIES["op5_language_id"](spark, FOLDER).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    truth = {r.doc_id: r.lang for r in table(spark, FOLDER, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    rows = QUERIES["op10_quality_classifier"](spark, FOLDER).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, docs, FOLDER))
        names.append(name)
        if name == "packing":
            continue
        assert kept.columns == docs.columns
        assert kept.exceptAll(docs).isEmpty() or name == "mixing"
        if name == "mixing":
            assert kept.select("doc_id").distinct().count() == docs.count()
        docs = kept
    assert names == ["language", "quality", "near_duplicates", "mixing", "packing"]
    pieces = kept.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    copies = docs.groupBy("doc_id").agg(F.count("*").alias("copies"))
    assert pieces.join(copies, "doc_id").where("n <> doc_tokens * copies").isEmpty()
    assert pieces.count() == copies.count()
    padded = kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert padded[0] <= 2048
