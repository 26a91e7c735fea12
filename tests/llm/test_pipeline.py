"""The pipeline over the smallest tables, stage by stage."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightline.functions.materialise import materialise
from brightline.llm import queries

TABLES = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, TABLES), "t")
        if name != "mixing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "secrets":
            assert docs.count() == before.count()
            assert not any(re.search(r'token = "[0-9a-f]{40}"', r.text) for r in docs.collect())
    assert docs.count() == before.count() and docs.where("taken > 0").count() > 0


def test_columns_of_any_name_pass_the_quality_stage(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    clashing = ["own_0", "OWN_1", "__key", "__log_weight", "key", "log_weight", "c0", "__id"]
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clashing)))
    kept = corpus_pipeline.keep_quality(spark, wide, TABLES)
    assert kept.columns == wide.columns
    plain = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, TABLES).collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == plain and all(tuple(r)[-len(clashing) :] == tuple(range(len(clashing))) for r in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, TABLES).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    said = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    assert sorted(said.fetchall(), key=repr) == sorted((tuple(r) for r in queries.queries()[name](spark, TABLES).select(*columns).collect()), key=repr)
