"""Streams over many files in random order: what they give does not depend on how rows fall into batches."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from brightline.plans import catalogue, streams

EVENTS = "/root/testdata/sf0.001/events.parquet"
NAMES = ["st_revision_state", "st_session_stream", "st_dedupe_content", "st_dedupe_watermark"]


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events in 90 files, of random rows each, whose names, and so the order in which the stream reads them, are random as well."""
    at = tmp_path_factory.mktemp("events")
    spark.read.parquet(EVENTS).withColumn("part", (F.xxhash64("event_id") % 45).cast("int")).repartition(90, "event_id").drop("part").write.parquet(f"{at}/w")
    (at / "events.parquet").mkdir()
    files = sorted((at / "w").glob("part-*.parquet"))
    random.Random(7).shuffle(files)
    for i, f in enumerate(files):
        f.rename(at / "events.parquet" / f"part-{i:05}.parquet")
    return str(at), len(files)


@pytest.mark.parametrize("name", NAMES)
def test_order_of_files_is_of_no_effect(spark, shuffled, monkeypatch, name):
    at, files = shuffled
    assert files > 60
    whole = streams.stream_of
    monkeypatch.setattr(streams, "stream_of", lambda s, d, n: whole(s, d, n, 30))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{EVENTS}'")
    said = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    got = catalogue.queries()[name](spark, at).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(said.fetchall())
