"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from brightline.plans import catalogue

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(TABLES))
    said = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, said.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_stay_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "brightline.llm", None)
    with pytest.warns(UserWarning, match="training-data"):
        assert set(entry.queries()) == set(catalogue.queries())


def test_a_cluster_without_a_shared_folder_is_refused():
    from brightline.functions.materialise import CHECKPOINT_KEY, shared_dir

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert shared_dir(Session(**{CHECKPOINT_KEY: "hdfs:/shared/", "spark.master": "yarn"})) == "hdfs:/shared"
    assert shared_dir(Session(**{"spark.master": "local[2]"})).startswith("/tmp")
    with pytest.raises(ValueError, match="share"):
        shared_dir(Session(**{"spark.master": "spark://host:7077"}))
