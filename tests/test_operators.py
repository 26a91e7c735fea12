"""Operators on literal rows: edges, ties and empty input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brightline.functions import geo, values
from brightline.operators.core import as_of, chain_violations, gap_sessions, keyset_page


def test_gap_sessions_are_chained_and_close_at_the_gap(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 600, 2), ("a", 1200, 3), ("a", 1801, 4), ("b", 5, 5)], "k string, t long, id long")
    got = {r.id: r.session_start for r in gap_sessions(df, ["k"], "t", 600, ["id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1801, 5: 5}


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 9), (2, 10)], "k long, t long")
    right = spark.createDataFrame([(1, 10, 7), (1, 10, 8), (1, 3, 5)], "k long, u long, v long")
    got = {(r.k, r.t): r.asof_v for r in as_of(left, right, ["k"], "t", "u", ["v"], ["v"]).collect()}
    assert got == {(1, 10): 8, (1, 9): 5, (2, 10): None}


def test_keyset_page(spark):
    df = spark.createDataFrame([(3, 1), (3, 2), (2, 9), (1, 1)], "t long, id long")
    page = keyset_page(df, [("t", True), ("id", True)], (3, 2), 2)
    assert [(r.t, r.id, r.has_more) for r in page.orderBy(F.desc("t"), F.desc("id")).collect()] == [(3, 1, True), (2, 9, True)]
    assert keyset_page(df.limit(0), [("t", True)], None, 2).count() == 0


def test_chain_violations(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 4, 6), ("b", 2, 1)], "c string, v int, t long")
    assert {(r.c, r.v, r.reason) for r in chain_violations(df, "c", "v", "t").collect()} == {("a", 2, "time-regression"), ("a", 4, "version-gap"), ("b", 2, "version-gap")}


def test_geodesy(spark):
    df = spark.createDataFrame([(0.0, 179.5, 0.0, -179.5), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    a, b, c, d = (F.col(x) for x in "abcd")
    near, same = df.select(geo.haversine(a, b, c, d).alias("km"), geo.bearing(a, b, c, d).alias("deg")).collect()
    assert abs(near.km - 111.195) < 0.01 and abs(near.deg - 90) < 1e-9
    assert same.km == 0 and same.deg is None


def test_values(spark):
    df = spark.createDataFrame([("1542",), ("7",), ("12:05",), ("2460",), (None,)], "s string")
    assert [r[0] for r in df.select(values.acquisition_minutes(F.col("s"))).collect()] == [942, None, 725, None, None]
    df = spark.createDataFrame([("1.5",), ("1e3",), ("-.5",), ("x",)], "s string")
    assert [r[0] for r in df.select(values.finite_strict(F.col("s"))).collect()] == [1.5, None, -0.5, None]
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.125,)], "x double")
    assert [r[0] for r in df.select(values.js_round(F.col("x"))).collect()] == [-2.0, 3.0, 0.0]


def test_bearing_between_antipodes_is_null(spark):
    from brightline.functions import geo

    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (0.0, 0.0, 0.000001, 180.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 90.0), (0.0, 0.0, 1.0, 179.0)], "a double, b double, c double, d double")
    got = [r.x for r in rows.select(geo.bearing(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(90.0) and got[4] is not None


def test_strict_fields():
    from brightline.functions.parsing import decoded, strict_fields

    assert strict_fields('a,"b ""c"", d",') == ["a", 'b "c", d', ""] and strict_fields("") == [""]
    assert [strict_fields(x) for x in ('a"b', '"a" b', '"a', None)] == [None] * 4
    assert decoded("&#0;&#x110000;&lt;&zz;<![CDATA[<&amp;]]>") == "��<<&" and decoded(None) is None


def test_small_functions_on_odd_values(spark):
    from brightline.functions import instants, values

    text = spark.createDataFrame([("2024-03-31T01:00:00Z",), ("2024-02-30T01:00:00Z",), ("2024-01-01T00:00:00+14:01",), ("",), (None,), ("12",)], "t string")
    assert [r.x for r in text.select(instants.zoned_instant(F.col("t")).alias("x")).collect()] == [1711846800, None, None, None, None, None]
    assert [r.x for r in text.select(instants.mixed_instant(F.col("t")).alias("x")).collect()][-1] == 12
    numbers = spark.createDataFrame([(" 1e3 ",), ("NaN",), ("-Infinity",), ("",), (None,), ("0x1",)], "t string")
    assert [r.x for r in numbers.select(values.finite(F.col("t")).alias("x")).collect()] == [1000.0, None, None, None, None, None]
    walls = spark.createDataFrame([(1698550200,), (1698540000,), (1679801400,)], "w long")  # an hour shown twice, one shown once, one never shown
    assert [r.x for r in walls.select(instants.wall_instant(F.col("w")).alias("x")).collect()] == [None, 1698540000 - 10800, None]


@pytest.mark.parametrize("repeated", [False, True])
def test_counts_without_a_shuffle_of_words(spark, tmp_path, repeated):
    import duckdb

    from brightline.plans import catalogue

    text = "a b c d e f g h i j a z é Z z  y\tx x x " + "w " * 300
    rows = [(1, text), (2, None), (3, ""), (4, "one two"), (None, text + "q"), (5, "x " * 30)] + ([(1, "a b c " * 9), (1, "z a " * 20 + "new z"), (None, "k " * 11 + "l"), (4, "one")] if repeated else [])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.queries()["map_subtract"](spark, str(tmp_path))
    assert sorted(map(str, (tuple(x) for x in got.select("doc_id", "n", "kept").collect()))) == sorted(map(str, c.execute(catalogue.oracle_sql()["map_subtract"]).fetchall()))
    if not repeated:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
