"""Operators for groups too large for a task, and joins by cells and bins, against plain computations."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brightline.operators import nearest as near
from brightline.operators.core import gap_sessions
from brightline.operators.selection import exact_medians


@pytest.mark.parametrize("slab", [1, 50, 10**7])
def test_sessions_do_not_depend_on_slabs(spark, slab):
    r = random.Random(2)
    rows = [("hot", t, i) for i, t in enumerate(sorted(r.randrange(20000) for _ in range(900)))]
    rows += [("hot", t, 900 + i) for i, t in enumerate(range(30000, 31000, 20))]  # one session over many slabs
    rows += [("b", 5, 2000), ("b", 5, 2001), ("b", 26, 2002), (None, 7, 2003), (None, 27, 2004), ("c", -45, 2005), ("c", -25, 2006), ("d", None, 2007), ("d", 3, 2008)]
    want, before, start = {}, {}, {}
    for k, t, i in sorted(rows, key=lambda x: (x[0] or "", x[1] if x[1] is not None else -math.inf, x[2])):
        if t is None:
            want[i] = None
            continue
        start[k] = t if k not in before or t - before[k] > 20 else start[k]
        before[k], want[i] = t, start[k]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    assert {x.id: x.session_start for x in gap_sessions(df, ["k"], "t", 20, ["id"], slab).collect()} == want


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    df = spark.range(40000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("k"), (F.col("id") * 40).alias("t"), "id")
    out = gap_sessions(df, ["k"], "t", 100, ["id"], 20000)
    dealt = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(x["count"] for x in dealt) < 3 * 40000 / 4
    assert out.where("k = -1").select("session_start").distinct().count() == 1


def test_medians_by_selection(spark):
    r = random.Random(3)
    groups = {
        "hot": [r.gauss(0, 1e6) for _ in range(3001)], "even": [float(r.randrange(50)) for _ in range(400)], "one": [2.5], "same": [7.0] * 9, "wide": [10.0**k for k in range(-300, 300, 7)], "two": [-1.0, 1e300],
        "narrow": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)], "tiny": [0.0, 5e-324, 1e-323, 1.5e-323],
    }
    rows = [(k, v, "x") for k, vs in groups.items() for v in vs] + [("none", None, "x"), (None, 4.0, "x"), (None, None, "x"), ("one", math.nan, "x"), ("one", math.inf, "x")]
    r.shuffle(rows)
    got = {x.k: x.m for x in exact_medians(spark.createDataFrame(rows, "k string, v double, n string"), ["k"], "v", "m").collect()}
    assert got == {**{k: statistics.median(v) for k, v in groups.items()}, "none": None, None: 4.0}
    assert exact_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_equals_all_pairs(spark, k):
    r = random.Random(5)
    places = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(150, 90.0, 0.0), (151, -90.0, 50.0), (152, 0.0, 180.0), (153, 0.0, -180.0), (154, None, 1.0)]
    among = [(i, r.gauss(40, 0.5), r.gauss(179.9, 0.5)) for i in range(150)] + [(150 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(20)] + [(170, 10.0, 10.0), (171, 10.0, 10.0), (172, 1.0, None)]
    on = lambda y, x: (math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y)))
    got = defaultdict(list)
    for row in near.nearest(spark.createDataFrame(places, "p long, lat double, lon double"), spark.createDataFrame(among, "o long, lat double, lon double"), "p", "o", k).orderBy("p", "rank").collect():
        got[row.p].append(row.o)
    for p, y, x in places[:-1]:
        away = sorted((round(math.dist(on(y, x), on(b, a)), 9), o) for o, b, a in among if a is not None)
        assert [round(math.dist(on(y, x), on(*among[o][1:])), 9) for o in got[p]] == [d for d, _ in away[:k]]
    empty = spark.createDataFrame([], "o long, lat double, lon double")
    assert near.nearest(spark.createDataFrame(places, "p long, lat double, lon double"), empty, "p", "o", k).count() == 0


def test_overlapping_intervals_equal_all_pairs(spark):
    r = random.Random(8)
    make = lambda n: [(i, s := r.randrange(-5000, 5000), s + r.choice([0, 1, 7, 64, 65, 3000, -3])) for i in range(n)]
    a, b = make(150), make(150) + [(150, -10**6, 10**6), (151, None, 4)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, from_s long, to_s long")
    got = Counter((x.i, x.j) for x in near.overlapping(frame(a, "i"), frame(b, "j"), "i", "j").collect())
    assert got == Counter((i, j) for i, s, e in a for j, t, f in b[:-1] if s <= e and t <= f and s <= f and t <= e)
    assert near.overlapping(frame(a, "i").limit(0), frame(b, "j"), "i", "j").count() == 0


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_overlaps_written_from_blocks_equal_all_pairs(spark, monkeypatch, bits):
    monkeypatch.setattr(near, "LEAST_BITS", min(bits, 6))
    monkeypatch.setattr(near, "MOST_BITS", bits)
    r = random.Random(10)
    make = lambda n: [(i, s := r.choice([0, 0, 500, r.randrange(-900, 900)]), s + r.choice([0, 1, 40, 700, -1])) for i in range(n)]
    a, b = make(90) + [(90, -(2**63), 2**63 - 1), (91, None, 3)], make(120) + [(None, 0, 600), (120, -(2**63), -(2**63)), (121, 2**63 - 1, 2**63 - 1), (121, 2**63 - 1, 2**63 - 1)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, from_s long, to_s long")
    got = Counter((x.i, x.j) for x in near.overlapping(frame(a, "i"), frame(b, "j"), "i", "j").collect())
    assert got == Counter((i, j) for i, s, e in a[:-1] for j, t, f in b if s <= e and t <= f and s <= f and t <= e)


def test_overlaps_at_one_instant_are_dealt_to_many_tasks(spark):
    at = lambda n, key, to: spark.range(n).select(F.col("id").alias(key), F.lit(1000).alias("from_s"), F.lit(to).alias("to_s"))
    out = near.overlapping(at(30, "i", 1000), at(4000, "j", 1000).repartition(1), "i", "j")
    dealt = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 30 * 4000 and max(dealt) < sum(dealt) / 2


@pytest.mark.parametrize("size", [2, 7, 10**6])
def test_blocks_pair_each_row_of_a_cell_once(spark, monkeypatch, size):
    import numpy as np

    from brightline.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", size)
    make = lambda n, k: spark.range(n).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("c"), F.col("id").alias(k))
    judge = lambda l, r: np.nonzero((l.field("i").to_numpy()[:, None] + r.field("j").to_numpy()) % 4 == 0)
    met = blocks.paired(make(150, "i"), make(90, "j"), ["c"], (F.lit(1), F.lit(1)), judge, ["i"], ["j"])
    cell = lambda k: 0 if k % 3 else k % 5
    assert Counter((x.i, x.j) for x in met.collect()) == Counter((i, j) for i in range(150) for j in range(90) if cell(i) == cell(j) and (i + j) % 4 == 0)
    if size == 7:  # the cell that most rows are in is not one task's
        assert met.withColumn("t", F.spark_partition_id()).where("i % 3 > 0").select("t").distinct().count() > 1


@pytest.mark.parametrize("chunk", [1, 4, 1024])
def test_first_later_pass_of_a_rectangle(spark, monkeypatch, chunk):
    from brightline.plans import areas

    monkeypatch.setattr(areas, "CHUNK", chunk)
    r = random.Random(9)
    passes = [("S", float(r.randrange(2)), 0.0, r.randrange(40), i) for i in range(70)]
    held = areas.schedules(spark.createDataFrame(passes, "satellite string, west double, south double, at_s long, s_suppkey long"))
    assert held.agg(F.max(F.size("passes"))).first()[0] <= chunk
    met = held.crossJoin(spark.range(-2, 43).withColumnRenamed("id", "t")).where("t < until AND (since IS NULL OR t >= since)")
    got = [(x.west, x.t, tuple(x.p)) for x in met.select("west", "t", areas.first_later(F.col("passes"), F.col("t")).alias("p")).collect()]
    later = lambda w, t: [(at, i) for _, west, _, at, i in passes if west == w and at > t]
    assert Counter(got) == Counter((w, t, min(later(w, t))) for w in (0.0, 1.0) for t in range(-2, 43) if later(w, t))
