"""Footprint geometry against computations of another kind: sampling of points, all pairs, spherical distances."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightline.functions import rings
from brightline.functions.clipping import clipped, clipped_arrow, signed_area, uncut
from brightline.operators import blocks, passes, planar
from brightline.operators.spatial import covered_later, covering, intersecting
from brightline.plans.footprints import geojson, reached_together
from brightline.sources.extents import footprints, read_extents


def parity(polygon, x, y):
    odd = False
    for ring in polygon:
        for (a, b), (c, d) in zip(ring, ring[1:], strict=False):
            odd ^= (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a
    return odd


def star(r, lon, lat, size, n):
    """A concave ring that does not cross itself, around (lon, lat)."""
    turns = sorted(r.random() for _ in range(n))
    ring = [(lon + size * (0.3 + r.random()) * math.cos(2 * math.pi * t), lat + size / 2 * (0.3 + r.random()) * math.sin(2 * math.pi * t)) for t in turns]
    return [*ring, ring[0]]


def test_clipping_keeps_what_was_inside():
    r = random.Random(1)
    for _ in range(200):
        lon, lat = r.choice([-175, 0, 172, 180]) + r.random() * 9, r.uniform(-60, 60)
        outer = star(r, lon, lat, r.choice([3, 20]), 9)
        holes = [[(lon + 0.05 * a, lat + 0.05 * b) for a, b in ((-1, -1), (1.3, -1), (0.7, 1), (-1, -1))]] if parity([outer], lon - 0.05, lat) and all(parity([outer], lon + a, lat + b) for a in (-0.08, 0.08) for b in (-0.08, 0.08)) else []
        found = clipped((outer, 0, None), [(h, 0, None) for h in holes])
        assert sum(signed_area(ring[:-1]) for p in found for ring in p) == pytest.approx(abs(signed_area(outer[:-1])) - sum(abs(signed_area(h[:-1])) for h in holes))
        for p in found:
            assert signed_area(p[0][:-1]) > 0 and all(signed_area(h[:-1]) < 0 for h in p[1:])
            assert all(ring[0] == ring[-1] and all(-180 <= x <= 180 for x, _ in ring) for ring in p)
        for _ in range(60):
            x, y = lon + r.uniform(-25, 25), lat + r.uniform(-12, 12)
            here = (x + 180) % 360 - 180
            assert any(parity(p, here, y) for p in found) == parity([outer, *holes], x, y)


def test_rings_round_a_pole():
    line = [(10.0, 60.0), (100.0, 65.0), (190.0, 60.0), (280.0, 62.0), (370.0, 60.0)]
    hole = [(x, y + 20) for x, y in line]
    whole, ring, south = clipped((line, 1, 90.0), []), clipped((line, 1, 90.0), [(hole, 1, 90.0)]), clipped(([(-x, -y) for x, y in line], -1, -90.0), [])
    assert [len(p) for p in (*whole, *ring, *south)] == [1, 1, 1]
    assert parity(whole[0], 0, 89) and parity(whole[0], 179.9, 70) and parity(whole[0], -179.9, 70) and not parity(whole[0], 0, 40)
    assert parity(ring[0], 0, 70) and not parity(ring[0], 0, 89)
    assert parity(south[0], 100, -89) and not parity(south[0], 100, 89)
    small = [(172.0, 75.0), (188.0, 75.0), (180.0, 80.0), (172.0, 75.0)]  # a hole over the antimeridian becomes part of the border
    cut = clipped((line, 1, 90.0), [(small, 0, None)])
    assert not parity(cut[0], 179.0, 76) and not parity(cut[0], -179.0, 76) and parity(cut[0], 170, 76)
    with pytest.raises(ValueError, match="hole"):
        clipped(([(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 0.0)], 0, None), [([(50.0, 0.0), (55.0, 0.0), (55.0, 5.0), (50.0, 0.0)], 0, None)])


def extent(*polygons, boxes=None, holes=()):
    ring = lambda points: {"Points": [{"Longitude": x, "Latitude": y} for x, y in points]}
    g = {}
    if polygons:
        g["GPolygons"] = [{"Boundary": ring(p), **({"ExclusiveZone": {"Boundaries": [ring(h) for h in holes]}} if holes else {})} for p in polygons]
    if boxes:
        g["BoundingRectangles"] = [dict(zip(("WestBoundingCoordinate", "SouthBoundingCoordinate", "EastBoundingCoordinate", "NorthBoundingCoordinate"), b, strict=True)) for b in boxes]
    return json.dumps({"HorizontalSpatialDomain": {"Geometry": g}})


SQUARE = [(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)]


def test_why_an_extent_has_no_footprint(spark):
    cap = [(0, 70), (90, 70), (180, 70), (-90, 70), (0, 70)]
    cases = [
        (None, "unreadable"), ("{", "unreadable"), ("{}", "unreadable"), (extent(), "no-geometry"), (extent(SQUARE, boxes=[(0, 0, 1, 1)]), "mixed-encodings"), (extent(SQUARE), ""),
        (extent(SQUARE[:-1]), "open-ring"), (extent([(0, 0), (1, 1), (0, 0), (1, 1), (0, 0)]), "few-points"), (extent([(-90, 0), (90, 0), (90, 10), (-90, 0)]), "no-way-round"),
        (extent([(0, 0), (5, 5), (5, 0), (0, 5), (0, 0)]), "self-crossing"), (extent([(0, 0), (5, 0), (3, 0), (0, 0)]), "flat"), (extent(cap[::-1]), "winding"), (extent(cap), ""),
        (extent([(0, 70), (90, -70), (180, 70), (-90, 70), (0, 70)]), "no-way-round"), (extent(SQUARE, [(10, 10), (11, 10), (11, 11), (10, 10)]), ""), (extent(boxes=[(170, 0, -170, 5)]), ""),
        (extent(boxes=[(0, 5, 10, 5)]), "no-way-round"), (extent(boxes=[(7, 0, 7, 5)]), "no-way-round"), (extent(SQUARE, holes=[[(1, 1), (2, 1), (2, 2), (1, 1)]]), ""),
        (extent(SQUARE, holes=[[(0, 60), (90, 60), (180, 60), (-90, 60), (0, 60)]]), "other-pole"), (extent(SQUARE, holes=[[(20, 1), (22, 1), (22, 2), (20, 1)]]), "rings-cross"),
        (extent([(0, 0), (None, 0), (5, 5), (0, 5), (0, 0)]), "no-way-round"), (extent([]), "open-ring"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, extent string")
    got = {r.id: r for r in footprints(read_extents(rows)).select("id", "reason", geojson(F.col("polygons")).alias("json")).collect()}
    assert [got[i].reason for i in range(len(cases))] == [reason for _, reason in cases]
    assert [got[i].json is None for i in range(len(cases))] == [bool(reason) for _, reason in cases]
    box = json.loads(got[15].json)
    assert box["type"] == "MultiPolygon" and sorted(min(x for x, _ in p[0]) for p in box["coordinates"]) == [-180, 170]
    assert json.loads(got[5].json) == {"type": "Polygon", "coordinates": [[[0, 0], [5, 0], [5, 5], [0, 5], [0, 0]]]}


def crosses(p, q):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return any(
        side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for a, b in zip(p, p[1:], strict=False) for c, d in zip(q, q[1:], strict=False)
    )


def test_polygons_that_intersect_equal_all_pairs(spark):
    r = random.Random(3)
    make = lambda n: [star(r, r.uniform(-165, 165), r.uniform(-70, 70), r.choice([0.2, 4, 14]), r.randint(4, 12)) for _ in range(n)]
    a, b = make(60), make(60)
    b += [[(x + 0.01, y) for x, y in a[0]], a[1], [(-179.0, -85.0), (179.0, -85.0), (179.0, 85.0), (-179.0, 85.0), (-179.0, -85.0)]]  # shifted, the same, around all
    frame = lambda shapes, key: spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in s], 0) for i, s in enumerate(shapes)], f"{key} int, ring array<{rings.POINT}>, x int").withColumn("edges", rings.ring_edges(F.col("ring")))
    got = {(p.i, p.j) for p in intersecting(frame(a, "i"), frame(b, "j"), ["i"], ["j"]).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p == q or crosses(p, q) or parity([q], *p[0]) or parity([p], *q[0])}
    assert intersecting(frame(a, "i").limit(0), frame(b, "j"), ["i"], ["j"]).count() == 0


def test_discs_covered_on_the_sphere(spark):
    """Caps as rings of many points: a disc is covered if it is no farther from the cap's centre than the radii differ."""
    r, caps, discs = random.Random(6), [], []
    there = lambda lat, lon, turn, d: (
        math.degrees(math.asin(math.sin(lat) * math.cos(d) + math.cos(lat) * math.sin(d) * math.cos(turn))),
        math.degrees(lon + math.atan2(math.sin(turn) * math.sin(d) * math.cos(lat), math.cos(d) - math.sin(lat) * math.sin(math.asin(math.sin(lat) * math.cos(d) + math.cos(lat) * math.sin(d) * math.cos(turn))))),
    )
    for i in range(24):
        lat, lon, size = math.radians(r.choice([-89, -80, 0, 30, 60, 88])), math.radians(r.choice([-179.5, 0, 100, 179.9])), math.radians(r.choice([2, 9, 14]))
        points = [there(lat, lon, -2 * math.pi * k / 180, size) for k in range(180)]
        caps.append((i, lat, lon, size, [((x + 180) % 360 - 180, y) for y, x in points]))
        for _ in range(12):
            y, x = there(lat, lon, r.random() * 7, size * r.uniform(0, 1.2))
            discs.append((len(discs), y, (x + 180) % 360 - 180, size * r.choice([0.01, 0.3])))
    text = spark.createDataFrame([(i, 1, extent([*p, p[0]])) for i, _, _, _, p in caps], "cap int, k int, extent string")
    shapes = read_extents(text).select("cap", "k", "reason", F.explode("shapes").alias("shape"))
    assert shapes.where("reason = ''").count() == len(caps)
    places = spark.createDataFrame([(i, 1, y, x, d) for i, y, x, d in discs], "disc int, k int, lat double, lon double, radius double")
    got = {(p.disc, p.cap) for p in covering(places, shapes, ["k"]).collect()}
    want, close = set(), set()
    for i, y, x, d in discs:
        for c, lat, lon, size, _ in caps:
            away = math.acos(max(-1, min(1, math.sin(lat) * math.sin(math.radians(y)) + math.cos(lat) * math.cos(math.radians(y)) * math.cos(lon - math.radians(x)))))
            if away + d <= size:
                want.add((i, c))
            if abs(away + d - size) < size * 0.002:
                close.add((i, c))  # the ring's chords lie a little within the cap
    assert got - close == want - close and len(want) > 80


def test_discs_covered_by_later_passes_equal_pairs(spark, monkeypatch):
    """Against the pairs that covering() writes: many discs of a place, radii up to the edge, passes of several shapes, at equal times, discs twice; in one block and in many."""
    r = random.Random(12)
    ring = lambda x, y, w, h: [(x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h), (x - w, y - h)]
    turned = lambda points: [((x + 180) % 360 - 180, y) for x, y in points]
    centres = [(0.0, 0.0), (179.5, 40.0), (-179.9, -60.0), (60.0, 80.0)]
    at = [(i, *r.choice(centres), r.randrange(-60, 200), r.choice("ab")) for i in range(90)]
    shapes = [(i, k, t, extent(*(turned(ring(x + r.uniform(-3, 3), y + r.uniform(-3, 3), r.uniform(1, 5), r.uniform(1, 5))) for _ in range(r.choice([1, 1, 2]))))) for i, x, y, t, k in at]
    near = [(x + r.choice([0, 0, r.uniform(-2, 2)]), y + r.choice([0, 0, r.uniform(-2, 2)])) for x, y in centres * 6]
    discs = [(i, r.choice("ab"), (p := r.choice(near))[1], (p[0] + 180) % 360 - 180, math.radians(r.choice([0.01, 1.0, 1.5, 2.0])), r.randrange(-80, 150)) for i in range(160)]
    discs += [(i, k, y, x, d, t + 20) for i, k, y, x, d, t in discs[:30]] + discs[30:40] + [(900, "a", 0.0, None, 0.1, 3), (901, None, 0.0, 0.0, 0.1, 3)]
    p = read_extents(spark.createDataFrame(shapes, "pass long, k string, u long, extent string")).where("reason = ''").select("pass", "k", "u", "shapes")
    d = spark.createDataFrame(discs, "disc long, k string, lat double, lon double, radius double, t long")
    pairs = covering(d, p.select("pass", "k", "u", F.explode("shapes").alias("shape")), ["k"]).where("u > t AND u <= t + 120").select("disc", "pass", "u").distinct().collect()
    want = {i: (len(of := [(x.u, x["pass"]) for x in pairs if x.disc == i]), min(of)[1]) for i in {x.disc for x in pairs}}
    assert len(want) > 60 and max(n for n, _ in want.values()) > 4
    for block, stream in ((1 << 14, 1 << 17), (1, 9)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        monkeypatch.setattr(blocks, "STREAM", stream)
        got = covered_later(d, p, ["k"], "disc", "pass", ("t", "u"), 120).collect()
        assert {x.disc: (x.n, x["first"]) for x in got} == want and len(got) == len(want)
    assert covered_later(d.limit(0), p, ["k"], "disc", "pass", ("t", "u"), 120).count() == 0 == covered_later(d, p.limit(0), ["k"], "disc", "pass", ("t", "u"), 120).count()


@pytest.mark.parametrize("pairs", [50, 1 << 20])
def test_a_place_with_many_discs_and_passes_is_a_row_a_disc(monkeypatch, pairs):
    monkeypatch.setattr(passes, "PAIRS", pairs)
    n = 400
    discs = pa.array([{"id_": i, "t_": i * 7 % 50, "lat": 1.0, "lon": 2.0, "radius": 0.001 if i % 2 else 0.2} for i in range(n)])
    square = lambda size: [[[{"x": 2.0 + a * size, "y": 1.0 + b * size} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]]
    size = lambda i: 5.0 if i % 4 == 0 else 20.0  # noqa: E731  the smaller ones cover the discs of odd numbers only
    late = sorted((i * 11 % 90, i) for i in range(n))
    rows = pa.array([{"id_": i, "t_": t, "boxes": [{"w": 2.0 - size(i), "s": 1.0 - size(i), "e": 2.0 + size(i), "n": 1.0 + 1.2 * size(i)}], "lines_": square(size(i))} for t, i in late])
    tally = passes.Tally(discs, 30)
    tally.take(rows.slice(0, 150))
    tally.take(rows.slice(150))
    got = {i: (k, at, first) for b in tally.rows() for i, k, at, first in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = {i: [(t, j) for t, j in late if i * 7 % 50 < t <= i * 7 % 50 + 30 and (i % 2 or j % 4)] for i in range(n)}
    assert got == {i: (len(of), *min(of)) for i, of in want.items() if of}


def as_rows(shapes, key):
    edges = lambda s: [{"x1": float(a), "y1": float(b), "x2": float(c), "y2": float(d)} for ring in s for (a, b), (c, d) in zip(ring, ring[1:], strict=False)]
    rows = []
    for i, s in enumerate(shapes):
        xs, ys = zip(*(p for ring in s for p in ring), strict=True)
        rows.append({key: i, "edges_": edges(s), "like_": hash(str(s)), "w_": float(min(xs)), "s_": float(min(ys)), "e_": float(max(xs)), "n_": float(max(ys)), "fx_": True, "fy_": True})
    return pa.array(rows)


def test_inner_boxes_lie_within():
    r, shapes = random.Random(21), []
    for _ in range(150):
        lon, lat, size = r.uniform(-170, 170), r.uniform(-80, 80), r.choice([1e-4, 0.3, 8])
        outer = star(r, lon, lat, size, r.randint(4, 12))
        hole = [(lon + size * a / 50, lat + size * b / 50) for a, b in ((-1, -1), (1.3, -1), (0.7, 1), (-1, -1))]
        shapes.append([outer, hole] if r.random() < 0.5 and all(parity([outer], x, y) for x, y in hole) and not crosses(outer, hole) else [outer])
    shapes += [[[(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]], [[(0, 0), (9, 9), (9.0001, 9), (0, 0)]]]
    rows = as_rows(shapes, "i")
    w, s, e, n = planar.inner_boxes(planar.Lists(rows.field("edges_"), "x1 y1 x2 y2"), [rows.field(c).to_numpy() for c in ("w_", "s_", "e_", "n_")])
    assert (w[-2], s[-2], e[-2], n[-2]) == (0, 0, 4, 2) or (e[-2] - w[-2]) * (n[-2] - s[-2]) > 3
    assert np.isnan(w[-1]) and np.isfinite(w).mean() > 0.6
    for i in np.flatnonzero(np.isfinite(w)):
        corners = [(w[i], s[i]), (e[i], s[i]), (e[i], n[i]), (w[i], n[i]), (w[i], s[i])]
        assert all(parity(shapes[i], r.uniform(w[i], e[i]), r.uniform(s[i], n[i])) for _ in range(20)) and not any(crosses(ring, corners) for ring in shapes[i])


def test_shapes_alike_are_judged_once(monkeypatch):
    """Many copies that lie in a block, or pass by it: pairs of all of them, but edges are compared for one; and portions of bounded size."""
    judged, plain = [], planar.any_meet
    monkeypatch.setattr(planar, "any_meet", lambda e, f: judged.append(e.shape[1]) or plain(e, f))
    thorn = [[(0, 0), (10, 0.1), (10, 0.2), (0, 0)]]
    across = [[(5, -3), (5.1, -3), (5.2, 3), (5, -3)]]
    apart = [[(5, 1), (5.1, 1), (5.1, 3), (5, 1)]]
    l, r = as_rows([thorn] * 30 + [apart], "i"), as_rows([across] * 500 + [apart] * 2 + [across], "j")
    at, of = planar.polygons_meet()(l, r)
    assert sorted(zip(at.tolist(), of.tolist(), strict=True)) == sorted([(i, j) for i in range(30) for j in [*range(500), 502]] + [(30, 500), (30, 501)] + [(30, j) for j in [*range(500), 502] if crosses(apart[0], across[0])])
    assert sum(judged) < 20
    monkeypatch.setattr(blocks, "PAIRS", 31 * 8)
    sizes = [len(x) for x in blocks.portioned(r, len(l), "like_")]
    assert sum(sizes) == len(r) and max(sizes) <= 8 * blocks.COPIES and [len(x) for x in blocks.portioned(r, len(l), None)][:2] == [8, 8]


def test_only_parts_within_reach_can_be_met_twice(spark):
    box = lambda w, s, e, n: [[{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]]
    rows = [(0, [box(170, 0, 180, 9), box(-180, 0, -172, 9)]), (1, [box(0, 0, 1, 1), box(0, 4, 1, 5)]), (2, [box(0, 0, 1, 1)]), (3, [box(0, 0, 1, 1), box(0, 4.5, 1, 5), box(60, 0, 61, 1)])]
    f = spark.createDataFrame(rows, f"footprint_id int, polygons array<array<array<{rings.POINT}>>>")
    wanted = spark.createDataFrame([(7, [p for p in box(0.2, 0.5, 0.4, 3.6)[0]]), (8, box(-2, 0.5, 2, 0.7)[0])], f"area_id int, ring array<{rings.POINT}>").select("area_id", rings.ring_edges(F.col("ring")).alias("edges"))
    got = sorted((x.footprint_id, x.together) for x in reached_together(f, wanted).collect())
    assert got == [(0, False), (0, False), (1, True), (1, True), (2, False), (3, False), (3, False), (3, False)]
    assert sorted((x.footprint_id, x.together) for x in reached_together(f, wanted.limit(0)).collect())[2:4] == [(1, False), (1, False)]


def test_polygons_that_nothing_cuts_are_as_if_cut():
    r, rows = random.Random(31), []
    for _ in range(3000):
        lon, size = r.choice([0, 179, -180, 180, 1e-3]), r.choice([1e-13, 1e-5, 1, 5])
        points = [(lon + size * r.choice([r.uniform(-1, 1), r.randint(-2, 2)]), size * r.choice([r.uniform(-1, 1), r.randint(-2, 2)])) for _ in range(r.randint(3, 7))]
        line = {"line": [{"x": x, "y": y} for x, y in [*points, points[0]]], "turns": 0, "pole": None}
        rows.append(r.choice([None, [], [{"outer": line, "holes": []}] * 2, *[[{"outer": line, "holes": []}]] * 4, [{"outer": line, "holes": [line]}]]))
    of = pa.struct([("line", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("turns", pa.int32()), ("pole", pa.float64())])
    shapes = pa.array(rows, pa.list_(pa.struct([("outer", of), ("holes", pa.list_(of))])))

    def plainly(polygons):
        as_line = lambda s: ([(p["x"], p["y"]) for p in s["line"]], s["turns"], s["pole"])
        try:
            return polygons and [[[{"x": x, "y": y} for x, y in ring] for ring in p] for s in polygons for p in clipped(as_line(s["outer"]), [as_line(h) for h in s["holes"]])]
        except ValueError:
            return None

    assert clipped_arrow(shapes).to_pylist() == [plainly(x) for x in rows] and len(uncut(shapes)[0]) > 200
    assert clipped_arrow(shapes.slice(700, 90)).to_pylist() == [plainly(x) for x in rows[700:790]] and len(clipped_arrow(shapes.slice(0, 0))) == 0
