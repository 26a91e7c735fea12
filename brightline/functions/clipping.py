"""Clipping of polygons against the strip of longitudes -180 to 180: rings are cut at the strip's sides and their pieces joined along them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from brightline.functions.rings import DECIMALS, EPSILON

Point = tuple[float, float]
Ring = list[Point]


def signed_area(ring: Ring) -> float:
    x0, y0 = ring[0]
    return sum((x - x0) * (v - y0) - (u - x0) * (y - y0) for (x, y), (u, v) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def within(ring: Ring, x: float, y: float) -> bool:
    sides = zip(ring, [*ring[1:], ring[0]], strict=True)
    return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in sides) % 2 == 1


def half_plane(rings: list[Ring], at: float, side: int) -> list[Ring]:
    """What rings (open, outer ones against the clock, holes with it) enclose where side * (x - at) <= 0.

    The paths that stay are cut at the line. Along it, cuts in order of y bound what is inside two by two: there a path that leaves goes on as the
    one that comes in. ValueError if they don't match, which means that rings cross.
    """
    out, paths = [], []
    for ring in rings:
        stays = [side * (x - at) <= 0 for x, _ in ring]
        if all(stays):
            out.append(ring)
            continue
        if not any(stays):
            continue
        k = stays.index(False)
        points, stays = ring[k:] + ring[: k + 1], stays[k:] + stays[: k + 1]
        for i in range(1, len(points)):
            (x, y), (u, v) = points[i - 1], points[i]
            if stays[i - 1] != stays[i]:
                cut = (at, y + (v - y) * (at - x) / (u - x))
                if stays[i]:
                    paths.append([cut, (u, v)])
                else:
                    paths[-1].append(cut)
            elif stays[i]:
                paths[-1].append((u, v))
    cuts = sorted([(p[0][1], i, True) for i, p in enumerate(paths)] + [(p[-1][1], i, False) for i, p in enumerate(paths)])
    follows: dict[int, int] = {}
    for (_, i, comes), (_, j, comes_too) in zip(cuts[::2], cuts[1::2], strict=True):
        if comes == comes_too:
            raise ValueError("rings cross")
        follows[j if comes else i] = i if comes else j
    while follows:
        start, ring = next(iter(follows)), []
        i = start
        while True:
            ring += paths[i]
            i = follows.pop(i)
            if i == start:
                break
        out.append(ring)
    return out


def turned(ring: Ring, forward: bool) -> Ring:
    return ring if (signed_area(ring) > 0) == forward else ring[::-1]


def copies(line: Ring, turns: int, pole: float | None, outer: bool) -> list[Ring]:
    """The ring of an unwrapped line at every place where it meets the strip. One round a pole goes on past the strip on either side, and is closed over the pole there."""
    if turns:
        round_it = [(x + 360 * m * turns, y) for m in (-2, -1, 0, 1) for x, y in line[:-1]]
        ring = turned([*round_it, (round_it[-1][0], pole), (round_it[0][0], pole)], outer)
        return [ring]
    ring, xs = turned(line[:-1], outer), [x for x, _ in line]
    return [[(x + 360 * m, y) for x, y in ring] for m in range(math.ceil((-180 - max(xs)) / 360), math.floor((180 - min(xs)) / 360) + 1)]


def tidy(ring: Ring) -> Ring:
    points = [(round(x, DECIMALS), round(y, DECIMALS)) for x, y in ring]
    return [p for i, p in enumerate(points) if p != points[i - 1]]


def clipped(outer: tuple[Ring, int, float | None], holes: list[tuple[Ring, int, float | None]]) -> list[list[Ring]]:
    """The polygons, with holes, that a polygon of unwrapped lines is in the strip: closed rings, outer ones against the clock and first. ValueError if rings cross."""
    rings = [r for i, (line, turns, pole) in enumerate((outer, *holes)) for r in copies(line, turns, pole, i == 0)]
    rings = [tidy(r) for r in half_plane(half_plane(rings, 180.0, 1), -180.0, -1)]
    sized = [(signed_area(r), r) for r in rings if len(r) > 2]
    polygons = sorted(((a, [r]) for a, r in sized if a > EPSILON), key=lambda x: (x[0], x[1][0][0]))
    for a, hole in sized:
        if a < -EPSILON:
            x, y = ((hole[0][i] + hole[1][i]) / 2 for i in (0, 1))
            around = next((p for size, p in polygons if size > -a and within(p[0], x, y)), None)
            if around is None:
                raise ValueError("a hole lies in no ring")
            around.append(hole)
    return [[[*r, r[0]] for r in p] for _, p in polygons]


def rounded(v: np.ndarray) -> np.ndarray:
    """round(v, DECIMALS) of each number: those that lie near the middle of two are left to round()."""
    scaled = v * 10.0**DECIMALS
    whole = np.rint(scaled)
    out, unsure = whole / 10.0**DECIMALS, np.flatnonzero(~(np.abs(scaled - whole) < 0.4) | (np.abs(scaled) > 2.0**48))
    out[unsure] = [round(x, DECIMALS) for x in v[unsure].tolist()]
    return out


def uncut(shapes: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows of one polygon without holes that lies off the strip's sides and goes round no pole, and what clipped() gives for them: nothing is cut, rings are turned and rounded."""
    at = shapes.offsets.to_numpy()
    rows = np.flatnonzero(shapes.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) == 1))
    polygons = shapes.take(pa.array(rows)).flatten()
    outer, holes = polygons.field("outer"), polygons.field("holes")
    lines = outer.field("line")
    good = outer.is_valid().to_numpy(zero_copy_only=False) & (holes.value_lengths().fill_null(1).to_numpy() == 0) & (outer.field("turns").fill_null(1).to_numpy() == 0) & (lines.value_lengths().fill_null(0).to_numpy() > 3)
    rows, lines = rows[good], lines.filter(pa.array(good))
    points = lines.flatten()
    x, y = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    first, m = lines.offsets.to_numpy().astype(np.int64)[:-1] - lines.offsets[0].as_py(), lines.value_lengths().to_numpy().astype(np.int64) - 1
    ring = np.repeat(np.arange(len(rows)), m + 1)
    place = np.arange(len(ring)) - first[ring]

    def area(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x0, y0 = x[first[ring]], y[first[ring]]
        after = first[ring] + (place + 1) % m[ring]
        parts = np.where(place < m[ring], (x - x0) * (y[after] - y0) - (x[after] - x0) * (y - y0), 0.0)
        return np.add.reduceat(parts, first) / 2 if len(first) else parts

    index = first[ring] + np.where((area(x, y) > 0)[ring], place % m[ring], (m[ring] - 1 - place) % m[ring])
    x, y = rounded(x[index]), rounded(y[index])
    after = np.minimum(np.arange(len(x)) + 1, len(x) - 1)
    odd = ~((x > -180) & (x < 180)) | np.isnan(y) | (x == x[after]) & (y == y[after]) & (place < m[ring])
    good = ~np.logical_or.reduceat(odd, first) & (area(x, y) > 2 * EPSILON) if len(first) else np.zeros(0, bool)
    kept = good[ring]
    points = pa.StructArray.from_arrays([pa.array(x[kept]), pa.array(y[kept])], ["x", "y"])
    of_rings, one = np.append(0, (m[good] + 1).cumsum()).astype(np.int32), np.arange(good.sum() + 1, dtype=np.int32)
    return rows[good], pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(of_rings, points)))


def clipped_arrow(shapes: pa.Array) -> pa.Array:
    """clipped() of each row's polygons (struct(outer, holes) of lines); null where rings cross."""
    as_line = lambda s: ([(p["x"], p["y"]) for p in s["line"]], s["turns"], s["pole"])
    plain, ready = uncut(shapes)
    rest = np.setdiff1d(np.arange(len(shapes)), plain)
    out: list[list | None] = []
    for polygons in shapes.take(pa.array(rest)).to_pylist():
        try:
            found = None if polygons is None else [p for s in polygons for p in clipped(as_line(s["outer"]), [as_line(h) for h in s["holes"]])]
        except ValueError:
            found = None
        out.append(found and [[[{"x": x, "y": y} for x, y in r] for r in p] for p in found])
    ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    cut = pa.array(out, pa.list_(pa.list_(ring)))
    return pa.concat_arrays([ready.cast(cut.type), cut]).take(pa.array(np.argsort(np.concatenate([plain, rest]), kind="stable")))
