"""Tests of pairs of polygons, and of discs and polygons, for many pairs at once: the same arithmetic as functions/rings.py, on arrays.

Edges of pairs are arrays (4, pair, edge) of x1, y1, x2, y2, filled up with NaN: an edge of NaN meets nothing and stands to the right of nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from brightline.functions.rings import EPSILON
from brightline.operators.blocks import Judge, numbers

#: Pairs of edges that are looked at together; and a polygon's bounds are divided so many times, either way, to find a box within it.
ROOM = 1 << 18
PARTS = 6


class Lists:
    """Lists of structs of numbers: their sizes, and their numbers one after the other, by (name, place)."""

    def __init__(self, lists: pa.ListArray, names: str) -> None:
        at = lists.offsets.to_numpy().astype(np.int64)
        self.sizes, self.first = np.diff(at), at[:-1] - at[0]
        self.flat = np.array(numbers(lists.flatten(), *names.split()), dtype=float).reshape(len(names.split()), -1)

    def of(self, some: np.ndarray, most: int | None = None) -> np.ndarray:
        """Numbers of some lists by (name, list, place), filled up with NaN."""
        sizes = self.sizes[some]
        place = np.arange(sizes.max(initial=1) if most is None else most)
        there = place < sizes[:, None]
        out = self.flat[:, np.where(there, self.first[some][:, None] + place, 0)] if self.flat.shape[1] else np.empty((len(self.flat), *there.shape))
        out[:, ~there] = np.nan
        return out


def portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pairs, with those of like sizes together and no more at once than ROOM holds."""
    order = np.argsort(sizes, kind="stable")
    while len(order):
        n = len(order)
        while n > 1 and n * sizes[order[n - 1]] > ROOM:
            n = max(1, min(n // 2, n - 1))
        yield order[:n]
        order = order[n:]


def side(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sign((s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0]))


def beside(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether the bounds of edges overlap."""
    over = (np.maximum(e[0], e[2]) >= np.minimum(f[0], f[2])) & (np.maximum(f[0], f[2]) >= np.minimum(e[0], e[2]))
    return over & (np.maximum(e[1], e[3]) >= np.minimum(f[1], f[3])) & (np.maximum(f[1], f[3]) >= np.minimum(e[1], e[3]))


def across(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    apart = lambda s, t: side(s, t[0], t[1]) * side(s, t[2], t[3]) > 0
    return ~apart(e, f) & ~apart(f, e)


def meet(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    return beside(e, f) & across(e, f)


def contains(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) + e[0])
    return right.sum(axis=-1) % 2 == 1


def any_meet(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether an edge of one meets an edge of the other, by pair; in steps where the edges are many."""
    step = max(1, ROOM // (e.shape[1] * f.shape[2]))
    out = np.zeros(e.shape[1], bool)
    for k in range(0, e.shape[2], step):
        pair, i, j = np.nonzero(beside(e[:, :, k : k + step, None], f[:, :, None, :]))
        out[pair[across(e[:, pair, i + k], f[:, pair, j])]] = True
    return out


_LOW, _HIGH = (v.ravel() for v in np.meshgrid(range(PARTS), range(1, PARTS + 1), indexing="ij"))
_LOW, _HIGH = _LOW[_LOW < _HIGH], _HIGH[_LOW < _HIGH]
#: The boxes that parts of bounds make up: first and last column, first and last row.
_BOXES = [v.ravel() for v in (*np.broadcast_arrays(_LOW[:, None], _HIGH[:, None], _LOW, _HIGH),)]


def inner_boxes(edges: Lists, box: list[np.ndarray]) -> list[np.ndarray]:
    """West, south, east and north of a box that lies within each polygon, as large as parts of its bounds make up; NaN without one. Two polygons
    whose inner boxes overlap have points in common."""
    out = np.full((4, len(edges.sizes)), np.nan)
    steps = np.linspace(0, 1, PARTS + 1)
    for some in portions(edges.sizes * (PARTS + 1) ** 2):
        e = edges.of(some)
        w, s, wide, high = (v[some][:, None] for v in (box[0], box[1], box[2] - box[0], box[3] - box[1]))
        xs, ys = w + wide * steps, s + high * steps
        dx, dy = e[2] - e[0], e[3] - e[1]
        # The side of an edge's line on which corners of parts lie: by (polygon, edge, column, row).
        at = (dx[:, :, None] * (ys[:, None, :] - e[1][:, :, None]))[:, :, None, :] - (dy[:, :, None] * (xs[:, None, :] - e[0][:, :, None]))[:, :, :, None]
        near = ((np.abs(dx) + np.abs(dy)) * (1e-9 * np.maximum(wide, high) + 1e-12))[:, :, None, None]
        low = np.minimum(np.minimum(at[:, :, :-1, :-1], at[:, :, 1:, :-1]), np.minimum(at[:, :, :-1, 1:], at[:, :, 1:, 1:]))
        high_ = np.maximum(np.maximum(at[:, :, :-1, :-1], at[:, :, 1:, :-1]), np.maximum(at[:, :, :-1, 1:], at[:, :, 1:, 1:]))
        touched = (low <= near) & (high_ >= -near)
        for k, lines in ((0, xs), (1, ys)):
            margin = 1e-9 * (wide if k == 0 else high) + 1e-12
            over = (np.maximum(e[k], e[k + 2])[:, :, None] >= (lines - margin)[:, None, :-1]) & (np.minimum(e[k], e[k + 2])[:, :, None] <= (lines + margin)[:, None, 1:])
            touched &= over[:, :, :, None] if k == 0 else over[:, :, None, :]
        x, y = (xs[:, :-1] + xs[:, 1:]) / 2, (ys[:, :-1] + ys[:, 1:]) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (dx[:, :, None] * (y[:, None, :] - e[1][:, :, None]) / dy[:, :, None]) + e[0][:, :, None]
            right = ((e[1][:, :, None] > y[:, None, :]) != (e[3][:, :, None] > y[:, None, :]))[:, :, None, :] & (x[:, None, :, None] < cut[:, :, None, :])
        within = ~touched.any(axis=1) & (right.sum(axis=1) % 2 == 1)
        total = np.zeros((len(some), PARTS + 1, PARTS + 1), np.int16)
        total[:, 1:, 1:] = within.cumsum(axis=1).cumsum(axis=2)
        i, j, k, m = _BOXES
        size = ((j - i) * (m - k)).astype(np.int16)
        whole = total[:, j, m] - total[:, i, m] - total[:, j, k] + total[:, i, k] == size
        best = np.where(whole, size, 0).argmax(axis=1)
        found, n = whole[np.arange(len(some)), best], np.arange(len(some))
        for place, v in enumerate((xs[n, i[best]], ys[n, k[best]], xs[n, j[best]], ys[n, m[best]])):
            out[place, some] = np.where(found, v, np.nan)
    return list(out)


class Polygons:
    """Rows of polygons: w_, s_, e_, n_: bounds; fx_, fy_: whether the cell has the first column or row of the polygon's; edges_. Rows next to each other that
    are alike are one shape, so that none is judged for each of its copies."""

    def __init__(self, rows: pa.StructArray) -> None:
        bounds = numbers(rows, "w_", "s_", "e_", "n_", "fx_", "fy_")
        edges = Lists(rows.field("edges_"), "x1 y1 x2 y2")
        same = np.zeros(len(rows), bool)
        if len(rows) > 1:
            same[1:] = edges.sizes[1:] == edges.sizes[:-1]
            for v in bounds:
                same[1:] &= v[1:] == v[:-1]
            at = np.flatnonzero(same)
            for some in portions(edges.sizes[at]):
                same[at[some]] = np.array_equal(a := edges.of(at[some]), b := edges.of(at[some] - 1)) or ((a == b) | np.isnan(a) & np.isnan(b)).all(axis=(0, 2))
        self.start = np.flatnonzero(~same)
        self.copies = np.diff(np.append(self.start, len(rows)))
        self.bounds = [v[self.start] for v in bounds]
        self.edges = edges
        self.sizes = edges.sizes[self.start]
        edges.sizes, edges.first = self.sizes, edges.first[self.start]
        self.inner = inner_boxes(edges, self.bounds[:4])

    def rows(self, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that shapes stand for, and the place in shapes that each is for."""
        n = self.copies[shapes]
        place = np.repeat(np.arange(len(shapes)), n)
        return self.start[shapes][place] + np.arange(len(place)) - (n.cumsum() - n)[place], place


def overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return (a[0][:, None] <= b[2]) & (b[0] <= a[2][:, None]) & (a[1][:, None] <= b[3]) & (b[1] <= a[3][:, None])


def polygons_meet() -> Judge:
    """A test of two polygons: they have a point in common."""
    last = {}

    def test(l: pa.StructArray, r: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        if last.get("rows") is not l:
            last.update(rows=l, polygons=Polygons(l))
        a, b = last["polygons"], Polygons(r)
        w, s, e, n = (f(v) for f, v in zip((np.min, np.min, np.max, np.max), b.bounds, strict=False))
        some = np.flatnonzero((a.bounds[0] <= e) & (a.bounds[2] >= w) & (a.bounds[1] <= n) & (a.bounds[3] >= s))
        here = [v[some] for v in a.bounds]
        near = overlap(here, b.bounds) & (here[4][:, None] | b.bounds[4]) & (here[5][:, None] | b.bounds[5])
        sure = near & overlap([v[some] for v in a.inner], b.inner)
        at, of = np.nonzero(near & ~sure)
        at = some[at]
        takes = np.zeros(len(at), bool)
        for part in portions(a.sizes[at] * b.sizes[of]):
            p, q = a.edges.of(at[part]), b.edges.of(of[part])
            takes[part] = contains(p, q[0, :, :1], q[1, :, :1]) | contains(q, p[0, :, :1], p[1, :, :1])
            rest = np.flatnonzero(~takes[part])
            if len(rest):
                takes[part[rest]] = any_meet(p[:, rest], q[:, rest])
        i, j = np.nonzero(sure)
        at, of = np.concatenate([some[i], at[takes]]), np.concatenate([j, of[takes]])
        of, place = b.rows(of)
        at, again = a.rows(at[place])
        return at, of[again]

    return test


class Outlines:
    """Polygons on the sphere, given as lists of rings, lists of x and y: the first ring is the outer one."""

    def __init__(self, polygons: pa.ListArray) -> None:
        at = polygons.offsets.to_numpy().astype(np.int64)
        self.counts, self.first = np.diff(at), at[:-1] - at[0]
        self.rings = Lists(polygons.flatten(), "x y")
        b = np.radians(self.rings.flat[1])
        self.rings.flat = np.array([self.rings.flat[0], np.sin(b), np.cos(b)])

    def plane(self, lat: np.ndarray, lon: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of ring k of polygons on the planes that touch the sphere at places; NaN past its end; and whether a point is on the other half of the sphere."""
        ring = self.first[of] + k
        xs, sb, cb = self.rings.of(ring)
        turn = np.radians(xs - lon[:, None])
        sa, ca = np.sin(np.radians(lat))[:, None], np.cos(np.radians(lat))[:, None]
        ct = np.cos(turn)
        c = sa * sb + ca * cb * ct
        hidden = ((np.arange(xs.shape[1]) < self.rings.sizes[ring][:, None]) & ~(c > EPSILON)).any(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = cb * np.sin(turn) / c, (ca * sb - sa * cb * ct) / c
        return np.array([x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]]), hidden

    def around(self, lat: np.ndarray, lon: np.ndarray, of: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether polygons cover the discs around places with the radii `least` on the plane, by pair; and how far off their edges are, if so.

        On the plane a disc is a disc. A ring that crosses itself, has no area or reaches the other half of the sphere covers nothing."""
        takes, odd, away = np.ones(len(of), bool), np.zeros(len(of), int), np.full(len(of), np.inf)
        for k in range(self.counts[of].max(initial=0)):
            live = np.flatnonzero(takes & (self.counts[of] > k))
            for part in portions(self.rings.sizes[self.first[of[live]] + k]):
                some = live[part]
                g, hidden = self.plane(lat[some], lon[some], of[some], k)
                odd[some] += contains(g, 0.0, 0.0)
                dx, dy = g[2] - g[0], g[3] - g[1]
                length = dx * dx + dy * dy
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(length == 0, 0.0, np.minimum(np.maximum(-(g[0] * dx + g[1] * dy) / length, 0.0), 1.0))
                d = np.where(np.isnan(length), np.inf, np.hypot(g[0] + t * dx, g[1] + t * dy)).min(axis=1, initial=np.inf)
                away[some] = np.minimum(away[some], d)
                takes[some] = ~hidden & (away[some] >= least[some])
        takes &= odd % 2 == 1
        # Great circles cross or don't, whatever the plane that shows both: one of a polygon's planes tells whether its rings are sound.
        kept = np.flatnonzero(takes)
        which, shown = np.unique(of[kept], return_index=True)
        bad, shown = np.zeros(len(which), bool), kept[shown]
        for k in range(self.counts[which].max(initial=0)):
            live = np.flatnonzero(~bad & (self.counts[which] > k))
            for part in portions(self.rings.sizes[self.first[which[live]] + k] ** 2):
                some = live[part]
                g, _ = self.plane(lat[shown[some]], lon[shown[some]], which[some], k)
                bad[some] = unsound(g, self.rings.sizes[self.first[which[some]] + k] - 1)
        takes[kept] = ~bad[np.searchsorted(which, of[kept])]
        return takes, away


def unsound(g: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rings on a plane, of m edges each, cross themselves or have no area."""
    x, y = g[0, :, :1], g[1, :, :1]
    area = np.nansum((g[0] - x) * (g[3] - y) - (g[1] - y) * (g[2] - x), axis=1) / 2
    bad = ~(np.abs(area) > 1e-18)
    for i in range(g.shape[2] - 2):
        follows = np.arange(i + 2, g.shape[2])
        bad |= (meet(g[:, :, i, None], g[:, :, i + 2 :]) & ~((i == 0) & (follows == m[:, None] - 1))).any(axis=1)
    return bad


def lying(lat: np.ndarray, lon: np.ndarray, box: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, and of bounds in unwrapped longitudes that they lie in."""
    w, s, e, n = box
    at, of = np.nonzero((lat[:, None] >= s) & (lat[:, None] <= n))
    east = np.mod(lon[at] - w[of] + EPSILON, 360.0) <= e[of] - w[of] + 2 * EPSILON
    return at[east], of[east]


def discs_covered(l: pa.StructArray, r: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of discs (lat, lon, radius) and polygons (lines_: rings as lists of x and y; w_, s_, e_, n_: bounds) that cover them on the sphere."""
    lat, lon, radius = numbers(l, "lat", "lon", "radius")
    at, of = lying(lat, lon, numbers(r, "w_", "s_", "e_", "n_"))
    takes, _ = Outlines(r.field("lines_")).around(lat[at], lon[at], of, np.tan(radius[at]))
    return at[takes], of[takes]
