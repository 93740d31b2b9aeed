"""Overlay of areas: union, intersection, difference, and the partition of the plane by the best class that covers a place.

Coordinates become whole multiples of ``unit``. Areas are cut into square tiles by clipping their rings at half planes, tile in tile, so
neighbours share the same points; a tile with more than ``MAX_SIDES`` sides is cut again into quarters. In a tile a sweep by slabs finds the
faces: between two heights at which sides end or cross no sides cross, so the sides of a slab lie in one order from left to right, and the classes
that cover the interval between two of them are counted along it. What an operation keeps of those counts is the interval's class. The boundary of a
class is made of sides between intervals of other classes and of the differences of neighbouring slabs on their common height; as a sum of closed
trapezoids it is closed whatever the rounding of crossings. A class's border on a tile's edge and that of the tile beyond cancel by a running
sum along the line. What is left is chained to rings: inside a tile at once, then in blocks of four by four tiles, of four by four blocks and so on, each
joining what meets strictly inside it, so open chains get fewer from level to level. Rings that run counter-clockwise are outer ones; a hole goes to the smallest outer ring that holds it.

An area that covers a whole tile is one flag there, kept once for its class, so piles of large areas cost a tile no more than one. Nothing passes
through the driver but counts; a tile's work is bounded by ``MAX_SIDES``, unless more sides than that meet in one square of ``SMALLEST`` units.

Defined cases: null and empty shapes cover nothing; rings without area vanish; repeated shapes count once in effect; a class that keeps no area has no
row. A part is a row (``key``, ``class``, ``shape`` of one part with its holes, ``area``); parts that touch in a point only may come as one or two.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry, shapes
from wayfield.operators.spatial import in_blocks
from wayfield.session import dealt, discard, materialize

UNIT = 0.001
MAX_SIDES = 1500
SMALLEST = 64

PIECES = "key string, x0 long, y0 long, size long, cls int, area string, ring array<long>, sides int"


def _half(ring: np.ndarray, axis: int, at: int, upper: bool) -> np.ndarray:
    """A closed ring (last point not repeated) clipped to one side of a line; points on the line stay."""
    if not len(ring):
        return ring
    value = ring[:, axis] - at if upper else at - ring[:, axis]
    keep = value >= 0
    if keep.all():
        return ring
    if not keep.any():
        return ring[:0]
    if len(ring) <= 24:
        return _half_of_few(ring.tolist(), axis, at, keep.tolist())
    after = np.roll(ring, -1, axis=0)
    cut = keep != np.roll(keep, -1)
    a, b = ring[cut], after[cut]
    # The same two points in the same order from either side, so neighbours get the same crossing.
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    other = 1 - axis
    share = (at - a[:, axis]) / (b[:, axis] - a[:, axis])
    met = np.empty((len(a), 2), np.int64)
    met[:, axis] = at
    met[:, other] = np.rint(a[:, other] + share * (b[:, other] - a[:, other])).astype(np.int64)
    places = np.concatenate([np.flatnonzero(keep) * 2, np.flatnonzero(cut) * 2 + 1])
    out = np.concatenate([ring[keep], met])[np.argsort(places, kind="stable")]
    return out[(out != np.roll(out, -1, axis=0)).any(axis=1)]


def _half_of_few(ring: list[list[int]], axis: int, at: int, keep: list[bool]) -> np.ndarray:
    """``_half`` for a ring of few points, where numpy's calls cost more than the work; the same numbers."""
    other, out = 1 - axis, []
    for k, p in enumerate(ring):
        q, stays = ring[(k + 1) % len(ring)], keep[(k + 1) % len(ring)]
        if keep[k]:
            out.append(p)
        if keep[k] != stays:
            a, b = (q, p) if p > q else (p, q)
            met = [at, at]
            met[other] = round(a[other] + (at - a[axis]) / (b[axis] - a[axis]) * (b[other] - a[other]))
            out.append(met)
    kept = [p for k, p in enumerate(out) if p != out[(k + 1) % len(out)]]
    return np.array(kept, np.int64).reshape(-1, 2)


def _tiles(ring: np.ndarray, x0: int, y0: int, nx: int, ny: int, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(x0, y0, clipped ring) of the tiles that a ring meets, by halving the block of nx by ny tiles."""
    if len(ring) < 3:
        return
    low, high = ring.min(axis=0), ring.max(axis=0)
    if low[0] == high[0] or low[1] == high[1]:
        return
    if nx == 1 and ny == 1:
        yield x0, y0, ring
        return
    axis = 0 if nx >= ny else 1
    n = (nx if axis == 0 else ny) // 2
    at = (x0, y0)[axis] + n * size
    first, second = _half(ring, axis, at, False), _half(ring, axis, at, True)
    if axis == 0:
        yield from _tiles(first, x0, y0, n, ny, size)
        yield from _tiles(second, at, y0, nx - n, ny, size)
    else:
        yield from _tiles(first, x0, y0, nx, n, size)
        yield from _tiles(second, x0, at, nx, ny - n, size)


def _pieces(rings: list[np.ndarray], size: int, block: tuple[int, int, int, int] | None = None) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """(x0, y0, whole, rings) per tile of one area; whole: 1 where the area is all of the tile."""
    found: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
    for ring in rings:
        if block is None:
            i0, j0 = (ring.min(axis=0) // size).tolist()
            i1, j1 = ((ring.max(axis=0) - 1) // size).tolist()
            span = (i0 * size, j0 * size, max(1, i1 - i0 + 1), max(1, j1 - j0 + 1))
        else:
            span = block
        for x0, y0, piece in _tiles(ring, *span, size):
            found[x0, y0].append(piece)
    for (x0, y0), mine in found.items():
        doubled = [int(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) for r in (m - np.array([x0, y0]) for m in mine)]
        whole = len(mine) == 1 and abs(doubled[0]) == 2 * size * size
        if any(doubled):
            yield x0, y0, int(whole), mine


def _rows(key: str, cls: int, area: str, pieces, size: int) -> Iterator[tuple]:
    for x0, y0, whole, rings in pieces:
        if whole:
            yield key, x0, y0, size, cls, "", [], 0
        else:
            for ring in rings:
                yield key, x0, y0, size, cls, area, ring.ravel().tolist(), len(ring)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int32()]
    names = ["key", "x0", "y0", "size", "cls", "area", "ring", "sides"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _cut(areas: DataFrame, unit: float, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, cls, area, shape in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = [np.rint(np.array([(p["x"], p["y"]) for p in ring]) / unit).astype(np.int64) for part in shape for ring in part if len(ring) > 3]
                whole = [r[(r != np.roll(r, -1, axis=0)).any(axis=1)] for r in whole]
                out += _rows(key, cls, area, _pieces([r for r in whole if len(r) > 2], size), size)
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return areas.mapInArrow(run, PIECES)


def _quarters(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, x0, y0, size, cls, area, ring, sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                half = size // 2
                if not sides:
                    out += [(key, x0 + i * half, y0 + j * half, half, cls, "", [], 0) for i in (0, 1) for j in (0, 1)]
                else:
                    # Parity needs all of an area's rings in a tile, not that it is known to be whole: a ring alone is never a flag here.
                    for x, y, piece in _tiles(np.array(ring, np.int64).reshape(-1, 2), x0, y0, 2, 2, half):
                        out.append((key, x, y, half, cls, area, piece.ravel().tolist(), len(piece)))
            yield _batch(out)

    return pieces.mapInArrow(run, PIECES)


def _balanced(pieces: DataFrame) -> list[DataFrame]:
    """Tables of tiles: those with more than MAX_SIDES sides in quarters, until none is left (or tiles are smallest). Whole tiles are kept
    once a class."""
    tile = ["key", "x0", "y0", "size"]
    cut = materialize(pieces, "cut")  # written, so that areas are cut once for both
    loose = cut.filter("sides > 0").unionByName(cut.filter("sides = 0").dropDuplicates([*tile, "cls"]))
    now, done = materialize(loose, "tiles"), []
    discard(cut)
    while True:
        load = now.groupBy(*tile).agg(F.sum("sides").alias("load")).filter((F.col("load") > MAX_SIDES) & (F.col("size") > SMALLEST)).select(*tile)
        hot = materialize(load, "hot-tiles")
        if hot.isEmpty():
            discard(hot)
            return [*done, now]
        done.append(materialize(now.join(hot, tile, "left_anti"), "tiles"))
        before, now = now, materialize(_quarters(now.join(hot, tile, "left_semi").select(*pieces.columns)), "tiles")
        discard(before)
        discard(hot)


def _crossing_heights(sides: np.ndarray) -> np.ndarray:
    """Rounded heights at which two sides (x, y, x, y, running up) cross, found block by block."""
    out = []
    ax, ay, bx, by = (sides[:, i].astype(np.float64) for i in range(4))
    dx, dy = bx - ax, by - ay
    for i in range(0, len(sides), 256):
        s = slice(i, i + 256)
        turn = dx[s, None] * dy[None] - dy[s, None] * dx[None]
        ex, ey = ax[None] - ax[s, None], ay[None] - ay[s, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ex * dy[None] - ey * dx[None]) / turn
            u = (ex * dy[s, None] - ey * dx[s, None]) / turn
        row, col = np.nonzero((turn != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
        out.append(np.rint(ay[s][row] + t[row, col] * dy[s][row]).astype(np.int64))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _kept(counts: np.ndarray, how: str) -> np.ndarray:
    """The class of intervals from how many areas of each class cover them; -1 for none."""
    covered = counts > 0
    if how == "best":
        return np.where(covered.any(axis=1), covered.argmax(axis=1), -1)
    if how == "difference":
        return np.where(covered[:, 0] & ~covered[:, 1:].any(axis=1), 0, -1)
    return np.where(covered.all(axis=1), 0, -1)


def _needed(rings: list[tuple[int, int, np.ndarray]], whole: set[int], how: str) -> list[tuple[int, int, np.ndarray]]:
    """The rings (area, class, points) of a tile that can matter beside the classes that cover all of it."""
    if not whole:
        return rings
    if how == "best":
        return [r for r in rings if r[1] < min(whole)]
    if how == "difference" and max(whole) > 0:
        return []
    return [r for r in rings if r[1] not in whole]


class _Edges:
    """Directed boundary edges per class, the inside on their left, with the side that they come from (-1: none)."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def add(self, cls: int, ax: int, ay: int, bx: int, by: int, source: int) -> None:
        if (ax, ay) != (bx, by):
            self.rows.append((cls, ax, ay, bx, by, source))


def _sweep(rings: list[tuple[int, int, np.ndarray]], whole: set[int], box: tuple[int, int, int, int], n_classes: int, how: str) -> _Edges:
    """The boundary edges in a tile of rings (area, class, points) and of classes that cover it wholly."""
    x0, y0, x1, y1 = box
    sides, area, cls = [], [], []
    for a, c, ring in rings:
        both = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)
        both = both[both[:, 1] != both[:, 3]]
        up = both[:, 1] < both[:, 3]
        sides.append(np.where(up[:, None], both, both[:, [2, 3, 0, 1]]))
        area += [a] * len(both)
        cls += [c] * len(both)
    s = np.concatenate(sides) if sides else np.zeros((0, 4), np.int64)
    area, cls = np.array(area, np.int64), np.array(cls, np.int64)
    heights = np.unique(np.concatenate([[y0, y1], s[:, 1], s[:, 3], _crossing_heights(s)]))
    base = np.zeros(n_classes, np.int64)
    base[list(whole)] = 1
    edges = _Edges()
    below: tuple[np.ndarray, np.ndarray] = (np.array([x0, x1]), np.array([-1]))  # breaks and classes of the interval row under this height
    slope = (s[:, 2] - s[:, 0]) / np.maximum(s[:, 3] - s[:, 1], 1)
    for low, high in zip(heights, heights[1:], strict=False):
        on = np.flatnonzero((s[:, 1] <= low) & (s[:, 3] >= high))
        at = lambda y: s[on, 0] + slope[on] * (y - s[on, 1])  # noqa: B023, E731
        order = np.argsort(at((low + high) / 2), kind="stable")
        on = on[order]
        # An area's sides in a slab enter and leave it in turns.
        by_area = np.argsort(area[on], kind="stable")
        turn = np.arange(len(on)) - np.searchsorted(area[on][by_area], area[on][by_area])
        sign = np.empty(len(on), np.int64)
        sign[by_area] = np.where(turn % 2 == 0, 1, -1)
        change = np.zeros((len(on) + 1, n_classes), np.int64)
        change[0] = base
        change[np.arange(1, len(on) + 1), cls[on]] = sign
        label = _kept(np.cumsum(change, axis=0), how)
        ends = []
        for y in (low, high):
            x = np.where(s[on, 1] == y, s[on, 0], np.where(s[on, 3] == y, s[on, 2], np.rint(at(y)))).astype(np.int64)
            ends.append(np.clip(np.maximum.accumulate(np.concatenate([[x0], x, [x1]])), x0, x1))
        # Intervals without width, between sides that lie on each other, are not there.
        sources = np.concatenate([[-1], on, [-1]])
        wide = np.flatnonzero((np.diff(ends[0]) > 0) | (np.diff(ends[1]) > 0))
        label = label[wide]
        bounds = np.concatenate([wide, [len(on) + 1]])
        (bottom, top), sources = (e[bounds] for e in ends), sources[bounds]
        _across(edges, below, (bottom, label), int(low))
        left = np.concatenate([[-1], label])
        right = np.concatenate([label, [-1]])
        for k in np.flatnonzero(left != right):
            source = int(sources[k])
            if right[k] >= 0:  # what lies to the right has this as its left end, running down
                edges.add(int(right[k]), int(top[k]), int(high), int(bottom[k]), int(low), source)
            if left[k] >= 0:
                edges.add(int(left[k]), int(bottom[k]), int(low), int(top[k]), int(high), source)
        below = (top, label)
    _across(edges, below, (np.array([x0, x1]), np.array([-1])), int(y1))
    return edges


def _across(edges: _Edges, under: tuple[np.ndarray, np.ndarray], over: tuple[np.ndarray, np.ndarray], y: int) -> None:
    """Edges on a height, where the intervals under and over it differ."""
    breaks = np.unique(np.concatenate([under[0], over[0]]))
    if len(breaks) < 2:
        return
    middle = (breaks[:-1] + breaks[1:]) / 2
    pick = lambda row: row[1][np.clip(np.searchsorted(row[0], middle, "right") - 1, 0, len(row[1]) - 1)]
    a, b = pick(under), pick(over)
    for k in np.flatnonzero(a != b):
        if b[k] >= 0:
            edges.add(int(b[k]), int(breaks[k]), y, int(breaks[k + 1]), y, -2)
        if a[k] >= 0:
            edges.add(int(a[k]), int(breaks[k + 1]), y, int(breaks[k]), y, -2)


def _chains(edges: list[tuple[int, int, int, int, int]], ends_at) -> list[list[tuple[int, int]]]:
    """Chains of directed edges (ax, ay, bx, by, source): closed ones, and those that begin and end at places where ``ends_at``.

    Where several edges leave a place, the walk takes the one that turns most to the left, so rings that touch in a point come apart; neighbours of
    one source are one edge.
    """
    out_of: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, e in enumerate(edges):
        out_of[e[0], e[1]].append(i)
    used = [False] * len(edges)

    def turn(i: int, j: int) -> float:
        a, b = edges[i], edges[j]
        ux, uy, vx, vy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
        return float(np.arctan2(ux * vy - uy * vx, ux * vx + uy * vy))

    def walk(i: int) -> list[tuple[int, int]]:
        first, points, source = (edges[i][0], edges[i][1]), [(edges[i][0], edges[i][1])], None
        sources = []
        while True:
            used[i] = True
            ax, ay, bx, by, source = edges[i]
            points.append((bx, by))
            sources.append(source)
            if (bx, by) == first or ends_at(bx, by):
                break
            free = [j for j in out_of[bx, by] if not used[j]]
            if not free:
                break
            i = free[0] if len(free) == 1 else max(free, key=lambda j: turn(i, j))  # noqa: B023
        kept = [points[0]] + [points[k] for k in range(1, len(sources)) if sources[k] != sources[k - 1] or sources[k] == -1] + [points[-1]]
        return kept

    starts = [i for i, e in enumerate(edges) if ends_at(e[0], e[1])]
    out = [walk(i) for i in starts if not used[i]]
    out += [walk(i) for i in range(len(edges)) if not used[i]]
    return out


def _straight(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A closed ring without points that lie on the line between their neighbours."""
    ring = points[:-1]
    out = []
    for k, p in enumerate(ring):
        a = out[-1] if out else ring[k - 1]
        b = ring[(k + 1) % len(ring)]
        if (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0]):
            out.append(p)
    return [*out, out[0]] if len(out) > 2 else []


#: kind: 'chain' in a tile with free ends, 'ring' closed in a tile, 'x' or 'y' an edge on a tile's border line of that axis.
FOUND = "key string, cls int, kind string, cx long, cy long, points array<long>"


def _faces(pieces: DataFrame, n_classes: int, how: str, base: int) -> DataFrame:
    def arrange(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name, x0, y0, size = (k.as_py() for k in key)
        x1, y1 = x0 + size, y0 + size
        whole, rings, numbers = set(), [], {}
        for cls, area, ring in zip(*(table.column(c).to_pylist() for c in ("cls", "area", "ring")), strict=True):
            if ring:
                rings.append((numbers.setdefault((cls, area), len(numbers)), cls, np.array(ring, np.int64).reshape(-1, 2)))
            else:
                whole.add(cls)
        rings = _needed(rings, whole, how)
        edges = _sweep(rings, whole, (x0, y0, x1, y1), n_classes, how)
        out: list[tuple] = []
        inner: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for cls, ax, ay, bx, by, source in edges.rows:
            if ax == bx and ax in (x0, x1):
                out.append((name, cls, "x", ax // base, min(ay, by) // base, [ax, ay, bx, by]))
            elif ay == by and ay in (y0, y1):
                out.append((name, cls, "y", min(ax, bx) // base, ay // base, [ax, ay, bx, by]))
            else:
                inner[cls].append((ax, ay, bx, by, source))
        for cls, mine in inner.items():
            for chain in _chains(mine, lambda x, y: x in (x0, x1) or y in (y0, y1)):
                kind = "ring" if chain[0] == chain[-1] and not (chain[0][0] in (x0, x1) or chain[0][1] in (y0, y1)) else "chain"
                out.append((name, cls, kind, x0 // base, y0 // base, [v for p in chain for v in p]))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["key", "cls", "kind", "cx", "cy", "points"])

    tile = ["key", "x0", "y0", "size"]
    return dealt(pieces, *tile).groupBy(*tile).applyInArrow(arrange, FOUND)


def _borders(found: DataFrame) -> DataFrame:
    """Edges on tiles' border lines, those of neighbours cancelled: chains of two points."""
    p = F.col("points")
    along_x = F.col("kind") == "y"  # the line runs along x, at a fixed y
    line, a, b = F.when(along_x, p[1]).otherwise(p[0]), F.when(along_x, p[0]).otherwise(p[1]), F.when(along_x, p[2]).otherwise(p[3])
    # No edge is longer than a tile, and tiles lie on multiples of their size: the stretch of a line beside one tile is summed by itself.
    rows = found.filter("kind IN ('x', 'y')").select("key", "cls", "kind", "cx", "cy", line.alias("line"), a.alias("a"), b.alias("b"))
    ends = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))
    place = ["key", "cls", "kind", "cx", "cy", "line"]
    events = rows.select(*place, F.explode(ends).alias("e")).groupBy(*place, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    w = Window.partitionBy(*place).orderBy("at")
    run = events.withColumns({"n": F.sum("d").over(w), "next": F.lead("at").over(w)}).filter("n <> 0")
    start, stop = F.when(F.col("n") > 0, F.col("at")).otherwise(F.col("next")), F.when(F.col("n") > 0, F.col("next")).otherwise(F.col("at"))
    points = F.when(F.col("kind") == "y", F.array(start, "line", stop, "line")).otherwise(F.array("line", start, "line", stop))
    return run.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int")))).select("key", "cls", "cx", "cy", points.alias("points"))


def _join_blocks(level: int, size: int):
    """The function that joins the chains of a block of a level."""

    def line(i: int) -> int:
        for _ in range(level):
            i = 4 * i - 2
        return i * size

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name, cls, cx, cy = (k.as_py() for k in key)
        x0, x1, y0, y1 = line(cx), line(cx + 1), line(cy), line(cy + 1)
        given = [list(zip(p[::2], p[1::2], strict=True)) for p in table.column("points").to_pylist()]
        out = _joined(given, lambda p: x0 < p[0] < x1 and y0 < p[1] < y1)
        n = len(out)
        columns = [pa.array([name] * n, pa.string()), pa.array([cls] * n, pa.int32()), pa.array([cx] * n, pa.int64()), pa.array([cy] * n, pa.int64())]
        columns += [pa.array([[v for p in c for v in p] for c in out], pa.list_(pa.int64())), pa.array([c[0] == c[-1] for c in out], pa.bool_())]
        return pa.Table.from_arrays(columns, names=["key", "cls", "cx", "cy", "points", "closed"])

    return join


def _rings(chains: DataFrame, size: int) -> list[DataFrame]:
    """Tables of closed rings (key, cls, points) from chains that meet end to end, level by level.

    Blocks of a level are four by four of the one below, shifted by two, so no line is a border of blocks for ever.
    """
    schema = "key string, cls int, cx long, cy long, points array<long>, closed boolean"
    now, tables = chains, []
    for level in range(1, 40):
        up = now.withColumns({c: F.floor((F.col(c) + 2) / 4).cast("long") for c in ("cx", "cy")})
        up = dealt(up, "key", "cls", "cx", "cy") if level <= 2 else up
        joined = materialize(up.groupBy("key", "cls", "cx", "cy").applyInArrow(_join_blocks(level, size), schema), "joined")
        tables.append(joined)
        now = joined.filter("NOT closed").drop("closed")
        if now.isEmpty():
            return tables
    raise RuntimeError("chains are left open")


def _joined(chains: list[list[tuple[int, int]]], joins_at) -> list[list[tuple[int, int]]]:
    """Chains of points put together where they meet at places where ``joins_at``, by the turn that is most to the left; closed ones as they are."""
    out_of: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, c in enumerate(chains):
        out_of[c[0]].append(i)
    used, out = [False] * len(chains), []

    def walk(i: int) -> list[tuple[int, int]]:
        points = [chains[i][0]]
        while True:
            used[i] = True
            points += chains[i][1:]
            if points[-1] == points[0] or not joins_at(points[-1]):
                return points
            (ax, ay), (bx, by) = points[-2], points[-1]

            def turn(j: int) -> float:
                ux, uy, vx, vy = bx - ax, by - ay, chains[j][1][0] - bx, chains[j][1][1] - by  # noqa: B023
                return float(np.arctan2(ux * vy - uy * vx, ux * vx + uy * vy))

            free = [j for j in out_of[points[-1]] if not used[j]]
            if not free:
                return points
            i = max(free, key=turn)

    open_starts = [i for i, c in enumerate(chains) if not joins_at(c[0])]
    out += [walk(i) for i in open_starts if not used[i]]
    out += [walk(i) for i in range(len(chains)) if not used[i]]
    return out


def overlay(areas: DataFrame, n_classes: int, how: str = "best", tile: float = 500.0, unit: float = UNIT) -> DataFrame:
    """Parts (key, cls, shape, area) of the overlay of areas (key, cls from 0, ``shape`` or closed ``ring``), each key by itself.

    ``how``: 'best' gives every place to the lowest class that covers it (one class: the union); 'difference' keeps what class 0 covers and
    no other; 'intersection' what all classes cover. ``tile`` is the width of tiles.
    """
    if how not in ("best", "difference", "intersection"):
        raise ValueError("how must be best, difference or intersection")
    size = 1 << max(8, int(np.ceil(np.log2(tile / unit))))
    rows = areas.select(F.col("key").cast("string").alias("key"), F.col("cls").cast("int").alias("cls"), shapes.of(areas).alias("shape")).filter("size(shape) > 0")
    rows = rows.select("key", "cls", F.sha2(F.to_json("shape"), 256).alias("area"), "shape")
    pieces = _balanced(_cut(dealt(rows, "area").dropDuplicates(["key", "cls", "area"]), unit, size))
    found = materialize(_faces(reduce(DataFrame.unionByName, pieces), n_classes, how, size), "faces")
    for p in pieces:
        discard(p)
    chains = found.filter("kind = 'chain'").select("key", "cls", "cx", "cy", "points").unionByName(_borders(found))
    closed = _rings(chains, size)
    all_rings = reduce(DataFrame.unionByName, [found.filter("kind = 'ring'").select("key", "cls", "points"), *(t.filter("closed").select("key", "cls", "points") for t in closed)])
    rings = materialize(_measured(all_rings, unit), "rings")
    for t in [found, *closed]:
        discard(t)
    return _parts(rings, tile)


def _simple(ring: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """A closed walk as closed rings that pass no point twice."""
    stack: list[tuple[int, int]] = []
    at: dict[tuple[int, int], int] = {}
    for p in ring:
        if p in at:
            yield [*stack[at[p] :], p]
            for q in stack[at[p] + 1 :]:
                del at[q]
            del stack[at[p] + 1 :]
        else:
            at[p] = len(stack)
            stack.append(p)


def _measured(rings: DataFrame, unit: float) -> DataFrame:
    """(key, cls, id, ring of points, signed area) of rings without needless points; rings without area go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes, out, areas = [], [], [], []
            for key, cls, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for ring in map(_straight, _simple(list(zip(flat[::2], flat[1::2], strict=True)))):
                    x0, y0 = ring[0] if ring else (0, 0)
                    doubled = sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:], strict=False))
                    if doubled:
                        keys.append(key)
                        classes.append(cls)
                        out.append([{"x": x * unit, "y": y * unit} for x, y in ring])
                        areas.append(doubled / 2 * unit * unit)
            kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(classes, pa.int32()), pa.array(out, kind), pa.array(areas, pa.float64())], names=["key", "cls", "ring", "area"])

    out = rings.mapInArrow(run, "key string, cls int, ring array<struct<x:double,y:double>>, area double")
    return out.withColumn("id", F.xxhash64("key", "cls", F.to_json("ring")))


def _parts(rings: DataFrame, block: float) -> DataFrame:
    """Outer rings with the holes that they are the smallest to hold."""
    outer = rings.filter("area > 0").select("key", "cls", "id", "ring", "area")
    spread = in_blocks(outer.select("key", "cls", F.col("id").alias("of"), F.col("area").alias("size"), shapes.of_ring(F.col("ring")).alias("shape")), block)
    # A hole's side runs clockwise: a little to its left is the class itself, which only the outer ring of its part holds most closely.
    a, b = F.col("ring")[0], F.col("ring")[1]
    x = (a["x"] + b["x"]) / 2 - (b["y"] - a["y"]) * 1e-6
    y = (a["y"] + b["y"]) / 2 + (b["x"] - a["x"]) * 1e-6
    held = rings.filter("area < 0").select("key", "cls", F.col("id").alias("hole"), "ring", F.col("area").alias("lost"), x.alias("x"), y.alias("y"))
    held = held.withColumns({"cx": F.floor(F.col("x") / block).cast("long"), "cy": F.floor(F.col("y") / block).cast("long")})
    inside = shapes.contains(F.col("shape"), F.col("x"), F.col("y"))
    mine = held.join(spread.hint("merge"), ["key", "cls", "cx", "cy"]).filter(inside).groupBy("hole").agg(F.min_by(F.struct("of", "ring", "lost"), "size").alias("m"))
    holes = mine.groupBy(F.col("m.of").alias("id")).agg(F.collect_list("m.ring").alias("holes"), F.sum("m.lost").alias("lost"))
    shape = F.array(F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    return outer.join(holes.hint("merge"), "id", "left").select("key", "cls", shape.alias("shape"), (F.col("area") + F.coalesce("lost", F.lit(0.0))).alias("area"))


def tile_of(areas: DataFrame, unit: float = UNIT) -> float:
    """A tile as wide as areas (``shape`` or closed ``ring``) are on average, from 500 m to 2 km: one that spans many tiles is cut and swept once for each.
    Crowded tiles are cut again anyway. In a tile of 2 ** 30 units areas are exact in 64 bits."""
    b = shapes.bbox(shapes.of(areas))
    wide = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    mean = areas.select(wide.alias("w")).filter("w < double('infinity')").agg(F.avg("w")).first()[0]
    return min(max(500.0, mean or 0.0), 2000.0, (1 << 30) * unit)


def buffer(areas: DataFrame, distance: float, tile: float | None = None, quadrant: int = 4, unit: float = UNIT) -> DataFrame:
    """Parts (key, shape, area) of areas (key, ``shape`` or closed ``ring``) widened by ``distance``, or eroded by a negative one.

    What lies within the distance of a boundary is the union of capsules around its sides, round ends with ``quadrant`` segments a quarter. Widened: the
    union of the areas and the capsules; eroded: the areas without them. Overlapping areas of a key are one area before that. Tiles are as wide as
    the areas are unless ``tile`` says otherwise.
    """
    tile = tile_of(areas, unit) if tile is None else tile
    if distance == 0:
        return union(areas, tile, unit)
    whole = union(areas, tile, unit)
    sides = whole.select("key", F.explode(shapes.sides(F.col("shape"))).alias("s"))
    around = sides.select("key", shapes.of_ring(geometry.capsule(F.col("s.a"), F.col("s.b"), abs(distance), quadrant)).alias("shape"))
    if distance < 0:
        return difference(whole, around, tile, unit)
    return union(whole.select("key", "shape").unionByName(around), tile, unit)


def along(lines: DataFrame, distance: float, tile: float = 500.0, quadrant: int = 4, unit: float = UNIT) -> DataFrame:
    """Parts (key, shape, area) of what lies within a distance of lines (key, ``line``)."""
    sides = lines.select("key", F.explode(geometry.segments(F.col("line"))).alias("s"))
    return union(sides.select("key", shapes.of_ring(geometry.capsule(F.col("s.a"), F.col("s.b"), distance, quadrant)).alias("shape")), tile, unit)


def opened(areas: DataFrame, min_area: float = 200.0, min_width: float = 10.0, gap: float = 5.0, tile: float = 500.0) -> DataFrame:
    """Parts (key, shape, area) of the areas (key, ``shape`` or closed ``ring``) over ``min_area`` as one: what is narrower than twice
    ``min_width`` goes, what lies within twice ``gap`` grows together. An erosion, a dilation by both, an erosion by the gap."""
    large = areas.select("key", shapes.of(areas).alias("shape")).filter(shapes.area(F.col("shape")) > min_area)
    wide = buffer(buffer(large, -min_width, tile, 2), min_width + gap, tile, 2)
    return buffer(wide, -gap, tile, 2)


def rings_by_level(places: DataFrame, matrix: DataFrame, tile: float = 500.0, quadrant: int = 4) -> DataFrame:
    """Parts (rank_no, shape, area) of the buffers of places (quality; x, y or ``shape``) by a matrix (quality, distance, rank_no): each level
    has what lies within its distances of places of its qualities, without what a better level (a lower rank) has."""
    of = places.join(matrix, "quality")
    if "shape" in places.columns:
        sides = of.select("rank_no", "distance", F.explode(shapes.sides(F.col("shape"))).alias("s"))
        # The distance is a row's own, so the capsule of radius 1 is scaled about its segment by scaling the segment down and the ring up.
        d = F.col("distance").cast("double")
        small = lambda p: F.struct((p["x"] / d).alias("x"), (p["y"] / d).alias("y"))
        ring = geometry.capsule(small(F.col("s.a")), small(F.col("s.b")), 1.0, quadrant)
        around = sides.select("rank_no", shapes.of_ring(F.transform(ring, lambda p: F.struct((p["x"] * d).alias("x"), (p["y"] * d).alias("y")))).alias("shape"))
        rows = around.unionByName(of.select("rank_no", "shape"))
    else:
        ring = geometry.circle(F.lit(0.0), F.lit(0.0), 1.0, quadrant)
        rows = of.select("rank_no", shapes.of_ring(F.transform(ring, lambda p: F.struct((F.col("x") + p["x"] * F.col("distance")).alias("x"), (F.col("y") + p["y"] * F.col("distance")).alias("y")))).alias("shape"))
    n = (matrix.agg(F.max("rank_no")).first()[0] or 0) + 1
    return overlay(rows.select(F.lit("").alias("key"), F.col("rank_no").alias("cls"), "shape"), n, "best", tile).select(F.col("cls").alias("rank_no"), "shape", "area")


def union(areas: DataFrame, tile: float = 500.0, unit: float = UNIT) -> DataFrame:
    """Parts (key, shape, area) of the union of each key's areas."""
    return overlay(areas.withColumn("cls", F.lit(0)), 1, "best", tile, unit).drop("cls")


def difference(areas: DataFrame, others: DataFrame, tile: float = 500.0, unit: float = UNIT) -> DataFrame:
    """Parts (key, shape, area) of each key's areas without those of ``others`` with that key."""
    return _two(areas, others, "difference", tile, unit)


def intersection(areas: DataFrame, others: DataFrame, tile: float = 500.0, unit: float = UNIT) -> DataFrame:
    """Parts (key, shape, area) that both an area and one of ``others`` with its key cover."""
    return _two(areas, others, "intersection", tile, unit)


def _two(areas: DataFrame, others: DataFrame, how: str, tile: float, unit: float) -> DataFrame:
    rows = [df.select("key", F.lit(k).alias("cls"), shapes.of(df).alias("shape")) for k, df in enumerate((areas, others))]
    return overlay(rows[0].unionByName(rows[1]), 2, how, tile, unit).drop("cls")
