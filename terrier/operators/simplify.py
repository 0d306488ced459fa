"""Fewer vertices: Douglas and Peucker (1973), with every step checked against the whole shape."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.functions import geometry as G

# executors get these helpers with the query and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Segments:
    """The segments of one shape as it is being thinned, by the grid cells they meet."""

    def __init__(self, rings: list[np.ndarray]) -> None:
        ends = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
        # plain numbers: a cell holds few segments, for which arrays cost more than they save
        self.ends = ends.tolist()
        self.alive = [True] * len(ends)
        low, high = ends.min(axis=0), ends.max(axis=0)
        origin = np.minimum(low[:2], low[2:])
        extent = float((np.maximum(high[:2], high[2:]) - origin).max())
        self.origin = origin.tolist()
        self.side = extent / max(1.0, len(ends) ** 0.5) or 1.0
        self.cells: dict[tuple[int, int], list[int]] = {}
        for number, own in enumerate(self.ends):
            self._file(number, own)

    def _cover(self, ends: Sequence[float]) -> list[tuple[int, int]]:
        (x0, y0), side = self.origin, self.side
        x1, x2 = int((ends[0] - x0) // side), int((ends[2] - x0) // side)
        y1, y2 = int((ends[1] - y0) // side), int((ends[3] - y0) // side)
        if x1 == x2 and y1 == y2:
            return [(x1, y1)]
        return [(x, y) for x in range(min(x1, x2), max(x1, x2) + 1) for y in range(min(y1, y2), max(y1, y2) + 1)]

    def _file(self, number: int, ends: Sequence[float]) -> None:
        for cell in self._cover(ends):
            self.cells.setdefault(cell, []).append(number)

    def _near(self, ends: Sequence[float]) -> list[Sequence[float]]:
        found = {n for cell in self._cover(ends) for n in self.cells.get(cell, ())}
        return [self.ends[n] for n in found if self.alive[n]]

    def replace(self, first: int, last: int, ends: Sequence[float]) -> bool:
        """Put one segment in place of those numbered ``first`` to ``last`` - 1, if it meets no other."""
        self.alive[first:last] = [False] * (last - first)
        if meets(ends, self._near(ends)):
            self.alive[first:last] = [True] * (last - first)
            return False
        self._file(len(self.ends), ends)
        self.ends.append(ends)
        self.alive.append(True)
        return True


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Positive where c lies left of a to b."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def meets(ends: Sequence[float], others: Iterable[Sequence[float]]) -> bool:
    """Whether a segment meets any other, but for ends that they share."""
    px, py, qx, qy = ends
    left, right = (px, qx) if px < qx else (qx, px)
    low, high = (py, qy) if py < qy else (qy, py)
    dx, dy = qx - px, qy - py
    for ax, ay, bx, by in others:
        # boxes apart: most of what is near
        if (ax < left and bx < left) or (ax > right and bx > right) or (ay < low and by < low) or (ay > high and by > high):
            continue
        ap, aq = ax == px and ay == py, ax == qx and ay == qy
        bp, bq = bx == px and by == py, bx == qx and by == qy
        if ap and bq or aq and bp:
            return True
        ex, ey = bx - ax, by - ay
        at_a, at_b = dx * (ay - py) - dy * (ax - px), dx * (by - py) - dy * (bx - px)
        at_p, at_q = ex * (py - ay) - ey * (px - ax), ex * (qy - ay) - ey * (qx - ax)
        if ((at_a < 0 < at_b or at_b < 0 < at_a) and (at_p < 0 < at_q or at_q < 0 < at_p)
                or at_a == 0 and left <= ax <= right and low <= ay <= high and not ap and not aq
                or at_b == 0 and left <= bx <= right and low <= by <= high and not bp and not bq
                or at_p == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by) and not ap and not bp
                or at_q == 0 and min(ax, bx) <= qx <= max(ax, bx) and min(ay, by) <= qy <= max(ay, by) and not aq and not bq):
            return True
    return False


def holds(path: np.ndarray, points: np.ndarray) -> bool:
    """Whether any point lies inside the area between an open path and its closing segment."""
    (left, low), (right, high) = path.min(axis=0), path.max(axis=0)
    points = points[(points[:, 0] >= left) & (points[:, 0] <= right) & (points[:, 1] >= low) & (points[:, 1] <= high)]
    if not len(points):
        return False
    ax, ay = path[:, 0], path[:, 1]
    closed = np.concatenate([path[1:], path[:1]])
    bx, by = closed[:, 0], closed[:, 1]
    x, y = points[:, :1], points[:, 1:]
    straddles = (ay > y) != (by > y)
    rise = by - ay
    at = ax + (y - ay) / np.where(rise == 0, 1, rise) * (bx - ax)  # level edges straddle nothing
    return bool((np.count_nonzero(straddles & (x < at), axis=1) % 2 == 1).any())


def _offsets(xy: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Distances of the vertices between two of a line from the segment that joins them."""
    a, ab = xy[lo], xy[hi] - xy[lo]
    away = xy[lo + 1:hi] - a
    length = float(ab @ ab)
    along = np.minimum(np.maximum((away @ ab) / length, 0), 1) if length else np.zeros(len(away))
    return np.hypot(*(xy[lo + 1:hi] - (a + along[:, None] * ab)).T)


def _anchors(xy: np.ndarray) -> list[int]:
    """Vertices that stay, so that a closed ring keeps an area: the first, the farthest, and the one off their line."""
    far = int(np.argmax(((xy - xy[0]) ** 2).sum(axis=1)))
    aside = int(np.argmax(np.abs(_turn(xy[0], xy[far], xy))))
    return sorted({0, far, aside, len(xy) - 1})


def thin_shape(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Which vertices of each closed ring of one shape stay.

    A run of vertices goes if all lie within the tolerance of the segment that takes its
    place, and that segment neither meets what is left of the shape nor passes over another
    ring or the rest of its own. So rings do not cross, holes stay inside, and islands
    outside. Rings keep at least three vertices; what crosses already is left as it is.
    """
    stay = [np.arange(len(r)) if len(r) <= 4 else None for r in rings]
    if all(s is not None for s in stay):
        return stay
    segments, base = Segments(rings), [0, *accumulate(len(r) - 1 for r in rings)]
    firsts = np.array([r[0] for r in rings])
    for i, xy in enumerate(rings):
        if stay[i] is not None:
            continue
        others = np.delete(firsts, i, axis=0)
        anchors = _anchors(xy)
        keep = set(anchors)
        spans = list(zip(anchors[:-1], anchors[1:]))
        while spans:
            lo, hi = spans.pop()
            if hi - lo < 2:
                continue
            offsets = _offsets(xy, lo, hi)
            worst = int(np.argmax(offsets))
            if offsets[worst] <= tolerance:
                rest = xy[1:lo][:1] if hi == len(xy) - 1 else xy[hi + 1:hi + 2] if lo or hi + 2 < len(xy) else xy[:0]
                if (not holds(xy[lo:hi + 1], np.concatenate([others, rest]))
                        and segments.replace(base[i] + lo, base[i] + hi, [*xy[lo].tolist(), *xy[hi].tolist()])):
                    continue
            keep.add(lo + 1 + worst)
            spans += [(lo, lo + 1 + worst), (lo + 1 + worst, hi)]
        stay[i] = np.array(sorted(keep))
    return stay


def thin_ring(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a closed ring stay."""
    return thin_shape([xy], tolerance)[0]


def thin_geometries(shapes: pa.StructArray, tolerance: float) -> pa.StructArray:
    """Thin every shape of an Arrow batch; works on the flat vertex arrays."""
    parts = shapes.field("parts")
    rings = parts.values.values
    if len(rings) == 0:
        return shapes
    vertices = rings.values
    xy = np.column_stack([vertices.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
    ends = rings.offsets.to_numpy()
    of_part, of_shape = parts.values.offsets.to_numpy(), parts.offsets.to_numpy()
    keep = np.ones(len(xy), dtype=bool)
    for first, last in zip(of_part[of_shape[:-1]], of_part[of_shape[1:]]):
        own = [xy[lo:hi] for lo, hi in zip(ends[first:last], ends[first + 1:last + 1])]
        for lo, hi, stay in zip(ends[first:last], ends[first + 1:last + 1], thin_shape(own, tolerance)):
            keep[lo:hi] = False
            keep[lo + stay] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
    thinner = pa.ListArray.from_arrays(pa.array(kept_before[ends]), vertices.filter(pa.array(keep)))
    nested = pa.ListArray.from_arrays(
        parts.offsets, pa.ListArray.from_arrays(parts.values.offsets, thinner))
    return pa.StructArray.from_arrays([shapes.field("srid"), nested], names=["srid", "parts"])


def simplify(df: DataFrame, geom: str, tolerance: float) -> DataFrame:
    """Simplify a geometry column, each shape for itself and with its topology kept.

    The result has a subset of the vertices, not the same ones as other tools. Every
    vertex left out lies within the tolerance of the segment that replaces it.
    """
    @F.arrow_udf(G.GEOMETRY)
    def thin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield thin_geometries(batch, tolerance)

    return df.withColumn(geom, F.when(F.col(geom).isNotNull(), thin(F.col(geom))))
