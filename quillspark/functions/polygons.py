"""Convex polygons of any rotation: hulls, areas, common areas, and joins of those that may touch.

Polygons are arrays of points (``x``, ``y``), as ``geometry.points`` makes them.  The arithmetic of pairs runs
in an Arrow function, for no expression holds a polygon whose number of corners changes; upright rectangles, which most
boxes are, are measured there a batch at once.  Which pairs meet is decided by Spark, over grid cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import materialize
from .geometry import bounding_box
from .normalize import let

POLYGON = "array<struct<x:double,y:double>>"
Points = list[tuple[float, float]]
#: A page is covered by so many cells each way, so a polygon lies in a bounded number of them.
GRID = 16
#: Rows of a document and side beyond which pairs are looked for by cells.
DENSE = 512


def hull(points: Points) -> Points:
    """Corners of the convex hull, counter-clockwise in a frame whose y grows upwards, without corners on an edge."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ps) -> Points:
        out: Points = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(reversed(points))


def rectangle(points: Points) -> tuple[float, float, float, float] | None:
    """Sides of four corners that are an upright rectangle, else None."""
    if len(points) != 4 or len(set(points)) != 4:
        return None
    xs, ys = {p[0] for p in points}, {p[1] for p in points}
    return (min(xs), min(ys), max(xs), max(ys)) if len(xs) == len(ys) == 2 else None


def shared(a: Points, b: Points) -> float:
    """Area that two hulls share."""
    p, q = rectangle(a), rectangle(b)
    if p and q:
        return max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
    a, b = hull(a), hull(b)
    return shoelace(clipped(a, b)) if len(a) > 2 and len(b) > 2 else 0.0


def shoelace(ring: Points) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0


def clipped(ring: Points, window: Points) -> Points:
    """What of a convex ring lies in a convex window; both as :func:`hull` gives them."""
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ring]
        kept: Points = []
        for k, p in enumerate(ring):
            q, s, t = ring[k - 1], side[k], side[k - 1]
            if (s > 0 > t) or (s < 0 < t):
                kept.append((q[0] + (p[0] - q[0]) * t / (t - s), q[1] + (p[1] - q[1]) * t / (t - s)))
            if s >= 0:
                kept.append(p)
        ring = kept
        if not ring:
            break
    return ring


def _points(xs, ys) -> Points:
    """Finite points of two lists of coordinates (Arrow scalars)."""
    finite = lambda v: v is not None and math.isfinite(v)
    return [(x, y) for x, y in zip(xs.as_py() or [], ys.as_py() or [], strict=True) if finite(x) and finite(y)]


def rectangles(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`rectangle` of many polygons at once: sides (``n`` x 4, zeros elsewhere), and where there is one."""
    lengths = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False).astype("int64")
    return sides_of(lengths, *(c.flatten().to_numpy(zero_copy_only=False).astype("float64") for c in (xs, ys)))


def sides_of(lengths: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`rectangles` of polygons whose corners stand one after the other, ``lengths`` to a polygon."""
    four = np.flatnonzero(lengths == 4)
    at = (np.cumsum(lengths) - lengths)[four, None] + np.arange(4)
    x, y = xs[at], ys[at]
    sides = np.stack([f(f(v[:, 0], v[:, 1]), f(v[:, 2], v[:, 3])) for f in (np.minimum, np.maximum) for v in (x, y)], 1)
    (right, left), (lower, upper) = ((v == sides[:, i, None], v == sides[:, j, None]) for v, i, j in ((x, 2, 0), (y, 3, 1)))
    # Every corner counts as one of four bits; only four different ones add up to 15.
    bits = np.where((right | left) & (lower | upper), 1 << (2 * right + lower), 0)
    corners = bits[:, 0] + bits[:, 1] + bits[:, 2] + bits[:, 3] == 15
    plain = np.isfinite(sides).all(1) & (sides[:, 0] < sides[:, 2]) & (sides[:, 1] < sides[:, 3]) & corners
    out, found = np.zeros((len(lengths), 4)), np.zeros(len(lengths), "bool")
    out[four[plain]], found[four[plain]] = sides[plain], True
    return out, found


def rectangle_areas(sides: np.ndarray) -> np.ndarray:
    """:func:`shoelace` of rectangles, rounded as the sum of its four terms is."""
    x0, y0, x1, y1 = sides.T
    total, rest = np.zeros(len(sides)), np.zeros(len(sides))
    for term in (x0 * y0 - x1 * y0, x1 * y1 - x1 * y0, x1 * y1 - x0 * y1, x0 * y0 - x0 * y1):
        after = total + term
        rest += np.where(np.abs(total) >= np.abs(term), (total - after) + term, (term - after) + total)
        total = after
    return np.abs(total + rest) / 2


@F.arrow_udf(DoubleType())
def _hull_area(xs: pa.Array, ys: pa.Array) -> pa.Array:
    sides, plain = rectangles(xs, ys)
    areas = rectangle_areas(sides)
    for i in np.flatnonzero(~plain):
        areas[i] = shoelace(hull(_points(xs[i], ys[i])))
    return pa.array(areas)


@F.arrow_udf(DoubleType())
def _common_area(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    (p, one), (q, other) = rectangles(ax, ay), rectangles(bx, by)
    part = lambda i: np.maximum(0.0, np.minimum(p[:, i + 2], q[:, i + 2]) - np.maximum(p[:, i], q[:, i]))
    areas = part(0) * part(1)
    for i in np.flatnonzero(~(one & other)):
        areas[i] = shared(_points(ax[i], ay[i]), _points(bx[i], by[i]))
    return pa.array(areas)


def hull_area(points: Column) -> Column:
    """Area of the convex hull; 0 below three corners, points that are not finite left out."""
    return _hull_area(points["x"], points["y"])


def common_area(a: Column, b: Column) -> Column:
    """Area that two convex hulls share."""
    return _common_area(a["x"], a["y"], b["x"], b["y"])


class Polygons:
    """Many polygons in arrays: the corners of all one after the other, ``lengths`` to each."""

    def __init__(self, lengths: np.ndarray, xs: np.ndarray, ys: np.ndarray):
        self.lengths, self.xs, self.ys = lengths, xs, ys
        self.starts = np.cumsum(lengths) - lengths
        self.sides, self.plain = sides_of(lengths, xs, ys)

    def boxes(self) -> np.ndarray:
        """Bounding boxes (``n`` x 4); not numbers where there is no corner, and corners that are none do not count."""
        out, some = np.full((len(self.lengths), 4), np.nan), self.lengths > 0
        if some.any():
            sides = ((np.fmin, self.xs), (np.fmin, self.ys), (np.fmax, self.xs), (np.fmax, self.ys))
            out[some] = np.stack([f.reduceat(v, self.starts[some]) for f, v in sides], 1)
        return out

    def points(self, i: int) -> Points:
        at = slice(self.starts[i], self.starts[i] + self.lengths[i])
        return [p for p in zip(self.xs[at].tolist(), self.ys[at].tolist(), strict=True) if math.isfinite(p[0]) and math.isfinite(p[1])]

    def areas(self) -> np.ndarray:
        """As :func:`hull_area`."""
        out = rectangle_areas(self.sides)
        for i in np.flatnonzero(~self.plain):
            out[i] = shoelace(hull(self.points(i)))
        return out

    def common(self, other: Polygons, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As :func:`common_area`, of pairs ``i`` here and ``j`` of the other."""
        p, q = self.sides[i], other.sides[j]
        part = lambda k: np.maximum(0.0, np.minimum(p[:, k + 2], q[:, k + 2]) - np.maximum(p[:, k], q[:, k]))
        out = part(0) * part(1)
        for k in np.flatnonzero(~(self.plain[i] & other.plain[j])):
            out[k] = shared(self.points(i[k]), other.points(j[k]))
        return out


def touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether boxes, side by side, share an area."""
    return (a[:, 2] > b[:, 0]) & (b[:, 2] > a[:, 0]) & (a[:, 3] > b[:, 1]) & (b[:, 3] > a[:, 1])


def touching(docs: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes of one document that share an area, by their places in ``a`` and ``b``, both ascending by document.

    Where a document has more than ``DENSE`` boxes a side, those of ``b`` are looked at in order of their upper edge, and only
    from the first that may reach as far down as the box to the last that begins above its end. No more than ``most`` pairs, or
    those of one box, are held before those that meet are known.
    """
    low, high = (np.searchsorted(others, docs, side) for side in ("left", "right"))
    order = np.arange(len(b))
    rows = np.bincount(docs) if len(docs) else np.zeros(0, "int64")
    for d in np.flatnonzero(rows > DENSE):
        i = slice(*np.searchsorted(docs, [d, d + 1]))
        first, last = np.searchsorted(others, [d, d + 1])
        if last - first > DENSE:
            order[first:last] = first + np.argsort(b[first:last, 1], kind="stable")
            upper, lower = b[order[first:last], 1], np.fmax.accumulate(b[order[first:last], 3])
            low[i], high[i] = first + np.searchsorted(lower, a[i, 1], "right"), first + np.searchsorted(upper, a[i, 3])
    count = np.maximum(high - low, 0)
    total = np.cumsum(count)
    found, at = [(np.zeros(0, "int64"), np.zeros(0, "int64"))], 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = count[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:end], n)]
        met = touch(a[i], b[j])
        found.append((i[met], j[met]))
        at = end
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def upright(p: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Points of a page turned clockwise by ``degrees`` about its centre, on the canvas that then holds it.

    Quarter turns are exact; a turn of nothing leaves the points as they are.
    """
    # The turn is worked out once a polygon, not once a corner.
    at = lambda t, q: F.struct((t["c"] * q["x"] - t["s"] * q["y"] + t["dx"]).alias("x"), (t["s"] * q["x"] + t["c"] * q["y"] + t["dy"]).alias("y"))
    return F.when(F.pmod(degrees, F.lit(360.0)) == 0, p).otherwise(let(turn(width, height, degrees), lambda t: F.transform(p, lambda q: at(t, q)))).cast(POLYGON)


def turn(width: Column, height: Column, degrees: Column) -> Column:
    """What :func:`upright` does to a point: ``x`` becomes ``c x - s y + dx``, ``y`` becomes ``s x + c y + dy``."""
    snapped = lambda v: F.when(F.abs(v - F.rint(v)) < 1e-12, F.rint(v)).otherwise(v)
    c, s, size = snapped(F.cos(F.radians(degrees))), snapped(F.sin(F.radians(degrees))), upright_size(width, height, degrees)
    parts = {"c": c, "s": s, "dx": size["width"] / 2 - (c * width / 2 - s * height / 2), "dy": size["height"] / 2 - (s * width / 2 + c * height / 2)}
    none = F.pmod(degrees, F.lit(360.0)) == 0
    return F.struct(*(F.when(none, float(n == "c")).otherwise(v).alias(n) for n, v in parts.items()))


def upright_size(width: Column, height: Column, degrees: Column) -> Column:
    """Whole numbers, halves to even."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    r = lambda v: F.bround(v, 0).cast("int")
    return F.struct(r(width * c + height * s).alias("width"), r(width * s + height * c).alias("height"))


def quad_of_box(p: Column) -> Column:
    """The corners of the bounding box, from the upper left clockwise."""
    b = bounding_box(p)
    corner = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))


def part_of_quad(q: Column, start: Column, end: Column) -> Column:
    """The part of a line's four corners (from the upper left clockwise) between two shares of its width."""
    along = lambda a, b, t: F.struct((q[a]["x"] + (q[b]["x"] - q[a]["x"]) * t).alias("x"), (q[a]["y"] + (q[b]["y"] - q[a]["y"]) * t).alias("y"))
    return F.array(along(0, 1, start), along(0, 1, end), along(3, 2, end), along(3, 2, start))


def meeting(left: DataFrame, right: DataFrame, doc: str, polygon: str, other: str, width: str = "width", height: str = "height") -> DataFrame:
    """Pairs of a document's rows whose bounding boxes share an area: ``left`` and ``right`` side by side.

    Documents of up to ``DENSE`` rows a side are joined as they are, so nothing is written but the rows.  Larger ones are
    dealt by document and cell of a ``GRID`` x ``GRID`` page (what lies outside counts to its
    border), so a row has at most ``GRID``\\ :sup:`2` cells whatever its size; a pair meets in one cell alone, the
    first that both boxes have.  ``width`` and ``height`` are columns of both sides.
    """
    dense = None
    for df in (left, right):
        found = df.groupBy(doc).count().where(F.col("count") > DENSE).select(doc)
        dense = found if dense is None else dense.union(found).distinct()
    dense = materialize(dense, "dense-documents")
    a, b = (df.where(F.size(p) > 0).withColumn(n, bounding_box(F.col(p))) for df, p, n in ((left, polygon, "__bl"), (right, other, "__br")))
    b = b.drop(*({width, height} & set(left.columns)))
    l, r = F.col("__bl"), F.col("__br")
    touch = (l["x1"] > r["x0"]) & (r["x1"] > l["x0"]) & (l["y1"] > r["y0"]) & (r["y1"] > l["y0"])
    if dense.isEmpty():
        return a.join(b.hint("merge"), doc).where(touch).drop("__bl", "__br")
    few = a.join(dense, doc, "left_anti").join(b.hint("merge"), doc).where(touch).drop("__bl", "__br")

    def cells(df: DataFrame, p: str, tag: str) -> DataFrame:
        box = bounding_box(F.col(p))
        place = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(v * GRID / F.greatest(size, F.lit(1))))).cast("int")
        boxed = df.join(dense, doc, "left_semi").where(F.size(p) > 0).withColumn(f"__b{tag}", box)
        b = F.col(f"__b{tag}")
        low = boxed.withColumns({f"__x{tag}": place(b["x0"], F.col(width)), f"__y{tag}": place(b["y0"], F.col(height))})
        across = F.explode(F.sequence(F.col(f"__x{tag}"), place(b["x1"], F.col(width)))).alias("__cx")
        return low.select("*", across).select("*", F.explode(F.sequence(F.col(f"__y{tag}"), place(b["y1"], F.col(height)))).alias("__cy"))

    a, b = cells(left, polygon, "l"), cells(right, other, "r").drop(*({width, height} & set(left.columns)))
    met = a.join(b.hint("merge"), [doc, "__cx", "__cy"]).where((F.col("__cx") == F.greatest("__xl", "__xr")) & (F.col("__cy") == F.greatest("__yl", "__yr")))
    return few.unionByName(met.where(touch).drop("__cx", "__cy", "__bl", "__br", "__xl", "__yl", "__xr", "__yr"))
