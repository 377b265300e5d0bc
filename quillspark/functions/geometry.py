"""Geometry of boxes, polygons, rotations and affine maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import let


def points(flat: Column) -> Column:
    """``x0 y0 x1 y1 ...`` as points, without a closing point equal to the first."""
    n = (F.size(flat) / 2).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(flat[2 * i].alias("x"), flat[2 * i + 1].alias("y")))
    return let(all_, lambda a: F.when((F.size(a) > 1) & (a[0] == F.element_at(a, -1)), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))


def bounding_box(pts: Column) -> Column:
    xs, ys = pts["x"], pts["y"]
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def polygon_area(pts: Column) -> Column:
    """Shoelace."""
    term = lambda q, i: q[i]["x"] * q[F.pmod(i + 1, F.size(q))]["y"] - q[F.pmod(i + 1, F.size(q))]["x"] * q[i]["y"]
    return let(pts, lambda q: F.abs(F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.lit(0.0), lambda s, i: s + term(q, i))) / 2)


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two upright boxes ``x0, y0, x1, y1``."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def cover_of_smaller(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    small = F.least(area(a), area(b))
    return F.when(small > 0, overlap_area(a, b) / small).otherwise(F.lit(0.0))


def circular_error(a: Column, b: Column) -> Column:
    """Degrees between two angles, at most 180."""
    d = F.pmod(a - b, F.lit(360.0)) + 0.0  # no negative zero
    return F.least(d, 360.0 - d)


def right_angle(a: Column) -> Column:
    """The nearest of 0, 90, 180, 270, halves to even."""
    return (F.pmod(F.bround(a / 90, 0).cast("int"), F.lit(4)) * 90).cast("int")


def scaled_box(v: Column, size: Column) -> Column:
    """A coordinate on 0 to 1000."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(v * 1000 / size, 0).cast("int")))


def matmul(a: Column, b: Column) -> Column:
    """Product of two 3x3 matrices as arrays of nine."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def inverse(m: Column) -> Column:
    """Inverse of a 3x3 matrix as an array of nine; null where singular."""
    minor = lambda r, c: m[3 * ((r + 1) % 3) + (c + 1) % 3] * m[3 * ((r + 2) % 3) + (c + 2) % 3] - m[3 * ((r + 1) % 3) + (c + 2) % 3] * m[3 * ((r + 2) % 3) + (c + 1) % 3]
    det = m[0] * minor(0, 0) + m[1] * minor(0, 1) + m[2] * minor(0, 2)
    return F.when(det != 0, F.array(*(minor(c, r) / det for r in range(3) for c in range(3))))


def apply(m: Column, x: Column, y: Column) -> Column:
    w = m[6] * x + m[7] * y + m[8]
    return F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y"))


def rotated_canvas(width: Column, height: Column, degrees: Column) -> Column:
    """Size of the canvas that holds a rotated page."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    r = lambda v: F.ceil(F.round(v, 6)).cast("int")
    return F.struct(r(width * c + height * s).alias("width"), r(width * s + height * c).alias("height"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(values: Column) -> Column:
    """A bit per value of a grid above its mean, the first highest (at most 63 values)."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc * 2 + F.when(v > mean, 1).otherwise(0))


def rms_difference(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(total / F.size(a))
