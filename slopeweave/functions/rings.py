"""Expressions on polygon rings, arrays of [x, y] that end where they start."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring: positive when x turns toward y. Corners are counted from the first one, so that large coordinates
    cost no digits."""
    start = F.get(ring, F.lit(0))

    def cross(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        x, y = (lambda c: F.get(c, F.lit(0)) - F.get(start, F.lit(0))), (lambda c: F.get(c, F.lit(1)) - F.get(start, F.lit(1)))
        return x(p) * y(q) - x(q) * y(p)

    corners = F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(corners, F.lit(0.0), lambda total, i: total + cross(i)) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less that of the others."""
    outer = F.abs(ring_area(F.get(rings, F.lit(0))))
    holes = F.aggregate(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.abs(ring_area(r))),
                        F.lit(0.0), lambda total, a: total + a)
    return outer - holes


def closed_ring(xs: Column, ys: Column) -> Column:
    """A closed ring from its corners, starting at the corner of least y, then x."""
    corner = F.zip_with(ys, xs, lambda y, x: F.struct(y.alias("y"), x.alias("x")))
    first = F.array_position(corner, F.array_min(corner)).cast("int")
    turned = F.concat(F.slice(corner, first, F.size(corner)), F.slice(corner, 1, first))
    return F.transform(turned, lambda c: F.array(c["x"].cast("double"), c["y"].cast("double")))


def moved_rings(rings: Column) -> Column:
    """Rings through the affine transform in columns m00 .. m12."""
    def point(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.array(F.col("m00") * x + F.col("m01") * y + F.col("m02"),
                       F.col("m10") * x + F.col("m11") * y + F.col("m12"))

    return F.transform(rings, lambda ring: F.transform(ring, point))
