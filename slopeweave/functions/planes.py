"""Plane fit from second moments, in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

MOMENTS = ["n", "sx", "sy", "sh", "sxx", "sxy", "syy", "sxh", "syh", "shh"]


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of two vectors given by their components."""
    def dot(p: list[Column], q: list[Column]) -> Column:
        total = p[0] * q[0]
        for s, t in zip(p[1:], q[1:]):
            total = total + s * t
        return total

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_arrays(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length."""
    def dot(p: Column, q: Column) -> Column:
        products = F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def moved_to(df: DataFrame, dx: str, dy: str) -> DataFrame:
    """The same point sets with moments about an origin moved by (-dx, -dy), given as SQL."""
    moved = {
        "sx": f"sx + n * {dx}", "sy": f"sy + n * {dy}",
        "sxx": f"sxx + 2 * {dx} * sx + n * {dx} * {dx}", "syy": f"syy + 2 * {dy} * sy + n * {dy} * {dy}",
        "sxy": f"sxy + {dx} * sy + {dy} * sx + n * {dx} * {dy}",
        "sxh": f"sxh + {dx} * sh", "syh": f"syh + {dy} * sh",
    }
    return df.selectExpr(*[f"{moved[c]} AS {c}" if c in moved else f"`{c}`" for c in df.columns])


def with_covariance(df: DataFrame) -> DataFrame:
    """Add the six entries of the sample covariance of (x, y, height)."""
    entries = {"cxx": ("sxx", "sx", "sx"), "cxy": ("sxy", "sx", "sy"), "cyy": ("syy", "sy", "sy"),
               "cxh": ("sxh", "sx", "sh"), "cyh": ("syh", "sy", "sh"), "chh": ("shh", "sh", "sh")}
    return df.selectExpr("*", *[
        f"coalesce(try_divide({ab} - {a} * {b} / n, CAST(n - 1 AS DOUBLE)), 0.0D) AS {name}"
        for name, (ab, a, b) in entries.items()])


# The fit in steps: each list of expressions sees the columns of those before it.
_TURN = repr(2.0 * math.pi / 3.0)
_STEPS = [
    ["(cxx + cyy + chh) / 3 AS _q"],
    ["cxx - _q AS _a", "cyy - _q AS _b", "chh - _q AS _c"],
    ["sqrt((_a * _a + _b * _b + _c * _c + 2 * (cxy * cxy + cxh * cxh + cyh * cyh)) / 6) AS _p",
     "_a * (_b * _c - cyh * cyh) - cxy * (cxy * _c - cyh * cxh) + cxh * (cxy * cyh - _b * cxh) AS _det"],
    ["acos(greatest(least(coalesce(try_divide(_det, 2 * _p * _p * _p), 0.0D), 1.0D), -1.0D)) / 3 AS _phi"],
    [f"greatest(_q + 2 * _p * cos(_phi + {_TURN}D), 0.0D) AS _l3"],
    ["cxx - _l3 AS _r", "cyy - _l3 AS _s", "chh - _l3 AS _t"],
    # cross products of the rows (_r, cxy, cxh), (cxy, _s, cyh), (cxh, cyh, _t)
    ["cxy * cyh - cxh * _s AS _x1", "cxh * cxy - _r * cyh AS _y1", "_r * _s - cxy * cxy AS _z1",
     "cxy * _t - cxh * cyh AS _x2", "cxh * cxh - _r * _t AS _y2", "_r * cyh - cxy * cxh AS _z2",
     "_s * _t - cyh * cyh AS _x3", "cyh * cxh - cxy * _t AS _y3", "cxy * cyh - _s * cxh AS _z3"],
    [f"_x{i} * _x{i} + _y{i} * _y{i} + _z{i} * _z{i} AS _n{i}" for i in (1, 2, 3)],
    ["greatest(_n1, _n2, _n3) AS _nn"],
    [f"coalesce(round(try_divide(CASE WHEN _n1 = _nn THEN _{axis}1 WHEN _n2 = _nn THEN _{axis}2 ELSE _{axis}3 END, "
     f"sqrt(_nn)), 9), {default}) AS _v{axis}" for axis, default in (("x", "0.0D"), ("y", "0.0D"), ("z", "1.0D"))],
    ["CASE WHEN _vz < 0 OR (_vz = 0 AND _vx < 0) OR (_vz = 0 AND _vx = 0 AND _vy < 0) THEN -1.0D ELSE 1.0D END AS _sign"],
]


def with_plane(df: DataFrame) -> DataFrame:
    """Add ``curv`` and the unit normal ``nx, ny, nz`` of the moments in each row.

    ``curv`` is the least eigenvalue's share of the trace. The normal belongs to the least
    eigenvalue and is turned so that nz > 0 (or nz = 0 and nx > 0, or both 0 and ny > 0).
    """
    fitted = with_covariance(df)
    for step in _STEPS:
        fitted = fitted.selectExpr("*", *step)
    return fitted.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "coalesce(try_divide(_l3, 3 * _q), 0.0D) AS curv",
        "_sign * _vx + 0.0D AS nx", "_sign * _vy + 0.0D AS ny", "_sign * _vz + 0.0D AS nz")


def slope(nz: Column) -> Column:
    """Degrees between a unit normal and the vertical."""
    return F.degrees(F.acos(F.least(F.abs(nz), F.lit(1.0))))


def azimuth(nx: Column, ny: Column, compass: bool = False) -> Column:
    """Bearing of a normal by quadrant, in degrees; NaN when it points straight up.

    For nx < 0 and ny >= 0 the bearing is 270 - t; ``compass=True`` gives 180 + t.
    """
    t = F.degrees(F.atan2(F.abs(nx), F.abs(ny)))
    southwest = (F.lit(180.0) + t) if compass else (F.lit(270.0) - t)
    return (F.when((nx == 0) & (ny == 0), F.lit(float("nan")))
            .when((nx < 0) & (ny < 0), F.lit(360.0) - t)
            .when(nx < 0, southwest)
            .when(ny >= 0, F.lit(180.0) - t)
            .otherwise(t))
