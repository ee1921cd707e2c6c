"""Expressions on points, grid cells and pixels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Fixed values of the data model.
ROOF_COLOR = 16716049
RGB_MASK = 0x00FFFFFF
OPAQUE_BLACK = -16777216
INT_MIN, INT_MAX = -2147483648, 2147483647


def base_name(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


def half_up(value: Column) -> Column:
    """Nearest integer, halves upward."""
    return F.floor(value + F.lit(0.5))


def grid_width(n: Column, min_x: Column, max_x: Column, min_y: Column, max_y: Column) -> Column:
    """Columns of the height grid; the point count is taken one higher than it is."""
    ratio = (max_x - min_x) / (max_y - min_y)
    return half_up(F.sqrt((n + 1) * ratio)).cast("int")


def grid_height(n: Column, min_x: Column, max_x: Column, min_y: Column, max_y: Column) -> Column:
    """Rows of the height grid."""
    ratio = (max_x - min_x) / (max_y - min_y)
    return half_up(F.sqrt((n + 1) / ratio)).cast("int")


def x_scale() -> Column:
    """Cells per unit of x."""
    return (F.col("w") - 1) / (F.col("max_x") - F.col("min_x"))


def y_scale() -> Column:
    """Cells per unit of y."""
    return (F.col("h") - 1) / (F.col("max_y") - F.col("min_y"))


def cell_x() -> Column:
    return half_up(x_scale() * (F.col("x") - F.col("min_x"))).cast("int")


def cell_y() -> Column:
    """Row of a point; rows count downward from the greatest y."""
    return (F.col("h") - half_up(y_scale() * (F.col("y") - F.col("min_y"))) - 1).cast("int")


def cell_height() -> Column:
    """Height above the lowest point, in units of one cell's width."""
    return x_scale() * (F.col("z") - F.col("min_z"))


def wrap_int(value: Column) -> Column:
    """A bigint wrapped to the signed 32-bit range."""
    span = F.lit(1 << 32).cast("bigint")
    half = F.lit(1 << 31).cast("bigint")
    return (F.pmod(value + half, span) - half).cast("int")


def dem_color() -> Column:
    """Elevation as opaque black plus the truncated, scaled z. The product saturates at
    the 32-bit range, the sum wraps."""
    scaled = x_scale() * 1000 * F.col("z")
    clamped = F.greatest(F.least(scaled, F.lit(float(INT_MAX))), F.lit(float(INT_MIN)))
    whole = F.when(F.isnan(scaled), F.lit(0.0)).otherwise(clamped).cast("bigint")
    return wrap_int(whole + F.lit(OPAQUE_BLACK).cast("bigint"))


def rgb(argb: Column) -> Column:
    return argb.bitwiseAND(F.lit(RGB_MASK))


def in_mask(argb: Column, color: int = ROOF_COLOR) -> Column:
    return rgb(argb) == F.lit(color)


def band(argb: Column, color: Column | int) -> Column:
    """White where the pixel has the colour, 0 elsewhere."""
    color = F.lit(color) if isinstance(color, int) else color
    return F.when(rgb(argb) == color, F.lit(-1)).otherwise(F.lit(0))


def intensity(argb: Column) -> Column:
    """Mean of red, green and blue."""
    red = F.shiftright(argb, 16).bitwiseAND(F.lit(255))
    green = F.shiftright(argb, 8).bitwiseAND(F.lit(255))
    blue = argb.bitwiseAND(F.lit(255))
    return (red + green + blue) / F.lit(3.0)


def face_color(index: Column, n: Column) -> Column:
    """Display colour of the face at position ``index`` when ``n`` faces share the range."""
    return ((index + 1) * (F.lit(16777215.0) / n + 1)).cast("int")


def first_target(source: Column, target_size: Column, source_size: Column) -> Column:
    """First target column whose nearest source column is ``source`` or later.

    Target column t takes source column floor((t + 0.5) * source_size / target_size);
    this is its inverse, in whole numbers.
    """
    two = F.lit(2).cast("bigint")
    top = two * source * target_size + source_size - 1
    return F.floor(top / (two * source_size)).cast("bigint")


def cell_id(px: Column, py: Column) -> Column:
    """One number per cell; numbers sort by row, then column."""
    return F.shiftleft(py.cast("bigint"), 32).bitwiseOR(px.cast("bigint"))


def cell_px(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def cell_py(cell: Column) -> Column:
    return F.shiftright(cell, 32).cast("int")


def seed_key(ncurv: Column, cell: Column) -> Column:
    """Curvature (to 9 places, 0 or more), then cell, as one decimal: the least is the better seed. Unlike a pair, a decimal can be aggregated by hashing."""
    return F.round(ncurv * 1e9).cast("decimal(18,0)") * F.lit(Decimal(1 << 64)) + cell.cast("decimal(20,0)")


def seed_parts(key: Column) -> tuple[Column, Column]:
    """Curvature and cell of a seed's key; null for null."""
    whole = F.floor(key / F.lit(Decimal(1 << 64))).cast("decimal(18,0)")
    return whole.cast("double") / 1e9, (key - whole * F.lit(Decimal(1 << 64))).cast("bigint")
