"""Local plane at every masked cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.functions.planes import MOMENTS, with_plane
from slopeweave.operators.blocks import SIDE, Window, by_group, nearest, reach, reach_column, with_blocks
from slopeweave.operators.joins import attach
from slopeweave.session import cut

_SUMS = MOMENTS[1:]
_SCHEMA = ("tile_id STRING, knn INT, px INT, py INT, height DOUBLE, intensity DOUBLE, n INT, "
           + ", ".join(f"{m} DOUBLE" for m in _SUMS))


def _block_moments(ks: list[int], side: int):
    """Moments around the masked cells of one block, for every k."""

    def moments(key: tuple, block: pa.Table) -> pa.Table:
        tile_id, bx, by = (v.as_py() for v in key)
        px, py, height, masked = (block[c].to_numpy() for c in ("px", "py", "height", "in_mask"))
        w, h = block["w"][0].as_py(), block["h"][0].as_py()
        rows = np.flatnonzero(masked & (px // side == bx) & (py // side == by))
        where = np.empty(len(px), dtype=np.int64)
        where[rows] = np.arange(len(rows))
        window = Window(px, py, max(reach(k, w, h) for k in ks)) if len(rows) else None
        n = np.zeros((len(ks), len(rows)), dtype=np.int32)
        sums = {m: np.zeros((len(ks), len(rows))) for m in _SUMS}
        for i, k in enumerate(ks):
            for some, steps, used in nearest(px, py, rows, k, w, h):
                at = (i, where[some])
                weight = used.astype(np.float64)
                dx, dy = steps[:, 0].astype(np.float64), steps[:, 1].astype(np.float64)
                rise = (height[window.shifted(some, steps)] - height[some][:, None]) * weight
                n[at] = used.sum(axis=1)
                for name, value in (("sx", dx), ("sy", dy), ("sxx", dx * dx), ("sxy", dx * dy), ("syy", dy * dy)):
                    sums[name][at] = weight @ value
                sums["sxh"][at], sums["syh"][at] = rise @ dx, rise @ dy
                sums["sh"][at], sums["shh"][at] = rise.sum(axis=1), np.einsum("ij,ij->i", rise, rise)
        times = len(ks)
        own = {c: np.tile(block[c].to_numpy()[rows], times) for c in ("px", "py", "height", "intensity")}
        return pa.table({
            "tile_id": pa.array([tile_id] * (len(rows) * times), pa.string()),
            "knn": np.repeat(np.array(ks, dtype=np.int32), len(rows)), **own,
            "n": n.ravel(), **{m: s.ravel() for m, s in sums.items()}})

    return moments


def local_moments(cells: DataFrame, tiles: DataFrame, knn: list[int], side: int = SIDE) -> DataFrame:
    """Moments of (px, py, height) over the k nearest cells of each masked cell, for every k.

    The k nearest include the cell itself and unmasked cells; ties go by column, then row.
    Offsets are taken from the cell, and heights from its height. One shuffle of little more
    than the cells serves every k; the cell's own height and intensity are passed on.
    """
    ks = sorted({int(k) for k in knn})
    widest = F.greatest(*[reach_column(F.lit(k), F.col("w"), F.col("h")) for k in [ks[0], *ks]])
    sizes = tiles.select("tile_id", "w", "h", widest.alias("halo"))
    placed = attach(cells.select("tile_id", "px", "py", "height", "in_mask", "intensity"), sizes, ["tile_id"])
    return by_group(with_blocks(placed, F.col("halo"), side).drop("halo"), ["tile_id", "bx", "by"], _block_moments(ks, side), _SCHEMA)


def fit_planes(cells: DataFrame, tiles: DataFrame, knn: list[int], side: int = SIDE) -> DataFrame:
    """Curvature and unit normal of every masked cell, for every k."""
    return with_plane(local_moments(cells, tiles, knn, side)).select(
        "tile_id", "knn", "px", "py", "height", "intensity", "curv", "nx", "ny", "nz")


def curvature_range(fits: DataFrame, tiles: DataFrame) -> DataFrame:
    """Least and greatest curvature and its sum over the whole grid; unmasked cells count as 0."""
    seen = fits.groupBy("tile_id", "knn").agg(
        F.min("curv").alias("low"), F.max("curv").alias("high"), F.sum("curv").alias("total"),
        F.count("*").alias("fitted"))
    partial = F.col("fitted") < F.col("w").cast("bigint") * F.col("h")
    return (seen.join(tiles.select("tile_id", "w", "h"), "tile_id")
            .select("tile_id", "knn", "w", "h", "total",
                    F.when(partial, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"),
                    F.when(partial, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high")))


def _scaled(value: Column) -> Column:
    return F.coalesce(F.try_divide(value - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))


def normalize(fits: DataFrame, tiles: DataFrame) -> DataFrame:
    """Add ``ncurv``, curvature scaled to 0..1 over the whole grid, to 9 places. 0.0 where all
    curvatures are equal."""
    ranges = cut(curvature_range(fits, tiles).select("tile_id", "knn", "low", "high"), "ranges")
    return (attach(fits, ranges, ["tile_id", "knn"])
            .withColumn("ncurv", F.round(_scaled(F.col("curv")), 9)).drop("low", "high"))


def curvature_stats(fits: DataFrame, tiles: DataFrame) -> DataFrame:
    """Greatest, least and mean normalised curvature of the whole grid."""
    mean = F.col("total") / (F.col("w").cast("double") * F.col("h"))
    return curvature_range(fits, tiles).select(
        "tile_id", "knn", _scaled(F.col("high")).alias("max_ncurv"), _scaled(F.col("low")).alias("min_ncurv"),
        _scaled(mean).alias("mean_ncurv"))
