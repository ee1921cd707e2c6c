"""Statistics and orientation of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.functions.cells import cell_px, cell_py, seed_key, seed_parts
from slopeweave.functions.planes import azimuth, moved_to, slope, with_plane
from slopeweave.operators.growth import SCOPE

REGION = [*SCOPE, "region_id"]
SUMS = ["sum_curv", "sum_x", "sum_y", "sum_color", "sx", "sy", "sh", "sxx", "sxy", "syy", "sxh", "syh", "shh"]


def region_stats(region_cells: DataFrame) -> DataFrame:
    """Size, running sums, seed and moments of every region.

    Moments are taken from the cell that names the region, so they stay small in any tile.
    """
    x, y = cell_px(F.col("cell_id")), cell_py(F.col("cell_id"))
    dx = (x - cell_px(F.col("region_id"))).cast("double")
    dy = (y - cell_py(F.col("region_id"))).cast("double")
    height = F.col("height")
    sums = {"sum_curv": F.col("ncurv"), "sum_x": x.cast("bigint"), "sum_y": y.cast("bigint"),
            "sum_color": F.col("intensity"), "sx": dx, "sy": dy, "sh": height, "sxx": dx * dx, "sxy": dx * dy,
            "syy": dy * dy, "sxh": dx * height, "syh": dy * height, "shh": height * height}
    seed = F.min(F.when(F.col("anchor"), seed_key(F.col("ncurv"), F.col("cell_id"))))
    seed_ncurv, seed_id = seed_parts(F.col("_seed"))
    return (region_cells.groupBy(*REGION)
            .agg(F.count("*").alias("size"), *[F.sum(sums[s]).alias(s) for s in SUMS], seed.alias("_seed"))
            .select(*REGION, "size", *SUMS, seed_ncurv.alias("seed_ncurv"), seed_id.alias("seed_id")))


def region_means(regions: DataFrame) -> DataFrame:
    """Add mean curvature and colour, and the centre, truncated to whole cells."""
    return regions.withColumns({
        "curvature": F.col("sum_curv") / F.col("size"),
        "color": F.col("sum_color") / F.col("size"),
        "cx": F.expr("CAST(sum_x DIV size AS INT)"),
        "cy": F.expr("CAST(sum_y DIV size AS INT)"),
    })


def region_attrs(regions: DataFrame, compass: bool = False) -> DataFrame:
    """Add the plane's surface variation, slope and azimuth. One cell lies flat and keeps its
    own curvature."""
    fitted = with_plane(regions.withColumn("n", F.col("size").cast("double"))).drop("n")
    alone = F.col("size") == 1
    return (fitted.withColumn("curv", F.when(alone, F.col("sum_curv")).otherwise(F.col("curv")))
            .withColumns({"slope": slope(F.col("nz")), "azimuth": azimuth(F.col("nx"), F.col("ny"), compass)}))


def split_by_size(regions: DataFrame, limit: Column | int) -> tuple[DataFrame, DataFrame]:
    """Regions above the size limit, and the others."""
    return regions.filter(F.col("size") > limit), regions.filter(F.col("size") <= limit)


def size_order() -> list[Column]:
    """Largest first; ties in the order of the seeds."""
    return [F.col("size").desc(), F.col("seed_ncurv"), F.col("seed_id")]


def combine(regions: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Add every absorbed region ``(region_id, absorber)`` to its absorber. Sums add up after
    the moments are moved to the absorber's origin."""
    target = F.coalesce("absorber", "region_id")
    kept = F.col("region_id") == F.col("_target")
    moved = regions.join(absorbed, REGION, "left").withColumns({"_target": target, "n": F.col("size").cast("double")})
    moved = moved.withColumns({
        "_dx": (cell_px(F.col("region_id")) - cell_px(F.col("_target"))).cast("double"),
        "_dy": (cell_py(F.col("region_id")) - cell_py(F.col("_target"))).cast("double")})
    moved = moved_to(moved, "_dx", "_dy")
    return (moved.groupBy(*SCOPE, F.col("_target"))
            .agg(F.sum("size").alias("size"), *[F.sum(s).alias(s) for s in SUMS],
                 F.max(F.when(kept, F.col("seed_ncurv"))).alias("seed_ncurv"),
                 F.max(F.when(kept, F.col("seed_id"))).alias("seed_id"))
            .withColumnRenamed("_target", "region_id"))
