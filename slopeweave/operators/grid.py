"""Points and pixels to grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.functions import cells as fc
from slopeweave.operators.joins import attach
from slopeweave.operators.ranking import first_by

CELL = ["tile_id", "px", "py"]

# Side of the squares from which the cells of a tile are generated.
GENERATE_SQUARE = 256
# Cells that one task aggregates, about.
CELLS_AT_ONCE = 1 << 20
# Tiles whose sizes are sent to every task; of more tiles the sizes are shuffled with the pixels.
TILES_TO_SEND = 100_000


def extents(points: DataFrame) -> DataFrame:
    """Point count and bounds of every tile."""
    bounds = [f(axis).alias(f"{name}_{axis}") for axis in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("tile_id").agg(F.count("*").alias("n"), *bounds)


def grid_size(ext: DataFrame) -> DataFrame:
    """Add grid width and height. Tiles without an area have no grid and are left out."""
    bounds = [F.col(c) for c in ("n", "min_x", "max_x", "min_y", "max_y")]
    return (ext.filter("max_x > min_x AND max_y > min_y")
            .withColumns({"w": fc.grid_width(*bounds), "h": fc.grid_height(*bounds)})
            .filter("w > 0 AND h > 0"))


def to_cell(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cell and height of every point; ``tiles`` is a written table."""
    return (attach(points, tiles, ["tile_id"])
            .select("tile_id", "seq", fc.cell_x().alias("px"), fc.cell_y().alias("py"),
                    fc.cell_height().alias("height")))


def grid_cells(tiles: DataFrame) -> DataFrame:
    """Every cell of every tile's grid. A large tile is generated by many tasks."""
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = GENERATE_SQUARE

    def spread(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / side).cast("int")))

    def within(block: str, size: str) -> Column:
        first = F.col(block) * side
        return F.explode(F.sequence(first, F.least(first + (side - 1), F.col(size) - 1)))

    return (tiles.select("tile_id", "w", "h", spread("w").alias("bx"))
            .select("*", spread("h").alias("by"))
            .repartition(parts, "tile_id", "bx", "by")
            .select("*", within("bx", "w").alias("px"))
            .select("tile_id", "px", within("by", "h").alias("py")))


def cells_together(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """The rows of a cell in one task, about ``CELLS_AT_ONCE`` cells in each.

    Sources hardly repeat a cell, so aggregating them before the shuffle would only hold the cells of a task's
    whole input in memory.
    """
    cells = tiles.agg(F.sum(F.col("w").cast("bigint") * F.col("h"))).first()[0] or 0
    parts = -(-cells // CELLS_AT_ONCE)
    if parts > int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(parts, *CELL)
    return rows.repartition(*CELL)


def height_grid(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Height of every cell: that of the last point in it, 0.0 where there is none.

    Points and empty cells meet in one aggregation, so there is one shuffle and no join.
    """
    empty = grid_cells(tiles).select(*CELL, F.lit(-1).cast("bigint").alias("seq"), F.lit(0.0).alias("height"))
    return (cells_together(to_cell(points, tiles).unionByName(empty), tiles)
            .groupBy(*CELL).agg(F.max_by("height", "seq").alias("height")))


def dem_pixels(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Elevation colour of every cell; the last point wins, empty cells are opaque black."""
    hits = attach(points, tiles, ["tile_id"]).select(
        "tile_id", fc.cell_x().alias("px"), fc.cell_y().alias("py"), "seq", fc.dem_color().alias("argb"))
    empty = grid_cells(tiles).select(
        *CELL, F.lit(-1).cast("bigint").alias("seq"), F.lit(fc.OPAQUE_BLACK).alias("argb"))
    return cells_together(hits.unionByName(empty), tiles).groupBy(*CELL).agg(F.max_by("argb", "seq").alias("argb"))


def image_size(pixels: DataFrame) -> DataFrame:
    """Width and height of every tile's image."""
    return pixels.groupBy("tile_id").agg(
        (F.max("px") + 1).alias("src_w"), (F.max("py") + 1).alias("src_h"))


def resample(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nearest-cell resampling from ``src_w`` x ``src_h`` to ``w`` x ``h``.

    Every source pixel is sent to the targets that take it, so nothing is joined but the
    sizes, a written table ``(tile_id, src_w, src_h, w, h)``. How the sizes are joined goes by their
    number: Spark may take generated or well compressed pixels for the smaller side and would send those to the driver.
    """
    others = [c for c in pixels.columns if c not in CELL]

    def targets(axis: str, size: str, source: str) -> tuple[Column, Column]:
        at, to, of = F.col(axis), F.col(size), F.col(source)
        return fc.first_target(at, to, of), fc.first_target(at + 1, to, of) - 1

    x0, x1 = targets("px", "w", "src_w")
    y0, y1 = targets("py", "h", "src_h")
    few = sizes.limit(TILES_TO_SEND + 1).count() <= TILES_TO_SEND
    named = sizes.select("tile_id", "src_w", "src_h", "w", "h").hint("broadcast" if few else "merge")
    return (attach(pixels, named, ["tile_id"])
            .select("tile_id", *others, x0.cast("int").alias("_x0"), x1.cast("int").alias("_x1"),
                    y0.cast("int").alias("_y0"), y1.cast("int").alias("_y1"))
            .filter("_x0 <= _x1 AND _y0 <= _y1")
            .select("*", F.explode(F.sequence("_x0", "_x1")).alias("px"))
            .select("*", F.explode(F.sequence("_y0", "_y1")).alias("py"))
            .select(*CELL, *others))


def extract_band(pixels: DataFrame, color: Column | int) -> DataFrame:
    """White pixels where the colour is met, 0 elsewhere."""
    return pixels.withColumn("argb", fc.band(F.col("argb"), color))


def match_inputs(height_maps: DataFrame, outlines: DataFrame, rasters: DataFrame) -> DataFrame:
    """Height-map files with the first outline and the first raster of the same base name."""
    def first(files: DataFrame, name: str) -> DataFrame:
        return first_by(files.select("tile_id", F.col("path").alias(name)), ["tile_id"], [name])

    return (height_maps.select("tile_id", F.col("path").alias("height_map"))
            .join(first(outlines, "outline"), "tile_id").join(first(rasters, "raster"), "tile_id"))


def segment_cells(points: DataFrame, outline: DataFrame, raster: DataFrame, tiles: DataFrame,
                  roof_color: int = fc.ROOF_COLOR) -> DataFrame:
    """Height, roof mask and intensity of every cell, met in one aggregation.

    ``tiles`` is a written table with the grid size and the sizes of both images
    (``outline_w``, ``outline_h``, ``raster_w``, ``raster_h``).
    """
    def sizes(image: str) -> DataFrame:
        return tiles.select("tile_id", F.col(f"{image}_w").alias("src_w"), F.col(f"{image}_h").alias("src_h"),
                            "w", "h")

    no_seq, no_height = F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("height")
    no_mask, no_light = F.lit(None).cast("boolean").alias("mask"), F.lit(None).cast("double").alias("light")
    heights = to_cell(points, tiles).select(*CELL, "seq", "height", no_mask, no_light)
    empty = grid_cells(tiles).select(
        *CELL, F.lit(-1).cast("bigint").alias("seq"), F.lit(0.0).alias("height"), no_mask, no_light)
    roof = outline.filter(fc.in_mask(F.col("argb"), roof_color)).select(*CELL, F.lit(True).alias("mask"))
    masks = resample(roof, sizes("outline")).select(*CELL, no_seq, no_height, "mask", no_light)
    shades = raster.select(*CELL, fc.intensity(F.col("argb")).alias("light"))
    lights = resample(shades, sizes("raster")).select(*CELL, no_seq, no_height, no_mask, "light")
    return (
        cells_together(heights.unionByName(empty).unionByName(masks).unionByName(lights), tiles)
        .groupBy(*CELL)
        .agg(F.max_by("height", "seq").alias("height"),
             F.coalesce(F.max("mask"), F.lit(False)).alias("in_mask"),
             F.coalesce(F.max("light"), F.lit(0.0)).alias("intensity"))
    )


def masked(cells: DataFrame) -> DataFrame:
    return cells.filter("in_mask")
