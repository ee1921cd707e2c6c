"""Point clouds, roof outlines and orthophotos to faces with slope and azimuth."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, functions as F

from slopeweave.functions.cells import ROOF_COLOR, cell_px, cell_py
from slopeweave.operators.absorb import absorb_small
from slopeweave.operators.faces import to_crs, vectorize
from slopeweave.operators.fit import fit_planes, normalize
from slopeweave.operators.grid import extents, grid_size, image_size, resample, segment_cells
from slopeweave.operators.growth import SCOPE, grow_regions
from slopeweave.operators.joins import attach
from slopeweave.operators.merging import merge_regions
from slopeweave.operators.ranking import with_position
from slopeweave.operators.regions import REGION, region_stats
from slopeweave.session import cut
from slopeweave.sources.tables import clean_params, valid_params

FACES = "param_id INT, apn STRING, feature_id BIGINT, srid INT, rings ARRAY<ARRAY<ARRAY<DOUBLE>>>, slope DOUBLE, azimuth DOUBLE"
# Parameter sets that go through at once; they come to the driver and are sent to every task.
SETS_AT_ONCE = 1_000


def input_tiles(points: DataFrame, outline: DataFrame, raster: DataFrame, georef: DataFrame) -> DataFrame:
    """Grid and image sizes of the tiles that all inputs have."""
    def sized(pixels: DataFrame, image: str) -> DataFrame:
        return image_size(pixels).withColumnsRenamed({"src_w": f"{image}_w", "src_h": f"{image}_h"})

    return (grid_size(extents(points)).join(sized(outline, "outline"), "tile_id")
            .join(sized(raster, "raster"), "tile_id").join(georef.select("tile_id"), "tile_id", "left_semi"))


def masked_cells(points: DataFrame, outline: DataFrame, raster: DataFrame, tiles: DataFrame,
                 knn: list[int], roof_color: int = ROOF_COLOR) -> DataFrame:
    """Masked cells with height, intensity, normal and normalised curvature, for every k."""
    cells = cut(segment_cells(points, outline, raster, tiles, roof_color), "cells")
    return normalize(cut(fit_planes(cells, tiles, knn), "fits"), tiles)


def segment(points: DataFrame, outline: DataFrame, raster: DataFrame, georef: DataFrame, params: DataFrame,
            roof_color: int = ROOF_COLOR, slope_cmp: str = "gt", compass: bool = False) -> DataFrame:
    """Faces of every tile for every parameter set, as ``(param_id, apn, feature_id, srid,
    rings, slope, azimuth)``.

    Cells are gridded once and planes fitted once per number of neighbours; only growth and what follows is done per set, for
    all sets in one job, or ``SETS_AT_ONCE`` of them in each.
    """
    spark = points.sparkSession
    usable = cut(clean_params(valid_params(params)), "params")
    if usable.isEmpty():
        return spark.createDataFrame([], FACES)
    tiles = cut(input_tiles(points, outline, raster, georef), "tiles")
    cells = masked_cells(points, outline, raster, tiles, [r["knn"] for r in usable.select("knn").distinct().collect()], roof_color)
    rows, found = usable.toLocalIterator(), None
    while some := list(islice(rows, SETS_AT_ONCE)):
        sets = spark.createDataFrame(some, usable.schema)
        faces = _segment_sets(cells, tiles, georef, sets, some, slope_cmp, compass)
        found = faces if found is None else found.unionByName(faces)
    return found


def _segment_sets(cells: DataFrame, tiles: DataFrame, georef: DataFrame, usable: DataFrame, rows: list, slope_cmp: str, compass: bool) -> DataFrame:
    """Faces for some parameter sets, given as a table and as rows."""
    grown = cut(grow_regions(cells, tiles, rows), "region_cells")
    regions = (region_stats(grown).join(F.broadcast(usable.select("param_id", "region_limit")), "param_id")
               .filter("size > region_limit").drop("region_limit"))
    merged, names = merge_regions(regions, tiles, usable, slope_cmp=slope_cmp, compass=compass)

    faces = merged.select(*REGION, F.col("region_id").alias("face_id"))
    if names is not None:
        faces = faces.unionByName(names)
    named = cut(attach(grown.select(*REGION, "cell_id"), cut(faces, "faces"), REGION, "left")
                .select(*SCOPE, "cell_id", "face_id"), "named")
    large = named.filter("face_id IS NOT NULL")
    covered = large.unionByName(absorb_small(named.filter("face_id IS NULL"), large))

    sizes = tiles.select("tile_id", F.col("w").alias("src_w"), F.col("h").alias("src_h"),
                         F.col("raster_w").alias("w"), F.col("raster_h").alias("h"))
    pixels = resample(covered.select("param_id", "tile_id", cell_px(F.col("cell_id")).alias("px"),
                                     cell_py(F.col("cell_id")).alias("py"), "face_id"), sizes)
    polygons = vectorize(pixels, usable)
    attrs = merged.select(*SCOPE, F.col("region_id").alias("face_id"), "slope", "azimuth",
                          "size", "seed_ncurv", "seed_id")
    features = to_crs(polygons.join(attrs, [*SCOPE, "face_id"]), georef)
    order = [F.col("size").desc(), F.col("seed_ncurv"), F.col("seed_id"), F.col("part_id")]
    return (with_position(features, SCOPE, order, "feature_id")
            .select("param_id", F.col("tile_id").alias("apn"), F.col("feature_id").cast("bigint").alias("feature_id"),
                    "srid", "rings", "slope", "azimuth"))
