"""The registered queries and the SQL that checks them, by inventory item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixtures as fx, sql
from slopeweave.functions import cells as fc, planes, rings
from slopeweave.operators import (absorb, components, faces, fit, grid, growth, merging, ranking, regions, scoring)
from slopeweave.plans.dem import dem
from slopeweave.plans.segment import input_tiles, masked_cells, segment
from slopeweave.plans.sweep import pool_by_param, sweep
from slopeweave.session import cut, scratch_path
from slopeweave.sources import geojson, points as pts, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(select: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""
    def register(run):
        QUERIES[run.__name__] = run
        if select is not None:
            ORACLES[run.__name__] = sql.text(select)
        return run
    return register


def r6(column, name: str, places: int = 6):
    """Rounded, without negative zero. Values with few decimals take more places than they
    have, so that no engine has to break a tie."""
    return (F.round(F.col(column) if isinstance(column, str) else column, places) + 0.0).alias(name)


def r9(column, name: str):
    return r6(column, name, 9)


_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


# --- shared steps -----------------------------------------------------------------------

def _tiles(spark, d, which="points"):
    return cut(grid.grid_size(grid.extents(getattr(fx, which)(spark, d))), "tiles")


def _roof_tiles(spark, d):
    return cut(input_tiles(fx.roof_points(spark, d), fx.outline(spark, d), fx.raster(spark, d), fx.georef(spark, d)), "tiles")


def _roof_cells(spark, d, tiles):
    return cut(grid.segment_cells(fx.roof_points(spark, d), fx.outline(spark, d), fx.raster(spark, d), tiles), "cells")


def _masked(spark, d, k):
    tiles = _roof_tiles(spark, d)
    cells = masked_cells(fx.roof_points(spark, d), fx.outline(spark, d), fx.raster(spark, d), tiles, [k])
    return tiles, cut(cells, "masked")


def _grown(spark, d):
    p = fx.roof_params()[3]
    tiles, cells = _masked(spark, d, p["knn"])
    return tiles, cut(growth.grow_regions(cells, tiles, [p]), "grown")


def _large(spark, d):
    p = fx.roof_params()[3]
    tiles, grown = _grown(spark, d)
    stats = regions.region_stats(grown)
    attrs = cut(regions.region_attrs(regions.region_means(stats)), "attrs")
    return tiles, grown, attrs, attrs.filter(F.col("size") > p["region_limit"]), p


def _pixel_faces(spark, d, which):
    """Pixels of the fixture's boxes, face by face."""
    span = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) - 1))
    return (fx.boxes(spark, d, which).select("*", span("x0", "x1").alias("px"))
            .select(F.lit(0).alias("param_id"), "tile_id", "px", span("y0", "y1").alias("py"),
                    F.col("face_id").cast("bigint").alias("face_id")))


def _scored(spark, d):
    """Gold and result faces with ids that are unique over all tiles."""
    gold = fx.faces(spark, d, "gold").select(F.struct("apn", "feature_id").alias("gold_id"), "rings")
    result = fx.faces(spark, d, "result").select(F.struct("apn", "feature_id").alias("result_id"), "rings")
    return gold, result


def _pairs(spark, d):
    gold, result = _scored(spark, d)
    area = scoring.overlap_pairs(gold, result, ["gold_id"], ["result_id"], fx.CELL)
    return area.withColumn("overlap", F.round(F.col("overlap") / fx.CELL ** 2).cast("bigint"))


# --- sources ----------------------------------------------------------------------------

@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS tile_id FROM lineitem")
def s1_manifest(spark, d):
    return pts.manifest(spark, fx.write_point_files(spark, d)).filter("length > 0").select("tile_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS tile_id, '.geojson' AS suffix FROM supplier UNION ALL "
       "SELECT DISTINCT CAST(l_suppkey AS VARCHAR), '.txt' FROM lineitem")
def s2_suffix_filter(spark, d):
    root = scratch_path(spark, "mixed")
    fx.write_point_files(spark, d, f"{root}/a/deep")
    fx.write_face_files(spark, d, f"{root}/b")
    return (pts.manifest(spark, root, ".txt").select("tile_id", F.lit(".txt").alias("suffix"))
            .unionByName(pts.manifest(spark, root, ".geojson").select("tile_id", F.lit(".geojson").alias("suffix"))))


@query("SELECT tile_id, seq - 1 AS position, x, y, round(z, 9) AS z FROM points")
def s3_read_points(spark, d):
    read = pts.read_points(spark, fx.write_point_files(spark, d))
    return ranking.with_position(read, ["tile_id"], [F.col("seq")]).select(
        "tile_id", "position", "x", "y", F.round("z", 9).alias("z"))


@query("SELECT tile_id AS apn, CAST(face_id AS BIGINT) AS feature_id, 3857 AS srid, "
       "CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / 4 AS area FROM gold")
def s4_read_features(spark, d):
    read = geojson.read_features(spark, fx.write_face_files(spark, d))
    return read.select("apn", "feature_id", "srid", r6(rings.polygon_area(F.col("rings")), "area"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS apn, CAST(f AS BIGINT) AS feature_id, part, n_rings, CAST(CASE f WHEN 0 THEN area ELSE 2 * (s_suppkey % 5 + 1) END AS DOUBLE) AS area "
       "FROM supplier, (VALUES (0, 0, 2, 280), (0, 1, 1, 288), (2, 0, 1, 0)) v(f, part, n_rings, area)")
def s4_multipolygon(spark, d):
    read = geojson.read_features(spark, fx.write_mixed_files(spark, d))
    return read.select("apn", "feature_id", "part", F.size("rings").alias("n_rings"), r6(rings.polygon_area(F.col("rings")), "area"))


@query("SELECT tile_id, count(*) AS n, CAST(sum(argb) AS BIGINT) AS total FROM raster GROUP BY ALL")
def s5_read_pixels(spark, d):
    path = scratch_path(spark, "pixels")
    fx.raster(spark, d).write.parquet(path)
    return tables.read_pixels(spark, path).groupBy("tile_id").agg(
        F.count("*").alias("n"), F.sum(F.col("argb").cast("bigint")).alias("total"))


@query("SELECT tile_id, m00, m01, m02, m10, m11, m12, srid FROM georef")
def s6_read_georef(spark, d):
    path = scratch_path(spark, "georef")
    fx.georef(spark, d).write.parquet(path)
    return tables.read_georef(spark, path)


@query("SELECT count(*) AS faces, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) / 4 AS area FROM gold")
def s8_read_gold(spark, d):
    gold = geojson.read_gold(spark, fx.write_face_files(spark, d))
    return gold.agg(F.count("*").alias("faces"), r6(F.sum(rings.polygon_area(F.col("rings"))), "area"))


# --- sinks ------------------------------------------------------------------------------

@query("SELECT tile_id AS apn, CAST(face_id AS BIGINT) AS feature_id, 3857 AS srid, "
       "CAST(x1 - x0 AS DOUBLE) AS slope, CAST(5 AS BIGINT) AS corners FROM result")
def k1_write_geojson(spark, d):
    path = scratch_path(spark, "geojson")
    width = fx.boxes(spark, d, "result").select(
        F.col("tile_id").alias("apn"), F.col("face_id").cast("bigint").alias("feature_id"),
        (F.col("x1") - F.col("x0")).cast("double").alias("slope"))
    geojson.write_geojson(fx.faces(spark, d, "result").drop("slope").join(width, ["apn", "feature_id"]), path)
    return geojson.read_features(spark, path, by_folder=True, attributes=True).select(
        "apn", "feature_id", "srid", "slope", F.size(F.get("rings", F.lit(0))).cast("bigint").alias("corners"))


@query("SELECT p AS param_id, tile_id AS apn, CAST(face_id AS BIGINT) AS feature_id, 3857 AS srid, CAST(x1 - x0 + p AS DOUBLE) AS slope "
       "FROM result, (VALUES (0), (1)) v(p) WHERE face_id <> p * 2")
def k1_two_sets(spark, d):
    path = scratch_path(spark, "geojson")
    width = fx.boxes(spark, d, "result").select(F.col("tile_id").alias("apn"), F.col("face_id").cast("bigint").alias("feature_id"), (F.col("x1") - F.col("x0")).alias("width"))
    sets = fx.faces(spark, d, "result").join(width, ["apn", "feature_id"]).withColumn("param_id", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = sets.filter("feature_id <> param_id * 2").withColumns({"slope": (F.col("width") + F.col("param_id")).cast("double"), "azimuth": F.lit(float("nan"))})
    geojson.write_geojson(kept.drop("width"), path)
    back = geojson.read_features(spark, path, by_folder=True, attributes=True)
    return back.filter("azimuth IS NULL").select("param_id", "apn", "feature_id", "srid", "slope")


@query("SELECT l_returnflag AS apn, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS feature_id, "
       "l_quantity AS slope, l_quantity * 2 AS area FROM lineitem")
def k1_many_faces(spark, d):
    """A parcel for each return flag, with a face for each of its order lines."""
    path = scratch_path(spark, "geojson")
    items = ranking.with_position(fx.table(spark, d, "lineitem").select(*_ITEM, "l_returnflag", "l_quantity"), ["l_returnflag"], [F.col(c) for c in _ITEM], "feature_id")
    side = F.col("l_quantity")
    corner = lambda x, y: F.array(x, F.lit(y).cast("double"))
    ring = F.array(corner(F.lit(0.0), 0), corner(side, 0), corner(side, 2), corner(F.lit(0.0), 2), corner(F.lit(0.0), 0))
    geojson.write_geojson(items.select(F.col("l_returnflag").alias("apn"), "feature_id", F.lit(0).alias("srid"), F.array(ring).alias("rings"),
                                       side.alias("slope"), F.lit(1.0).alias("azimuth")), path)
    return geojson.read_features(spark, path, by_folder=True, attributes=True).select(
        "apn", "feature_id", "slope", r6(rings.polygon_area(F.col("rings")), "area"))


_DEM = """
    SELECT g.tile_id, g.px, g.py, coalesce(p.argb, -16777216) AS argb
    FROM cells g LEFT JOIN (
      SELECT tile_id, px, py, max_by(CAST(((CAST(trunc(greatest(least(scaled, 2147483647.0), -2147483648.0)) AS BIGINT)
             - 16777216 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INT), seq) AS argb
      FROM placed GROUP BY ALL) p ON p.tile_id = g.tile_id AND p.px = g.px AND p.py = g.py"""


@query(_DEM)
def k2_write_dem(spark, d):
    path = scratch_path(spark, "dem")
    tables.write_dem(dem(fx.points(spark, d)), path)
    return tables.read_dem(spark, path)


@query("SELECT tile_id, px, py, CASE WHEN tile_id > 9 THEN argb + 1 ELSE argb END AS argb FROM raster")
def k3_overwrite(spark, d):
    path = scratch_path(spark, "dem")
    raster = fx.raster(spark, d)
    tables.write_dem(raster, path)
    tables.write_dem(raster.filter(F.length("tile_id") > 1).withColumn("argb", F.col("argb") + 1), path)
    return tables.read_dem(spark, path)


@query("SELECT count(DISTINCT l_suppkey) AS tiles FROM lineitem")
def k4_processed_count(spark, d):
    return spark.createDataFrame([(tables.processed_count(fx.points(spark, d)),)], "tiles long")


@query("SELECT CAST(c_nationkey AS BIGINT) AS param_id, round(avg(c_acctbal), 4) AS score FROM customer GROUP BY c_nationkey")
def k5_collect_scores(spark, d):
    """A score for each nation, through the driver."""
    scores = fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("param_id")).agg(F.avg("c_acctbal").alias("score"))
    return spark.createDataFrame(scoring.collect_scores(scores), "param_id long, score double").withColumn("score", F.round("score", 4))


# --- projections ------------------------------------------------------------------------

@query(r"SELECT page_id, regexp_extract(list_extract(string_split(url, '/'), -1), '^(.*?)(\.[^.]*)?$', 1) AS base FROM pages")
def p1_base_name(spark, d):
    return fx.table(spark, d, "pages").select("page_id", fc.base_name(F.col("url")).alias("base"))


@query("SELECT tile_id, n, w, h FROM tiles")
def p3_grid_size(spark, d):
    return grid.grid_size(grid.extents(fx.points(spark, d))).select("tile_id", "n", "w", "h")


@query("SELECT tile_id, seq, px, py, round(height, 9) AS height FROM placed")
def p4_to_cell(spark, d):
    points = fx.points(spark, d)
    return grid.to_cell(points, _tiles(spark, d)).select("tile_id", "seq", "px", "py", r9("height", "height"))


@query("SELECT tile_id, seq, round(height, 9) AS height FROM roof_placed")
def p5_cell_height(spark, d):
    tiles = _tiles(spark, d, "roof_points")
    return grid.to_cell(fx.roof_points(spark, d), tiles).select("tile_id", "seq", r9("height", "height"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(((CAST(trunc(greatest(least("
       "9 / CAST(49 AS DOUBLE) * 1000 * (l_extendedprice * 1000 - 2e7), 2147483647.0), -2147483648.0)) AS BIGINT) - 16777216 "
       "+ 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INT) AS argb FROM lineitem")
def p6_dem_color(spark, d):
    items = fx.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "10 AS w", "1.0D AS min_x", "50.0D AS max_x",
        "l_extendedprice * 1000 - 2e7D AS z")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", fc.dem_color().alias("argb"))


@query("SELECT tile_id, px, py, (argb & 16777215) = 16716049 AS in_mask FROM outline")
def p7_in_mask(spark, d):
    return fx.outline(spark, d).select("tile_id", "px", "py", fc.in_mask(F.col("argb")).alias("in_mask"))


@query("SELECT tile_id, px, py, CASE WHEN (argb & 16777215) = 11822170 THEN -1 ELSE 0 END AS argb FROM raster")
def p8_extract_band(spark, d):
    return grid.extract_band(fx.raster(spark, d), 180 * 65536 + 100 * 256 + 90)


@query("SELECT tile_id, px, py, round((((argb >> 16) & 255) + ((argb >> 8) & 255) + (argb & 255)) / CAST(3 AS DOUBLE), 6) "
       "AS intensity FROM raster")
def p9_intensity(spark, d):
    return fx.raster(spark, d).select("tile_id", "px", "py", r6(fc.intensity(F.col("argb")), "intensity"))


@query("SELECT tile_id, px, py, ncurv FROM grown8")
def p10_normalize(spark, d):
    return _masked(spark, d, 8)[1].select("tile_id", "px", "py", "ncurv")


@query("""SELECT v.vec_id, v.label, round(list_sum(list_transform(list_zip(v.embedding, f.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2]))
       / (sqrt(list_sum(list_transform(v.embedding, lambda e: CAST(e AS DOUBLE) * e)))
          * sqrt(list_sum(list_transform(f.embedding, lambda e: CAST(e AS DOUBLE) * e)))), 6) AS cosine
       FROM embeddings v JOIN (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) f
         ON f.label = v.label""")
def p11_cosine(spark, d):
    vectors = fx.table(spark, d, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return vectors.join(first, "label").select(
        "vec_id", "label", r6(planes.cosine_arrays(F.col("embedding"), F.col("first")), "cosine"))


@query("SELECT tile_id, px, py, round(curv, 6) AS curv, nx, ny, nz FROM fits54")
def p12_p13_plane(spark, d):
    tiles = _roof_tiles(spark, d)
    fits = fit.fit_planes(_roof_cells(spark, d, tiles), tiles, [54])
    return fits.select("tile_id", "px", "py", r6("curv", "curv"), "nx", "ny", "nz")


_VECTORS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, a / size AS nx, b / size AS ny, c / size AS nz
    FROM (SELECT *, sqrt(a * a + b * b + c * c) AS size FROM (
      SELECT *, l_discount - 0.047 AS a, l_tax - 0.037 AS b, l_quantity / 500 AS c FROM lineitem)))"""


def _vectors(spark, d):
    raw = fx.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        "l_discount - 0.047D AS a", "l_tax - 0.037D AS b", "l_quantity / 500 AS c").selectExpr(
        "*", "sqrt(a * a + b * b + c * c) AS size")
    return raw.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                          "a / size AS nx", "b / size AS ny", "c / size AS nz")


@query(f"SELECT {', '.join(_ITEM)}, round(degrees(acos(least(abs(nz), 1.0))), 6) AS slope FROM {_VECTORS}")
def p14_slope(spark, d):
    return _vectors(spark, d).select(*_ITEM, r6(planes.slope(F.col("nz")), "slope"))


_TURN = "degrees(atan2(abs(nx), abs(ny)))"
_BEARING = ("CASE WHEN nx < 0 AND ny < 0 THEN 360 - {t} WHEN nx < 0 THEN {sw} WHEN ny >= 0 THEN 180 - {t} ELSE {t} END")


@query(f"SELECT {', '.join(_ITEM)}, round({_BEARING.format(t=_TURN, sw='270 - ' + _TURN)}, 6) AS azimuth, "
       f"round({_BEARING.format(t=_TURN, sw='180 + ' + _TURN)}, 6) AS compass FROM {_VECTORS}")
def p15_azimuth(spark, d):
    nx, ny = F.col("nx"), F.col("ny")
    return _vectors(spark, d).select(*_ITEM, r6(planes.azimuth(nx, ny), "azimuth"),
                                     r6(planes.azimuth(nx, ny, compass=True), "compass"))


@query("SELECT tile_id, region_id, CAST(floor((row_number() OVER (PARTITION BY tile_id ORDER BY size DESC, seed)) "
       "* (16777215.0 / count(*) OVER (PARTITION BY tile_id) + 1)) AS INT) AS color FROM large8")
def p17_face_color(spark, d):
    _, _, _, large, _ = _large(spark, d)
    before = large.groupBy("param_id", "tile_id").agg(F.count("*").alias("n"))
    return faces.label_colors(large, before).select("tile_id", "region_id", "color")


@query("SELECT p.tile_id, p.cell_id, coalesce(max(r.face_id) + 1, 0) AS color FROM face_pixels p LEFT JOIN result r "
       "ON r.tile_id = p.tile_id AND p.px >= r.x0 AND p.px < r.x1 AND p.py >= r.y0 AND p.py < r.y1 GROUP BY ALL")
def p18_paint(spark, d):
    tiles = _tiles(spark, d)
    every = grid.grid_cells(tiles).select(F.lit(0).alias("param_id"), "tile_id", fc.cell_id(F.col("px"), F.col("py")).alias("cell_id"))
    colored = _pixel_faces(spark, d, "result").select(
        "param_id", "tile_id", fc.cell_id(F.col("px"), F.col("py")).alias("cell_id"),
        (F.col("face_id") + 1).cast("int").alias("color"))
    return absorb.paint(every, colored).select("tile_id", "cell_id", "color")


@query("SELECT c.tile_id, c.px, c.py, r.argb FROM cells c JOIN tiles t ON t.tile_id = c.tile_id JOIN raster r "
       "ON r.tile_id = c.tile_id AND r.px = ((2 * c.px + 1) * 30) // (2 * w) AND r.py = ((2 * c.py + 1) * 30) // (2 * h)")
def p19_resample(spark, d):
    raster = fx.raster(spark, d)
    sizes = cut(_tiles(spark, d).join(grid.image_size(raster), "tile_id"), "sizes")
    return grid.resample(raster, sizes)


@query("SELECT tile_id AS apn, CAST(face_id AS BIGINT) AS feature_id, xa AS min_x, xb AS max_x, ya AS min_y, yb AS max_y, "
       "3857 AS srid FROM result_crs")
def p20_to_crs(spark, d):
    ring = F.get("rings", F.lit(0))
    axis = lambda i: F.transform(ring, lambda p: p[i])
    return fx.faces(spark, d, "result").select(
        "apn", "feature_id", r6(F.array_min(axis(0)), "min_x"), r6(F.array_max(axis(0)), "max_x"),
        r6(F.array_min(axis(1)), "min_y"), r6(F.array_max(axis(1)), "max_y"), "srid")


@query("SELECT tile_id AS apn, CAST(face_id AS BIGINT) AS feature_id, CASE WHEN s_nationkey = 0 THEN 0 ELSE s_nationkey END AS srid "
       "FROM result JOIN supplier ON s_suppkey = tile_id")
def p22_srid(spark, d):
    known = fx.georef(spark, d).drop("srid").join(fx.table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS tile_id", "nullif(s_nationkey, 0) AS srid"), "tile_id")
    pixel = fx.faces(spark, d, "result").withColumn("tile_id", F.col("apn")).drop("srid")
    return faces.to_crs(pixel, known).select("apn", "feature_id", "srid")




def _raw_params(spark, d):
    """One parameter set per order line, some of them incomplete."""
    return fx.table(spark, d, "lineitem").selectExpr(
        "CAST(l_orderkey * 8 + l_linenumber AS INT) AS param_id", "l_discount - 0.05D AS smoothness",
        "CASE WHEN l_tax < 0.01 THEN NULL ELSE -l_tax END AS curvature", "l_quantity - 25 AS color",
        "l_extendedprice / 1000 - 40 AS knn", "25.5D - l_quantity AS region_limit", "l_tax AS slope", "-l_quantity AS azimuth")


_CLEAN = """SELECT CAST(l_orderkey * 8 + l_linenumber AS INT) AS param_id, round(abs(l_discount - 0.05), 6) AS smoothness, {curvature} AS curvature,
    abs(l_quantity - 25) AS color, CAST(trunc(abs(l_extendedprice / 1000 - 40)) AS INT) AS knn,
    CAST(trunc(abs(25.5 - l_quantity)) AS INT) AS region_limit, l_tax AS slope, l_quantity AS azimuth FROM lineitem"""


@query(_CLEAN.format(curvature="CASE WHEN l_tax < 0.01 THEN NULL ELSE l_tax END"))
def p23_clean_params(spark, d):
    return tables.clean_params(_raw_params(spark, d)).withColumn("smoothness", r6("smoothness", "s"))


@query("SELECT tile_id, face_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM result")
def p24_ring_area(spark, d):
    box = fx.boxes(spark, d, "result")
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return box.select("tile_id", "face_id", rings.ring_area(ring).alias("area"))


# --- filters ----------------------------------------------------------------------------

@query("SELECT tile_id, px, py FROM roof_cells WHERE in_mask")
def f1_masked(spark, d):
    return grid.masked(_roof_cells(spark, d, _roof_tiles(spark, d))).select("tile_id", "px", "py")


def _edges(spark, d):
    tiles, cells = _masked(spark, d, 8)
    nbr = growth.knn_cells(cells.withColumn("in_mask", F.lit(True)), tiles, 8, growth.EDGE_VALUES)
    return growth.edge_attrs(nbr, cells)


_ENDS = "tile_id, u, v"


def _ends(edges):
    return edges.select("tile_id", fc.cell_id(F.col("px"), F.col("py")).alias("u"), fc.cell_id(F.col("qx"), F.col("qy")).alias("v"))


@query(f"SELECT {_ENDS} FROM smooth8")
def f2_smooth_edges(spark, d):
    return _ends(growth.smooth_edges(_edges(spark, d), sql.GROW["smoothness"]))


@query(f"SELECT {_ENDS} FROM edges8 WHERE dcurv < {sql.GROW['curvature']}")
def f3_flat_edges(spark, d):
    return _ends(growth.flat_edges(_edges(spark, d), sql.GROW["curvature"]))


@query(f"SELECT {_ENDS} FROM edges8 WHERE dcolor < {sql.GROW['color']}")
def f4_like_color_edges(spark, d):
    return _ends(growth.like_color_edges(_edges(spark, d), sql.GROW["color"]))


@query(f"SELECT tile_id, region_id, n AS size, n > {sql.GROW['limit']} AS large FROM regions8")
def f5_split_by_size(spark, d):
    _, _, attrs, _, p = _large(spark, d)
    large, small = regions.split_by_size(attrs, p["region_limit"])
    return (large.select("tile_id", "region_id", "size", F.lit(True).alias("large"))
            .unionByName(small.select("tile_id", "region_id", "size", F.lit(False).alias("large"))))


_ELIGIBLE = ("SELECT tile_id, region_id AS a, other_id AS b FROM near8 WHERE px <> qx AND py <> qy "
             "AND (p_size > q_size OR (p_size = q_size AND p_seed < q_seed)) "
             "AND abs(q_slope - p_slope) {cmp} 1.0 AND abs(q_azimuth - p_azimuth) < 40.0 "
             "AND NOT isnan(p_azimuth) AND NOT isnan(q_azimuth)")


def _eligible(spark, d, cmp="gt"):
    tiles, _, _, large, _ = _large(spark, d)
    return merging.eligible_pairs(cut(large, "large"), tiles, tables.clean_params(fx.roof_params_df(spark)), slope_cmp=cmp).select("tile_id", "a", "b")


@query(_ELIGIBLE.format(cmp=">"))
def f6_merge_eligible(spark, d):
    return _eligible(spark, d)


@query(_ELIGIBLE.format(cmp="<"))
def f6_merge_eligible_lt(spark, d):
    return _eligible(spark, d, "lt")


@query("SELECT 'grow' AS mode, tile_id, count(*) AS pairs FROM nbr8 WHERE px <> qx OR py <> qy GROUP BY ALL UNION ALL "
       "SELECT 'merge', tile_id, count(*) FROM nbr8 WHERE px <> qx AND py <> qy GROUP BY ALL")
def f7_exclude_self(spark, d):
    tiles = _roof_tiles(spark, d)
    nbr = cut(growth.knn_cells(_roof_cells(spark, d, tiles), tiles, 8), "nbr")
    count = lambda mode: growth.exclude_self(nbr, mode).groupBy("tile_id").agg(F.count("*").alias("pairs")).withColumn("mode", F.lit(mode))
    return count("grow").unionByName(count("merge"))


_PARTS = ("SELECT p.tile_id, p.face_id, l.root AS part_id, count(*) AS cells FROM part_labels l JOIN face_pixels p "
          "ON p.tile_id = l.tile_id AND p.cell_id = l.cell_id GROUP BY ALL")


def _height_faces(spark, d):
    tiles = _tiles(spark, d)
    heights = grid.height_grid(fx.points(spark, d), tiles)
    return heights.select(F.lit(0).alias("param_id"), "tile_id", "px", "py", F.floor(F.col("height") / 3).alias("face_id"))


@query(f"{_PARTS} HAVING count(*) > 5")
def f8_drop_small_parts(spark, d):
    return faces.vectorize(_height_faces(spark, d), 5).select("tile_id", "face_id", "part_id", "cells")


@query(_CLEAN.format(curvature="l_tax") + " WHERE l_tax >= 0.01")
def f9_valid_params(spark, d):
    return tables.clean_params(tables.valid_params(_raw_params(spark, d))).withColumn("smoothness", r6("smoothness", "s"))


# --- joins ------------------------------------------------------------------------------

@query("SELECT CAST(s_suppkey AS VARCHAR) AS tile_id, '/hm/' || s_suppkey || '.txt' AS height_map, outline, raster FROM supplier "
       "JOIN (SELECT l_suppkey, min('/ro/' || l_linenumber || '/' || l_suppkey || '.tif') AS outline FROM lineitem GROUP BY ALL) "
       "ON l_suppkey = s_suppkey "
       "JOIN (SELECT o_custkey, min('/ra/' || o_orderkey || '/' || o_custkey || '.tif') AS raster FROM orders GROUP BY ALL) ON o_custkey = s_suppkey")
def j1_match_inputs(spark, d):
    def files(table, path):
        listed = fx.table(spark, d, table).selectExpr(f"{path} AS path")
        return listed.select("path", fc.base_name(F.col("path")).alias("tile_id"))
    return grid.match_inputs(
        files("supplier", "concat('/hm/', s_suppkey, '.txt')"),
        files("lineitem", "concat('/ro/', l_linenumber, '/', l_suppkey, '.tif')"),
        files("orders", "concat('/ra/', o_orderkey, '/', o_custkey, '.tif')"))


@query("SELECT tile_id, px, py, qx, qy, d2, rnk FROM nbr8")
def j3_knn_cells(spark, d):
    tiles = _roof_tiles(spark, d)
    return growth.knn_cells(_roof_cells(spark, d, tiles), tiles, 8)


@query("SELECT tile_id, u, v, round(cosine, 6) AS cosine, round(dcurv, 9) AS dcurv, round(dcolor, 6) AS dcolor FROM edges8")
def j4_edge_attrs(spark, d):
    e = _edges(spark, d)
    return e.select("tile_id", fc.cell_id(F.col("px"), F.col("py")).alias("u"), fc.cell_id(F.col("qx"), F.col("qy")).alias("v"),
                    r6(growth.edge_cosine(), "cosine"), r9(F.abs(F.col("q_ncurv") - F.col("p_ncurv")), "dcurv"),
                    r6(F.abs(F.col("q_intensity") - F.col("p_intensity")), "dcolor"))


@query("SELECT tile_id, region_id, other_id, d2 FROM near8")
def j5_knn_regions(spark, d):
    tiles, _, _, large, _ = _large(spark, d)
    return merging.knn_regions(cut(large, "large"), tiles).select("tile_id", "region_id", "other_id", "d2")


@query(f"""SELECT s.tile_id, s.cell_id, g.region_id AS face_id
    FROM (SELECT c.* FROM region_cells8 c JOIN regions8 r ON r.tile_id = c.tile_id AND r.region_id = c.region_id WHERE n <= {sql.GROW['limit']}) s
    JOIN (SELECT c.* FROM region_cells8 c JOIN regions8 r ON r.tile_id = c.tile_id AND r.region_id = c.region_id WHERE n > {sql.GROW['limit']}) g
      ON g.tile_id = s.tile_id
    QUALIFY row_number() OVER (PARTITION BY s.tile_id, s.cell_id ORDER BY (s.px - g.px) * (s.px - g.px) + (s.py - g.py) * (s.py - g.py), g.px, g.py) = 1""")
def j7_absorb_small(spark, d):
    _, grown, attrs, _, p = _large(spark, d)
    sized = grown.join(attrs.select(*regions.REGION, "size"), regions.REGION)
    named = cut(sized.select("param_id", "tile_id", "cell_id", F.when(F.col("size") > p["region_limit"], F.col("region_id")).alias("face_id")), "named")
    return absorb.absorb_small(named.filter("face_id IS NULL"), named.filter("face_id IS NOT NULL")).select("tile_id", "cell_id", "face_id")


_PAIR = ["gold_id.apn AS tile_id", "CAST(gold_id.feature_id AS INT) AS gold_face", "CAST(result_id.feature_id AS INT) AS result_face"]


@query("SELECT tile_id, gold_face, result_face, CAST(overlap AS BIGINT) AS overlap FROM pairs")
def j8_overlap_pairs(spark, d):
    return _pairs(spark, d).selectExpr(*_PAIR, "overlap")


@query("SELECT g.tile_id, g.face_id FROM gold g ANTI JOIN best b ON b.tile_id = g.tile_id AND b.gold_face = g.face_id")
def j9_unmatched_gold(spark, d):
    gold, _ = _scored(spark, d)
    best = scoring.best_match(_pairs(spark, d), ["gold_id"])
    return scoring.unmatched_gold(gold, best, ["gold_id"]).selectExpr("gold_id.apn AS tile_id", "CAST(gold_id.feature_id AS INT) AS face_id")


@query("SELECT r.tile_id, r.face_id FROM result r ANTI JOIN best b ON b.tile_id = r.tile_id AND b.result_face = r.face_id")
def j10_unmatched_result(spark, d):
    _, result = _scored(spark, d)
    best = scoring.best_match(_pairs(spark, d), ["gold_id"])
    return scoring.unmatched_result(result, best, ["result_id"]).selectExpr("result_id.apn AS tile_id", "CAST(result_id.feature_id AS INT) AS face_id")


# --- aggregations -----------------------------------------------------------------------

@query("SELECT tile_id, n, min_x, max_x, min_y, max_y, round(min_z, 9) AS min_z, round(max_z, 9) AS max_z FROM tiles")
def a1_extents(spark, d):
    return grid.extents(fx.points(spark, d)).select("tile_id", "n", "min_x", "max_x", "min_y", "max_y", F.round("min_z", 9).alias("min_z"), F.round("max_z", 9).alias("max_z"))


@query("SELECT tile_id, px, py, round(height, 9) AS height FROM cells")
def a2_height_grid(spark, d):
    points = fx.points(spark, d)
    return grid.height_grid(points, _tiles(spark, d)).select("tile_id", "px", "py", r9("height", "height"))


@query("SELECT tile_id, px, py, CAST(n AS INT) AS n, round(cxx, 8) AS cxx, round(cxy, 8) + 0.0 AS cxy, round(cyy, 8) AS cyy, "
       "round(cxh, 8) + 0.0 AS cxh, round(cyh, 8) + 0.0 AS cyh, round(chh, 8) AS chh FROM moments54")
def a3_local_moments(spark, d):
    tiles = _roof_tiles(spark, d)
    moments = fit.local_moments(_roof_cells(spark, d, tiles), tiles, [54])
    names = ["cxx", "cxy", "cyy", "cxh", "cyh", "chh"]
    return planes.with_covariance(moments).select("tile_id", "px", "py", "n", *[r6(c, c, 8) for c in names])


@query("SELECT tile_id, region_id, n AS size, round(sum_curv, 9) AS sum_curv, CAST(sum_x AS BIGINT) AS sum_x, CAST(sum_y AS BIGINT) AS sum_y, "
       "round(sum_color, 6) AS sum_color FROM regions8")
def a4_region_stats(spark, d):
    return regions.region_stats(_grown(spark, d)[1]).select(
        "tile_id", "region_id", "size", r9("sum_curv", "sum_curv"), "sum_x", "sum_y", r6("sum_color", "sum_color"))


@query("SELECT tile_id, region_id, round(sum_curv / n * n, 9) AS curvature_sum, round(sum_color / n * n, 6) AS color_sum, "
       "CAST(sum_x // n AS INT) AS cx, CAST(sum_y // n AS INT) AS cy FROM regions8")
def a5_region_means(spark, d):
    return regions.region_means(regions.region_stats(_grown(spark, d)[1])).select(
        "tile_id", "region_id", r9(F.col("curvature") * F.col("size"), "curvature_sum"),
        r6(F.col("color") * F.col("size"), "color_sum"), "cx", "cy")


@query("SELECT tile_id, region_id, round(slope, 4) AS slope, round(azimuth, 4) AS azimuth, round(curv, 6) AS curv FROM large8")
def a6_region_attrs(spark, d):
    large = _large(spark, d)[3]
    return large.select("tile_id", "region_id", F.round("slope", 4).alias("slope"), F.round("azimuth", 4).alias("azimuth"), r6("curv", "curv"))


@query("SELECT tile_id, 1.0::DOUBLE AS max_ncurv, 0.0::DOUBLE AS min_ncurv, round((mean - low) / (high - low), 6) AS mean_ncurv FROM ranges8")
def a7_curvature_stats(spark, d):
    tiles = _roof_tiles(spark, d)
    stats = fit.curvature_stats(cut(fit.fit_planes(_roof_cells(spark, d, tiles), tiles, [8]), "fits"), tiles)
    return stats.select("tile_id", "max_ncurv", "min_ncurv", r6("mean_ncurv", "mean_ncurv"))


@query("""SELECT tile_id, target AS region_id, CAST(sum(n) AS BIGINT) AS size, round(sum(sum_curv), 9) AS sum_curv, CAST(sum(sum_x) AS BIGINT) AS sum_x
    FROM (SELECT r.*, CASE WHEN n > 10 THEN region_id ELSE coalesce(
            (SELECT min(q.region_id) FROM regions8 q WHERE q.tile_id = r.tile_id AND q.n > 10), region_id) END AS target FROM regions8 r)
    GROUP BY tile_id, target""")
def a8_combine(spark, d):
    stats = cut(regions.region_stats(_grown(spark, d)[1]), "stats")
    first = stats.filter("size > 10").groupBy("param_id", "tile_id").agg(F.min("region_id").alias("absorber"))
    absorbed = stats.filter("size <= 10").select(*regions.REGION).join(first, ["param_id", "tile_id"])
    return regions.combine(stats, absorbed).select("tile_id", "region_id", "size", r9("sum_curv", "sum_curv"), "sum_x")


@query("SELECT tile_id, gold_face, result_face, CAST(overlap AS BIGINT) AS overlap FROM best")
def a9_best_match(spark, d):
    return scoring.best_match(_pairs(spark, d), ["gold_id"]).selectExpr(*_PAIR, "overlap")


@query("SELECT min(o_totalprice) AS min_score, max(o_totalprice) AS max_score, round(avg(o_totalprice), 4) AS mean_score, "
       "round(var_samp(o_totalprice) / 1e6, 4) AS var_score FROM orders")
def a11_score_stats(spark, d):
    stats = scoring.score_stats(fx.table(spark, d, "orders").select(F.col("o_totalprice").alias("score")))
    return stats.select("min_score", "max_score", F.round("mean_score", 4).alias("mean_score"),
                        F.round(F.col("var_score") / 1e6, 4).alias("var_score"))


def _prices(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("param_id"), F.col("o_totalprice").alias("score"))


@query("SELECT o_orderkey AS param_id, o_custkey AS smoothness, o_totalprice AS score FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def a12_best_candidate(spark, d):
    sets = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("param_id"), F.col("o_custkey").alias("smoothness"))
    return scoring.best_candidate(_prices(spark, d), sets)


# --- order and top-k --------------------------------------------------------------------

@query("SELECT tile_id, px, py, row_number() OVER (PARTITION BY tile_id ORDER BY ncurv, py, px) - 1 AS position FROM grown8")
def w1_seed_order(spark, d):
    cells = _masked(spark, d, 8)[1]
    return ranking.with_position(cells, ["tile_id"], growth.seed_order(cells, ["tile_id"])).select("tile_id", "px", "py", "position")


@query("SELECT tile_id, region_id, row_number() OVER (PARTITION BY tile_id ORDER BY size DESC, seed) - 1 AS position FROM large8")
def w2_size_order(spark, d):
    large = _large(spark, d)[3]
    return ranking.with_position(large, ["tile_id"], regions.size_order()).select("tile_id", "region_id", "position")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag "
       "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS position FROM lineitem")
def w3_with_position(spark, d):
    items = fx.table(spark, d, "lineitem").select(*_ITEM, "l_returnflag")
    return ranking.with_position(items, ["l_returnflag"], [F.col(c) for c in _ITEM]).drop("l_returnflag")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def w5_first_by(spark, d):
    return ranking.first_by(fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderpriority, o_orderkey, rnk FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders) WHERE rnk <= 5")
def w6_first_k(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranking.first_k(orders, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).drop("o_totalprice")


@query("SELECT o_orderkey AS param_id, o_totalprice AS score FROM orders ORDER BY score, param_id LIMIT 1")
def w7_rank_scores(spark, d):
    return scoring.rank_scores(_prices(spark, d))


# --- sets -------------------------------------------------------------------------------

@query("SELECT apn, count(*) AS faces FROM (SELECT tile_id AS apn FROM gold UNION ALL SELECT tile_id FROM result) GROUP BY apn")
def u1_append(spark, d):
    both = geojson.append(fx.faces(spark, d, "gold"), fx.faces(spark, d, "result"))
    return both.groupBy("apn").agg(F.count("*").alias("faces"))


@query("SELECT 0 AS param_id, count(*) AS faces, count(DISTINCT tile_id) AS tiles FROM result")
def u2_pool_by_param(spark, d):
    pooled = pool_by_param(fx.faces(spark, d, "result").withColumn("param_id", F.lit(0)))
    return pooled.groupBy("param_id").agg(F.count("*").alias("faces"), F.countDistinct("result_id.apn").alias("tiles"))


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u3_minus(spark, d):
    return ranking.minus(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("key")),
                         fx.table(spark, d, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def u3_minus_some(spark, d):
    return ranking.minus(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("key")),
                         fx.table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("key")), ["key"])


# --- iterative operators ----------------------------------------------------------------

@query("SELECT tile_id, cell_id, region_id, anchor FROM region_cells8")
def x1_grow_regions(spark, d):
    return _grown(spark, d)[1].select("tile_id", "cell_id", "region_id", "anchor")


@query("SELECT tile_id, cell_id AS node, root FROM part_labels WHERE (tile_id, cell_id) IN (SELECT (tile_id, a) FROM sides)")
def x1_components(spark, d):
    pixels = cut(_height_faces(spark, d), "pixels")
    ahead = pixels.select("tile_id", "face_id", fc.cell_id(F.col("px"), F.col("py")).alias("a"), F.explode(F.array(
        F.struct((F.col("px") + 1).alias("px"), F.col("py").alias("py")),
        F.struct(F.col("px").alias("px"), (F.col("py") + 1).alias("py")))).alias("q")).select(
        "tile_id", "face_id", "a", "q.px", "q.py")
    edges = ahead.join(pixels.drop("param_id"), ["tile_id", "face_id", "px", "py"]).select(
        "tile_id", "a", fc.cell_id(F.col("px"), F.col("py")).alias("b"))
    return components.components(edges, ["tile_id"])


@query("SELECT tile_id, region_id, n AS size, round(slope, 4) AS slope, round(azimuth, 4) AS azimuth FROM merge8_done")
def x2_merge_regions(spark, d):
    tiles, _, _, large, _ = _large(spark, d)
    stats = large.select(*regions.REGION, "size", *regions.SUMS, "seed_ncurv", "seed_id")
    merged, _ = merging.merge_regions(stats, tiles, tables.clean_params(fx.roof_params_df(spark)))
    return merged.select("tile_id", "region_id", "size", F.round("slope", 4).alias("slope"), F.round("azimuth", 4).alias("azimuth"))


@query("SELECT tile_id, region_id, face_id FROM merge8_faces WHERE face_id <> region_id")
def j11_region_names(spark, d):
    tiles, _, _, large, _ = _large(spark, d)
    stats = large.select(*regions.REGION, "size", *regions.SUMS, "seed_ncurv", "seed_id")
    _, names = merging.merge_regions(stats, tiles, tables.clean_params(fx.roof_params_df(spark)))
    return names.select("tile_id", "region_id", "face_id")


@query(f"SELECT tile_id, face_id, part_id, cells, CAST(cells AS DOUBLE) AS area FROM ({_PARTS})")
def x3_vectorize(spark, d):
    return faces.vectorize(_height_faces(spark, d)).select(
        "tile_id", "face_id", "part_id", "cells",
        F.aggregate(F.transform("rings", rings.ring_area), F.lit(0.0), lambda total, a: total + a).alias("area"))


@query("""SELECT tile_id, CAST(face_id AS BIGINT) AS face_id, count(*) AS cells, CAST(sum(cx) AS BIGINT) AS sum_cx, CAST(sum(cy) AS BIGINT) AS sum_cy
    FROM (SELECT tile_id, face_id, unnest(range(CAST(2 * xa AS BIGINT), CAST(2 * xb AS BIGINT))) AS cx, ya, yb FROM result_crs),
         LATERAL (SELECT unnest(range(CAST(2 * ya AS BIGINT), CAST(2 * yb AS BIGINT))) AS cy) GROUP BY ALL""")
def x4_rasterize(spark, d):
    cells = scoring.rasterize(fx.faces(spark, d, "result"), ["apn", "feature_id"], fx.CELL)
    return cells.groupBy(F.col("apn").alias("tile_id"), F.col("feature_id").alias("face_id")).agg(
        F.count("*").alias("cells"), F.sum("cx").alias("sum_cx"), F.sum("cy").alias("sum_cy"))


# --- whole queries ----------------------------------------------------------------------

@query(None)
def q1_segment(spark, d):
    return segment(fx.roof_points(spark, d), fx.outline(spark, d), fx.raster(spark, d), fx.georef(spark, d),
                   fx.roof_params_df(spark).filter("param_id = 0")).drop("param_id")


@query(_DEM)
def q2_dem(spark, d):
    return dem(fx.points(spark, d))


@query("""SELECT round((sum_terms + (m - mg) + (n - mr)) / CAST(m + n AS DOUBLE), 6) AS score
    FROM (SELECT sum((1 - overlap / CAST(gold_area AS DOUBLE) + 1 - overlap / CAST(result_area AS DOUBLE)) / 2) AS sum_terms,
                 count(*) AS mg, count(DISTINCT (tile_id, result_face)) AS mr FROM best),
         (SELECT count(*) AS m FROM gold), (SELECT count(*) AS n FROM result)""")
def q3_evaluate(spark, d):
    gold, result = _scored(spark, d)
    return scoring.evaluate(gold, result, fx.CELL).select(r6("score", "score"))


def _small_faces(spark, d):
    """A face for each order line, far smaller than a cell, and the same moved a little; every seventh has no counterpart."""
    items = ranking.with_position(fx.table(spark, d, "lineitem").select(*_ITEM, "l_tax", "l_discount"), [], [F.col(c) for c in _ITEM], "at")
    boxes = items.selectExpr("at AS gold_id", "at AS result_id", "l_tax / 4 AS move", "(at % 1000) * 0.3D AS x0", "(at DIV 1000) * 0.3D AS y0",
                             "0.1D + l_tax AS w", "0.1D + l_discount AS h")
    ring = lambda move: F.expr(f"array(array(array(x0 + {move}, y0), array(x0 + w + {move}, y0), array(x0 + w + {move}, y0 + h), array(x0 + {move}, y0 + h), array(x0 + {move}, y0)))")
    return boxes.select("gold_id", ring("0D").alias("rings")), boxes.filter("result_id % 7 > 0").select("result_id", ring("move").alias("rings"))


_SMALL = "(SELECT l_tax, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS no FROM lineitem)"


@query(f"SELECT round((sum(CASE WHEN no % 7 > 0 THEN l_tax / 4 / (0.1 + l_tax) ELSE 1 END)) / CAST(count(*) + count_if(no % 7 > 0) AS DOUBLE), 6) AS score FROM {_SMALL}")
def q3_small_faces(spark, d):
    return scoring.evaluate(*_small_faces(spark, d), fx.CELL).select(r6("score", "score"))


@query(f"SELECT no AS gold_id FROM {_SMALL} WHERE no % 7 = 0")
def j9_unmatched_small(spark, d):
    gold, result = _small_faces(spark, d)
    pairs = scoring.overlap_pairs(gold, result, ["gold_id"], ["result_id"], fx.CELL)
    return scoring.unmatched_gold(gold, scoring.best_match(pairs, ["gold_id"]), ["gold_id"]).select("gold_id")


@query(None)
def q4_sweep(spark, d):
    gold, _ = _scored(spark, d)
    return sweep(fx.roof_points(spark, d), fx.outline(spark, d), fx.raster(spark, d), fx.georef(spark, d), gold,
                 fx.roof_params_df(spark), fx.CELL)
