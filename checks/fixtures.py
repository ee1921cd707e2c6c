"""Inputs derived from the given tables: one tile per supplier, so tiles grow with the data."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from slopeweave.session import scratch_path
from slopeweave.sources.geojson import lines
from slopeweave.sources.tables import params_df

# Fixed values of the fixtures.
IMAGE = 30          # raster and outline are IMAGE x IMAGE pixels
PIXELS_AT_ONCE = 1 << 20    # pixels that one task makes, about
NO_TILE = "__HIVE_DEFAULT_PARTITION__"    # file name of rows without a tile, as Spark names their folder
BORDER = 3          # pixels around the roof
CELL = 0.5          # map units per pixel
PARAM_ROWS = [
    (0, 0.98, 0.0008, 15.0, 54, 50, 2.0, 15.0),
    (1, 0.90, 0.0100, 15.0, 24, 50, 2.0, 15.0),
    (2, -0.98, 0.0008, 15.0, 8, 20, 0.5, 30.0),
]
ROOF_ROWS = [
    (0, 0.8946964372034376, 0.0021506976303888137, 3.2313377494040365, 54, 76, 0.33, 7.907927062958761),
    (1, 0.98, 0.08, 100.0, 54, 20, 2.0, 15.0),
    (2, -0.99, 0.05, 15.0, 24, 20, 2.0, 30.0),
    (3, 0.99, 0.02, 15.0, 8, 10, 1.0, 40.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS tile_id",
        "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, "
        "l_extendedprice) AS BIGINT) AS seq",
        "l_quantity AS x", "l_extendedprice / 2000 AS y",
        "30 - 0.5D * abs(l_quantity - 25) + 0.1D * (l_extendedprice / 2000) + l_discount AS z")


def roof_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lattice point per order line: a gable per tile, its flanks steeper beyond a slanted
    line, with a little noise."""
    numbered = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey", "l_discount", "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, "
        "l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS seq")
    placed = numbered.selectExpr("*", "CAST((seq - 1) % 24 AS DOUBLE) AS x", "CAST((seq - 1) DIV 24 AS DOUBLE) AS y")
    far = placed.selectExpr("*", "abs(x - (10 + l_suppkey % 4)) AS off")
    return far.selectExpr(
        "CAST(l_suppkey AS STRING) AS tile_id", "seq", "x", "y",
        "30 - 0.4D * off - 0.5D * greatest(off - 3 - y / 6, 0.0D) + 0.05D * y + 0.1D * l_discount AS z")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.sequence(F.lit(0), F.lit(IMAGE - 1))
    tiles = table(spark, sf_dir, "supplier").select("s_suppkey")
    # The table is small and its pixels are many, so its rows are dealt out before they are repeated.
    parts = max(-(-tiles.count() * IMAGE * IMAGE // PIXELS_AT_ONCE), 1)
    return (tiles.repartition(parts).select("s_suppkey", F.explode(span).alias("px"))
            .select("s_suppkey", "px", F.explode(span).alias("py")))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).selectExpr(
        "CAST(s_suppkey AS STRING) AS tile_id", "px", "py",
        "CAST((CASE WHEN px < 15 THEN 180 ELSE 120 END + (px * 7 + py * 3) % 4) * 65536 "
        "+ 100 * 256 + 90 - 16777216 AS INT) AS argb")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).selectExpr(
        "CAST(s_suppkey AS STRING) AS tile_id", "px", "py",
        "CAST(CASE WHEN px BETWEEN 3 AND 26 AND py BETWEEN 3 AND 26 "
        "THEN 16716049 - 16777216 ELSE -16777216 END AS INT) AS argb")


def georef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS tile_id", "0.5D AS m00", "0.0D AS m01", "s_suppkey * 100.0D AS m02",
        "0.0D AS m10", "-0.5D AS m11", "5000.0D AS m12", "3857 AS srid")


def params(spark: SparkSession) -> DataFrame:
    return params_df(spark, PARAM_ROWS)


def roof_params() -> list[dict]:
    names = ["param_id", "smoothness", "curvature", "color", "knn", "region_limit", "slope", "azimuth"]
    return [{n: abs(v) if n != "param_id" else v for n, v in zip(names, row)} for row in ROOF_ROWS]


def roof_params_df(spark: SparkSession) -> DataFrame:
    return params_df(spark, ROOF_ROWS)


def _writer(root: str, suffix: str):
    """Write runs of rows ``(tile_id, value)`` as the lines of ``<tile><suffix>``, one file open at a time."""
    def write(batches):
        files, base = fs.FileSystem.from_uri(root)
        open_name, out = None, None
        for batch in batches:
            for tile, value in zip(batch["tile_id"].to_pylist(), batch["value"].to_pylist()):
                name = NO_TILE if tile is None else tile
                if name != open_name:
                    if out is not None:
                        out.close()
                    open_name, out = name, files.open_output_stream(f"{base}/{name}{suffix}")
                out.write(f"{'' if value is None else value}\n".encode())
        if out is not None:
            out.close()
        yield pa.record_batch({"tile_id": pa.array([], pa.string())})

    return write


def _write_named(spark: SparkSession, lines: DataFrame, root: str, suffix: str) -> str:
    """Write ``(tile_id, place, value)`` as one text file per tile, named by the tile.

    The tasks write and name the files, so that nothing is done file by file on the driver. Where they cannot reach ``root`` by
    themselves, Spark writes a folder per tile; the files are then given their names.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_lines = lines.repartition(parts, "tile_id").sortWithinPartitions("tile_id", "place").select("tile_id", "value")
    if files.getUri().getScheme() == "file":
        local = files.makeQualified(path).toUri().getPath()
        sorted_lines.mapInArrow(_writer(f"file://{quote(local)}", suffix), "tile_id STRING").foreach(lambda row: None)
        return root
    return _write_renamed(spark, sorted_lines, files, root, suffix)


def _write_renamed(spark: SparkSession, sorted_lines: DataFrame, files, root: str, suffix: str) -> str:
    """The same by way of a folder per tile, on any file system that Spark writes to."""
    staged = scratch_path(spark, "staged")
    sorted_lines.write.partitionBy("tile_id").text(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in files.listStatus(path(staged)):
        name = folder.getPath().getName()
        if name.startswith("tile_id="):
            part = files.listStatus(folder.getPath())[0].getPath()
            files.rename(part, path(f"{root}/{name.split('=', 1)[1]}{suffix}"))
    return root


def write_point_files(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    """The points as one ``<tile>.txt`` of ``x y z`` lines per tile; returns the folder."""
    lines = points(spark, sf_dir).select("tile_id", F.col("seq").alias("place"), F.concat_ws(
        " ", *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    return _write_named(spark, lines, root or scratch_path(spark, "points"), ".txt")


def write_face_files(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    """The gold faces as one ``<tile>.geojson`` per tile; returns the folder."""
    written = lines(faces(spark, sf_dir, "gold"))
    place = (F.col("kind").cast("bigint") * (1 << 40) + F.coalesce("feature_id", F.lit(0))).alias("place")
    return _write_named(spark, written.select(F.col("apn").alias("tile_id"), place, "value"), root or scratch_path(spark, "faces"), ".geojson")


def write_mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """One ``<tile>.geojson`` per tile with a multi-polygon (the gold boxes, the first with a hole), a feature without geometry, and a collection of
    a point and a polygon; returns the folder."""
    ring = lambda x0, x1, y0, y1: f"[[{x0},{y0}],[{x1},{y0}],[{x1},{y1}],[{x0},{y1}],[{x0},{y0}]]"
    first = f"[{ring(3, 15, 3, 27)},{ring(5, 7, 5, 9)}]"
    kinds = [f'{{"type":"MultiPolygon","coordinates":[{first},[{ring(15, 27, 3, 27)}]]}}', "null",
             f'{{"type":"GeometryCollection","geometries":[{{"type":"Point","coordinates":[1,1]}},{{"type":"Polygon","coordinates":[{ring(0, "SIDE", 0, 2)}]}}]}}']
    feature = ",".join(f'{{"type":"Feature","id":"{i}","properties":{{}},"geometry":{g}}}' for i, g in enumerate(kinds))
    value = F.replace(F.lit(f'{{"type":"FeatureCollection","features":[{feature}]}}'), F.lit("SIDE"), (F.col("s_suppkey") % 5 + 1).cast("string"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("tile_id"), F.lit(0).cast("bigint").alias("place"), value.alias("value"))
    return _write_named(spark, docs, scratch_path(spark, "mixed-faces"), ".geojson")


_BOXES = {
    "gold": ("explode(array(0, 1))",
             "CASE WHEN f = 0 THEN 3 ELSE 15 END", "CASE WHEN f = 0 THEN 15 ELSE 27 END", "3", "27"),
    "result": ("explode(array(0, 1, 2))",
               "CASE WHEN f = 0 THEN 3 WHEN f = 1 THEN 13 + s_suppkey % 5 ELSE 0 END",
               "CASE WHEN f = 0 THEN 13 + s_suppkey % 5 WHEN f = 1 THEN 27 ELSE 2 END",
               "CASE WHEN f = 2 THEN 0 ELSE 3 END", "CASE WHEN f = 2 THEN 2 ELSE 27 END"),
}


def boxes(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Faces as half-open boxes of pixels; ``which`` is gold or result."""
    faces, x0, x1, y0, y1 = _BOXES[which]
    return (table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{faces} AS f")
            .selectExpr("CAST(s_suppkey AS STRING) AS tile_id", "f AS face_id",
                        *[f"CAST({v} AS INT) AS {n}" for v, n in ((x0, "x0"), (x1, "x1"), (y0, "y0"), (y1, "y1"))]))


def faces(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """The boxes as features in map coordinates."""
    from slopeweave.operators.faces import to_crs

    ring = ("array(array(array(CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE)), array(CAST(x1 AS DOUBLE), CAST(y0 AS DOUBLE)), "
            "array(CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE)), array(CAST(x0 AS DOUBLE), CAST(y1 AS DOUBLE)), "
            "array(CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE))))")
    pixel = boxes(spark, sf_dir, which).selectExpr(
        "tile_id", "tile_id AS apn", "CAST(face_id AS BIGINT) AS feature_id", f"{ring} AS rings",
        "CAST(NULL AS DOUBLE) AS slope", "CAST(NULL AS DOUBLE) AS azimuth")
    return to_crs(pixel, georef(spark, sf_dir)).drop("tile_id")


# The same inputs for the SQL checks, as common table expressions by name. Tiles are numbers
# there and become strings in the final result.
_PIXELS_SQL = ("supplier CROSS JOIN (SELECT CAST(range AS INT) AS px FROM range(30)) "
               "CROSS JOIN (SELECT CAST(range AS INT) AS py FROM range(30))")
SQL = {
    "points": """
        SELECT l_suppkey AS tile_id,
               row_number() OVER (PARTITION BY l_suppkey
                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq,
               l_quantity AS x, l_extendedprice / 2000 AS y,
               CAST(30 AS DOUBLE) - CAST(0.5 AS DOUBLE) * abs(l_quantity - 25)
                 + CAST(0.1 AS DOUBLE) * (l_extendedprice / 2000) + l_discount AS z
        FROM lineitem""",
    "roof_points": """
        SELECT l_suppkey AS tile_id, seq, x, y,
               30 - CAST(0.4 AS DOUBLE) * abs_off
                 - CAST(0.5 AS DOUBLE) * greatest(abs_off - 3 - y / 6, CAST(0 AS DOUBLE))
                 + CAST(0.05 AS DOUBLE) * y + CAST(0.1 AS DOUBLE) * l_discount AS z
        FROM (SELECT *, abs(x - (10 + l_suppkey % 4)) AS abs_off
              FROM (SELECT *, CAST((seq - 1) % 24 AS DOUBLE) AS x, CAST((seq - 1) // 24 AS DOUBLE) AS y
                    FROM (SELECT l_suppkey, l_discount, row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
                          FROM lineitem)))""",
    "raster": f"""
        SELECT s_suppkey AS tile_id, px, py,
               CAST((CASE WHEN px < 15 THEN 180 ELSE 120 END + (px * 7 + py * 3) % 4) * 65536
                    + 100 * 256 + 90 - 16777216 AS INT) AS argb
        FROM {_PIXELS_SQL}""",
    "outline": f"""
        SELECT s_suppkey AS tile_id, px, py,
               CAST(CASE WHEN px BETWEEN 3 AND 26 AND py BETWEEN 3 AND 26
                    THEN 16716049 - 16777216 ELSE -16777216 END AS INT) AS argb
        FROM {_PIXELS_SQL}""",
    "georef": """
        SELECT s_suppkey AS tile_id, CAST(0.5 AS DOUBLE) AS m00, CAST(0 AS DOUBLE) AS m01,
               CAST(s_suppkey AS DOUBLE) * 100 AS m02, CAST(0 AS DOUBLE) AS m10, CAST(-0.5 AS DOUBLE) AS m11,
               CAST(5000 AS DOUBLE) AS m12, 3857 AS srid
        FROM supplier""",
    "gold": """
        SELECT s_suppkey AS tile_id, f AS face_id,
               CASE WHEN f = 0 THEN 3 ELSE 15 END AS x0, CASE WHEN f = 0 THEN 15 ELSE 27 END AS x1,
               3 AS y0, 27 AS y1
        FROM supplier CROSS JOIN (VALUES (0), (1)) v(f)""",
    "result": """
        SELECT s_suppkey AS tile_id, f AS face_id,
               CASE WHEN f = 0 THEN 3 WHEN f = 1 THEN 13 + s_suppkey % 5 ELSE 0 END AS x0,
               CASE WHEN f = 0 THEN 13 + s_suppkey % 5 WHEN f = 1 THEN 27 ELSE 2 END AS x1,
               CASE WHEN f = 2 THEN 0 ELSE 3 END AS y0, CASE WHEN f = 2 THEN 2 ELSE 27 END AS y1
        FROM supplier CROSS JOIN (VALUES (0), (1), (2)) v(f)""",
}
