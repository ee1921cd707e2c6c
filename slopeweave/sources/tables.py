"""Parquet tables of pixels, georeferences and elevation, and run parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from slopeweave.sources.folders import local_path, put_in_place, stage, without_empty

PIXELS = "tile_id STRING, px INT, py INT, argb INT"
GEOREF = ("tile_id STRING, m00 DOUBLE, m01 DOUBLE, m02 DOUBLE, "
          "m10 DOUBLE, m11 DOUBLE, m12 DOUBLE, srid INT")
PARAMS = ("param_id INT, smoothness DOUBLE, curvature DOUBLE, color DOUBLE, knn INT, "
          "region_limit INT, slope DOUBLE, azimuth DOUBLE")
RAW_PARAMS = ("param_id INT, smoothness DOUBLE, curvature DOUBLE, color DOUBLE, knn DOUBLE, "
              "region_limit DOUBLE, slope DOUBLE, azimuth DOUBLE")
VECTOR = ["smoothness", "curvature", "color", "knn", "region_limit", "slope", "azimuth"]

# Edge of the squares over which a tile's pixels are spread when written.
WRITE_SQUARE = 2048


@dataclass(frozen=True)
class Params:
    """One parameter set. The defaults are fixed values, the configured ones of the data model."""

    param_id: int = 0
    smoothness: float = 0.8946964372034376
    curvature: float = 0.0021506976303888137
    color: float = 3.2313377494040365
    knn: int = 54
    region_limit: int = 76
    slope: float = 0.33
    azimuth: float = 7.907927062958761


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIXELS).parquet(path)


def read_georef(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEOREF).parquet(path)


def params_df(spark: SparkSession, rows: Iterable[Params | tuple]) -> DataFrame:
    """Parameter sets as rows; knn and size limit may still be fractions or negative."""
    tuples = [astuple(r) if isinstance(r, Params) else tuple(r) for r in rows]
    return spark.createDataFrame(
        [(t[0], *[None if v is None else float(v) for v in t[1:]]) for t in tuples], RAW_PARAMS)


def valid_params(params: DataFrame) -> DataFrame:
    """Parameter sets with all seven values."""
    return params.dropna(subset=VECTOR)


def clean_params(params: DataFrame) -> DataFrame:
    """Make every value non-negative, and knn and size limit whole."""
    whole = {"knn", "region_limit"}
    values = [F.abs(c).cast("int").alias(c) if c in whole else F.abs(c).alias(c) for c in VECTOR]
    return params.select("param_id", *values)


def write_dem(dem: DataFrame, path: str) -> None:
    """One folder of elevation pixels per tile; tiles already there are replaced.

    A tile is spread over squares of pixels, so a large tile is written by many tasks, each of which writes the files of its tiles. Where tasks
    cannot reach ``path`` by themselves, Spark writes and replaces the folders.
    """
    square = [F.floor(F.col(axis) / WRITE_SQUARE) for axis in ("px", "py")]
    root = local_path(dem.sparkSession, path)
    if root is None:
        (dem.repartition("tile_id", *square).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("tile_id").parquet(path))
        return
    named = dem.select(without_empty("tile_id", dem), *[c for c in dem.columns if c != "tile_id"])
    rows = named.repartition("tile_id", *square).sortWithinPartitions("tile_id")
    put_in_place(stage(rows, ["tile_id"], root, _ParquetFile, ".snappy.parquet"), root)


class _ParquetFile:
    """A file that opens with its first rows."""

    def __init__(self, path: str):
        self.path, self.out = path, None

    def write(self, batch: pa.RecordBatch) -> None:
        if self.out is None:
            self.out = pq.ParquetWriter(self.path, batch.schema)
        self.out.write_batch(batch)

    def close(self) -> None:
        self.out.close()


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    return read_pixels(spark, path).select("tile_id", "px", "py", "argb")


def processed_count(df: DataFrame) -> int:
    """Number of distinct tiles; starts the job."""
    return df.agg(F.countDistinct("tile_id")).first()[0]
