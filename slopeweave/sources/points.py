"""Text point clouds and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slopeweave.functions.cells import base_name


def manifest(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Files below ``path`` (or ``path`` itself) with a suffix; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*{suffix}").load(path))
    return files.select("path", base_name(F.col("path")).alias("tile_id"), "length",
                        F.col("modificationTime").alias("modified"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of every ``.txt`` file below ``path``, one ``x y z`` per line.

    The file's base name is the tile. ``seq`` grows with the position in the file: the
    split's first byte plus the row's index in its task, which is less than the bytes of one
    split. Trailing spaces and blank lines are passed over; any other shape fails the scan.
    """
    index_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
        .select(base_name(F.col("_metadata.file_name")).alias("tile_id"),
                (F.col("_metadata.file_block_start") + index_in_task).alias("seq"),
                F.rtrim("value").alias("line"))
        .filter(F.col("line") != "")
        .withColumn("token", F.split("line", " "))
    )
    strict = F.when(F.size("token") == 3, F.col("token")).otherwise(
        F.raise_error(F.concat(F.lit("expected three numbers: "), F.col("line"))))
    return (lines.withColumn("token", strict)
            .select("tile_id", "seq",
                    *[F.col("token")[i].cast("double").alias(axis) for i, axis in enumerate("xyz")]))
