"""Positions, first matches and nearest-k that hold up under hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slopeweave.operators.joins import attach
from slopeweave.session import cut, held


def with_position(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in its group.

    Rows are range-partitioned on group and order, so a large group is spread over many
    tasks; a per-partition count then gives each partition its offset within the group.
    ``order`` must be a total order within the group.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = [F.col(k) for k in keys]
    with held(df, "unplaced") as rows:
        placed = cut(
            rows.repartitionByRange(parts, *group, *order)
            .sortWithinPartitions(*group, *order)
            .withColumn("_at", F.monotonically_increasing_id())
            .withColumn("_part", F.shiftright("_at", 33)),
            "placed")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(*keys, "_part", (F.col("_before") - F.col("_first")).alias("_shift")),
        "offsets")
    return (attach(placed, offsets, [*keys, "_part"])
            .withColumn(name, F.col("_at") + F.col("_shift"))
            .select(*df.columns, name))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by ``order``."""
    others = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in others if c not in order])
    return (df.select(*keys, ordered.alias("_row")).groupBy(*keys).agg(F.min("_row").alias("_row"))
            .select(*keys, *[F.col("_row")[c].alias(c) for c in others]))


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rnk") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. Spark prunes each task's rows to
    ``k`` per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def minus(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that are not in ``done``."""
    return df.select(*keys).dropDuplicates().join(done.select(*keys).dropDuplicates(), keys, "left_anti")
