"""Places of rows in an order, and the first k rows, of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slopeweave.session import cut


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the long ``name``: the row's place by ``order``, from 0.

    Rows are range-partitioned and sorted by the order; the sizes of the partitions (one row
    each) give the number of rows before each, so no task sees more than its own rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                      .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = sorted_rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before"))
    return placed.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def mark_top(df: DataFrame, order: list[Column], k: Column, name: str) -> DataFrame:
    """Add the boolean ``name``: whether the row is among the first ``k`` by ``order``."""
    return positions(df, order, "_place").select(*df.columns, (F.col("_place") < k).alias(name))
