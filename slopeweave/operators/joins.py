"""Joins of a long table with a table that has few rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, which has few rows per key and comes from a written table.

    Spark knows the size of a written table from its files: below the broadcast threshold ``big`` is not moved at all. Beyond
    it both sides are shuffled, and where one key of ``big`` fills a partition, adaptive execution splits that partition
    by the sizes it has just written and repeats only the small side's part for it. ``how`` is inner, left, left_semi or left_anti,
    the joins whose left side can be split.
    """
    return big.join(small, on, how)
