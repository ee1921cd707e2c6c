"""Many parameter sets scored against ground truth in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slopeweave.functions.cells import ROOF_COLOR
from slopeweave.operators.scoring import evaluate
from slopeweave.plans.segment import segment
from slopeweave.session import cut
from slopeweave.sources.tables import valid_params


def pool_by_param(features: DataFrame) -> DataFrame:
    """Faces of all tiles under their parameter set, as ``(param_id, result_id, rings)``."""
    return features.select("param_id", F.struct("apn", "feature_id").alias("result_id"), "rings")


def sweep(points: DataFrame, outline: DataFrame, raster: DataFrame, georef: DataFrame, gold: DataFrame,
          params: DataFrame, cell: float, roof_color: int = ROOF_COLOR, slope_cmp: str = "gt",
          touching: bool = True) -> DataFrame:
    """``(param_id, score)`` for every valid parameter set; lower is closer to ``gold``, the
    faces ``(gold_id, rings)`` of all tiles in map coordinates."""
    features = cut(segment(points, outline, raster, georef, params, roof_color, slope_cmp), "features")
    return evaluate(gold, pool_by_param(features), cell, ["param_id"],
                    valid_params(params).select("param_id"), touching)
