"""Roof-surface segmentation of point clouds and aligned rasters, on Spark DataFrames."""

from slopeweave.plans.dem import dem
from slopeweave.plans.segment import segment
from slopeweave.plans.sweep import sweep
from slopeweave.operators.scoring import evaluate

__all__ = ["dem", "evaluate", "segment", "sweep"]
